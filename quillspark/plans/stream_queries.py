"""Queries that run streams over the tables: recorded pages, an index that grows, sessions of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records as rc
from ..operators.vector_index import VectorIndex
from ..sources.pages import read_pages, record, stream_pages
from ..sources.snapshots import VERSION, Snapshots
from ..sources.tables import shared_path, table
from ..streaming.stores import index_stream, session_store, table_stream
from .graph_queries import RAW, raw_edges

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Items of a page of references.
LIMIT = 4
PAGES = f"""pages AS (SELECT i AS key, rn // {LIMIT} * {LIMIT} AS "offset", count(*) AS items, count(*) FILTER (WHERE t % 4 <> 0) AS known, min(s) AS s FROM (SELECT i, s, t, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS rn FROM raw) GROUP BY ALL),
told AS (SELECT *, CASE (s * 7 + "offset") % 12 WHEN 0 THEN 404 WHEN 3 THEN 503 ELSE 200 END AS status, CASE (s * 7 + "offset") % 12 WHEN 3 THEN 3 WHEN 6 THEN 2 WHEN 8 THEN 3 ELSE 1 END AS attempts FROM pages)"""


def recording(spark: SparkSession, d: str) -> str:
    """The path of a recording of the references of all papers in pages, some of which fail, for good or for a while."""
    return shared_path(spark, d, "recording", _recording)


def _recording(spark, d, path):
    rn = F.row_number().over(Window.partitionBy("i").orderBy("t")) - 1
    doi = F.when(F.col("t") % 4 != 0, F.concat(F.lit("10.1234/P"), F.col("t").cast("string")))
    item = F.struct(F.struct(F.struct(doi.alias("DOI")).alias("externalIds")).alias("citedPaper"))
    rows = raw_edges(spark, d).withColumn("rn", rn).withColumn("offset", F.floor(F.col("rn") / LIMIT) * LIMIT)
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col("rn"), item.alias("x")))), lambda x: x["x"])
    pages = rows.groupBy(F.col("i").alias("key"), "offset").agg(F.to_json(F.struct(items.alias("data"))).alias("page"), F.min("s").alias("s"))
    kind = (F.col("s") * 7 + F.col("offset")) % 12
    answers = F.when(kind == 0, F.array(F.lit(404))).when(kind == 3, F.array(F.lit(503), F.lit(500), F.lit(503))).when(kind == 6, F.array(F.lit(503), F.lit(200))).when(kind == 8, F.array(F.lit(429), F.lit(502), F.lit(200))).otherwise(F.array(F.lit(200)))
    tried = pages.select("key", "offset", "page", F.posexplode(answers).alias("attempt", "status"))
    record(tried.withColumn("body", F.when(F.col("status") == 200, F.col("page")).otherwise("")), path)


@query("paged_references", f"""WITH {RAW}, {PAGES} SELECT key, "offset", status, attempts, CASE WHEN status = 200 THEN items ELSE 0 END AS items, CASE WHEN status = 200 THEN known ELSE 0 END AS known,
CASE status WHEN 404 THEN 'HTTP 404' WHEN 503 THEN 'no answer after 3 attempts' END AS reason FROM told""")  # fmt: skip
def paged_references(spark, d):
    """What came of each page, with the retries, and how many references are on it."""
    return with_items(read_pages(spark, recording(spark, d)))


def with_items(pages: DataFrame) -> DataFrame:
    found = rc.page_edges(pages.where("page is not null").select("key", "offset", "page"), "key")
    counts = found.groupBy("key", (F.floor(F.col("pos") / LIMIT) * LIMIT).alias("offset")).agg(F.count(F.lit(1)).alias("items"), F.count("doi").alias("known"))
    rows = pages.join(counts, ["key", "offset"], "left")
    return rows.select("key", "offset", "status", "attempts", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("known", F.lit(0)).alias("known"), "reason")


@query("streamed_references", ORACLES["paged_references"])
def streamed_references(spark, d):
    """The same by a stream of files, which is run again and goes on where it stopped."""
    return with_items(Snapshots(spark, shared_path(spark, d, "streamed-pages", _streamed_pages)).read("rows").drop(VERSION))


def _streamed_pages(spark, d, path):
    log, at = Snapshots(spark, f"{path}"), recording(spark, d)
    for _ in range(2):  # the second run finds that nothing has come
        table_stream(stream_pages(spark, at), log, f"{path}-checkpoint")


GROWN = "k AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0)"


@query("streamed_index", f"WITH {GROWN} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM k QUALIFY rank <= 3")
def streamed_index(spark, d):
    """The nearest vectors by an index that a stream has filled; its first batch is played twice."""
    queries = table(spark, d, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return VectorIndex(spark, shared_path(spark, d, "grown-index", _grown)).search(queries, 3)


def _grown(spark, d, path):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("source"), F.col("embedding").alias("v"))
    index = VectorIndex.create(rows.where("id % 4 = 0"), path)
    for k in (1, 2, 3):
        rows.where(F.col("id") % 4 == k).write.mode("append").parquet(f"{path}-landing")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}-landing")
    index_stream(stream, index, f"{path}-checkpoint")
    index.append(rows.where("id % 4 = 1"), writer="stream", epoch=0)


@query("event_sessions", """WITH e AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR, true)::INT AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id::VARCHAR AS user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")  # fmt: skip
def event_sessions(spark, d):
    """Sessions of users by a stream that gets the events in parts, the late ones of each part with the next."""
    from ..sources.snapshots import Registry

    rows = Registry(spark, shared_path(spark, d, "sessions", _sessions), ["user", "began"]).rows()
    zone = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.select(F.col("user").alias("user_id"), zone("began"), zone("ended"), "n", F.round("total", 4).alias("total"))


def _sessions(spark, d, path):
    events = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), "value")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    parts = [events]
    if ends["a"] is not None:
        # every seventh event comes up to a day late
        late = F.when(F.xxhash64("user", "ts") % 7 == 0, F.lit(86_000)).otherwise(0)
        part = F.least(F.floor((F.unix_timestamp("ts") + late - int(ends["a"].timestamp())) * 4 / max(1, int((ends["b"] - ends["a"]).total_seconds()))), F.lit(3))
        parts = [events.where(part == k) for k in range(4)]
    for rows in parts:  # a part is written by many tasks; the stream, run again, takes it as its next batch
        rows.write.mode("append").parquet(f"{path}-landing")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}-landing")
        session_store(stream, path, f"{path}-checkpoint", gap="2 hours", late="10 days")
