"""Queries that write to the shared folder and read back: files, registries, seeds, parsed documents, answers, streams' windows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import providers
from ..operators import citations as ct
from ..operators import markdown as md
from ..sources import sinks, tables
from ..sources.tables import shared_dir, table
from ..streaming.ingest import window_counts
from .rag import Pipeline
from .text_queries import CITED, cited, docs

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def place(spark, name):
    return f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex}"


@query("json_files", "SELECT p_partkey, p_name, p_size FROM part")
def json_files(spark, d):
    at = place(spark, "json")
    sinks.save_json(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), at)
    return tables.read_json(spark, at, "p_partkey bigint, p_name string, p_size int", lines=True)


def nation_texts(spark, d):
    """A text file for each nation, in a folder of its key."""
    at = place(spark, "texts")
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("\nof "), F.col("n_regionkey").cast("string")).alias("text"))
    sinks.save_text(rows, "text", at, by=["n_nationkey"])
    return at


NATION = "n_name || chr(10) || 'of ' || n_regionkey || chr(10)"


def key_of(path):
    return F.regexp_extract(path, r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey")


@query("text_files", f"SELECT n_nationkey, {NATION} AS text FROM nation")
def text_files(spark, d):
    return tables.read_texts(spark, nation_texts(spark, d) + "/*").select(key_of(F.col("path")), "text")


@query("listed_files", f"SELECT n_nationkey, true AS named, length({NATION}) AS size FROM nation")
def listed_files(spark, d):
    files = tables.list_files(spark, nation_texts(spark, d), "*.txt", recursive=True)
    return files.select(key_of(F.col("path")), F.col("name").startswith("part-").alias("named"), "size")


@query("file_hashes", f"SELECT n_nationkey, sha256({NATION}) AS sha256 FROM nation")
def file_hashes(spark, d):
    return tables.file_digests(spark, nation_texts(spark, d) + "/*").select(key_of(F.col("path")), "sha256")


@query("registry_file", "SELECT 'f' || n_nationkey AS file_id, n_name AS file_name, n_regionkey AS file_size, CASE WHEN n_regionkey > 1 THEN '10.1/N' || n_nationkey END AS doi FROM nation")
def registry_file(spark, d):
    n = F.col("n_nationkey").cast("string")
    row = F.struct(F.col("n_name").alias("file_name"), F.col("n_regionkey").alias("file_size"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("10.1/N"), n)).alias("doi"))
    rows = table(spark, d, "nation").select(F.concat(F.lit("f"), n).alias("file_id"), row.alias("row"))
    at = place(spark, "registry")
    sinks.save_registry(rows, at)
    return tables.read_registry(spark, at, "file_name string, file_size int, doi string")


@query("seed_file", "SELECT 'https://doi.org/10.1/C' || c_custkey AS seed FROM customer")
def seed_file(spark, d):
    at = place(spark, "seeds")
    sinks.save_text(table(spark, d, "customer").select(F.concat(F.lit(" https://doi.org/10.1/C"), F.col("c_custkey").cast("string"), F.lit("\n")).alias("seed")), "seed", at)
    return tables.read_seeds(spark, at)


@query("edge_file", "SELECT 'c' || c_custkey AS source_doi, 'n' || c_nationkey AS target_doi, c_mktsegment || ', \"' || c_name || '\"' AS source_title, '' AS target_title, CASE WHEN c_custkey % 2 = 0 THEN 'parallel' ELSE '' END AS label, (c_custkey % 5)::VARCHAR AS n_contexts, 'two' || chr(10) || 'lines' AS reason FROM customer")
def edge_file(spark, d):
    n = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.concat(F.lit(" c"), n.cast("string")).alias("source_doi"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_doi"), F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"')).alias("source_title"),
        F.lit(None).cast("string").alias("target_title"), F.when(n % 2 == 0, "parallel ").alias("label"), (n % 5).cast("string").alias("n_contexts"), F.lit("two\nlines").alias("reason"),
    )
    at = place(spark, "edges")
    sinks.save_csv(rows, at)
    return tables.read_edge_csv(spark, at)


@query("feature_files", "SELECT p_partkey AS doi, p_size AS reference_count, 2 AS version FROM part")
def feature_files(spark, d):
    at = place(spark, "features")
    sinks.save_table(table(spark, d, "part").select(F.col("p_partkey").alias("doi"), F.col("p_size").alias("reference_count")), at, {"version": 2})
    rows = spark.read.parquet(at)
    return rows.withColumn("version", F.lit(sinks.table_metadata(rows)["version"]))


@query("embedding_files", "SELECT vec_id AS doi, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id % 4 > 0")
def embedding_files(spark, d):
    at = place(spark, "embeddings")
    sinks.save_embeddings(table(spark, d, "embeddings").select(F.col("vec_id").alias("doi"), F.when(F.col("vec_id") % 4 > 0, F.col("embedding")).alias("embedding")), at)
    return spark.read.parquet(at).select("doi", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("failure_file", "SELECT '10.1/s' || s_suppkey AS doi, 'HTTP ' || (400 + s_suppkey % 5) AS reason FROM supplier")
def failure_file(spark, d):
    at = place(spark, "failures")
    sinks.save_failures(table(spark, d, "supplier").select(F.concat(F.lit("10.1/s"), F.col("s_suppkey").cast("string")).alias("doi"), F.concat(F.lit("HTTP "), (F.col("s_suppkey") % 5 + 400).cast("string")).alias("reason")), at)
    return spark.read.schema("doi string, reason string").csv(at, sep="\t")


@query("article_files", f"""WITH {CITED}, r AS (SELECT DISTINCT doc_id, citation_id, unnest(refs) AS num FROM k) SELECT doc_id, 'ref::' || num AS article, count(DISTINCT citation_id) AS citation_count FROM r GROUP BY ALL""")
def article_files(spark, d):
    none = lambda kind: F.lit(None).cast(kind)
    refs = spark.range(0).select(none("bigint").alias("doc_id"), none("int").alias("num"), none("string").alias("doi"), none("string").alias("title"), none("string").alias("raw"))
    at = place(spark, "articles")
    sinks.save_json(ct.by_article(cited(spark, d), refs), at)
    return tables.read_json(spark, at, "doc_id bigint, article string, citation_count bigint", lines=True)


def decoded(files: list[bytes]) -> list[str | None]:
    """A stand-in for a parser of documents: their text as it stands."""
    return [x.decode("utf-8", "replace") or None for x in files]


@query("parsed_chunks", "SELECT doc_id, i AS pos, substring(text, i::INT * 900 + 1, 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(length(text) - 301, 0) // 900 + 1)) AS i FROM documents WHERE text <> '')")
def parsed_chunks(spark, d):
    files = docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content")).where("content is not null")
    rows = providers.parse(files, decoded).where("state = 1")
    return rows.select("doc_id", F.posexplode(md.windows_of(F.col("text"), 1200, 300)).alias("pos", "chunk"))


@query("embedded_names", """WITH w AS (SELECT p_partkey, ('0x' || right(md5(w), 2))::INT % 64 AS slot FROM (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)), n AS (SELECT p_partkey, slot, count(*) AS n FROM w GROUP BY ALL)
SELECT p_partkey, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 6) AS value FROM n""")  # fmt: skip
def embedded_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("content"))
    out = providers.embed(rows, "content", providers.provider(providers.EMBEDDING, "hash"))
    return out.select("p_partkey", F.posexplode("embedding").alias("slot", "value")).where("value > 0").withColumn("value", F.round("value", 6))


@query("simple_answers", "SELECT p_partkey AS query_id, 'You are a careful assistant.' AS system, p_name || ' ' || p_partkey AS human, 'answer ' || left(sha256(p_name || ' ' || p_partkey), 8) AS answer FROM part")
def simple_answers(spark, d):
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("query"))
    return Pipeline(mode="simple").query(asked).select("query_id", "system", "human", "answer")


@query("web_answers", "WITH m AS (SELECT p_partkey AS query_id, 'Answer the question with these search results.' || chr(10) || chr(10) || 'Results:' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'No results.' END || chr(10) || chr(10) || 'Question: ' || p_name AS human FROM part) SELECT query_id, human, 'answer ' || left(sha256(human), 8) AS answer FROM m")
def web_answers(spark, d):
    p = table(spark, d, "part")
    asked = p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    results = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("message"))
    return Pipeline(mode="web").query(asked, results=results).select("query_id", "human", "answer")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return window_counts(table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
