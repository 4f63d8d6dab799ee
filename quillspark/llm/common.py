"""What the operators of this package share: scratch tables, row numbers, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, and what Spark says where nobody has set them.
BATCH_BYTES, DEFAULT_BATCH = 4 << 20, "67108864b"
#: Narrow rows of a file of a small table.
FILE_ROWS = 8192


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, which only a local session (tests, bench) may have, a temporary folder is made
    and set; a cluster without the setting is an error, as its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        found = "file://" + tempfile.mkdtemp(prefix="quill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folders, each in the one before, in which a thread or task makes scratch tables at present.
_inside: ContextVar[tuple[str, ...]] = ContextVar("quill_inside", default=())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return "/".join([shared_dir(spark), *_inside.get(), f"quill-{name}-{uuid.uuid4().hex}"])


@contextmanager
def passing(spark: SparkSession, name: str):
    """Scratch tables made in here are deleted at the end, when what was to be made of them is a table elsewhere."""
    at = scratch(spark, name)
    token = _inside.set((*_inside.get(), at.rsplit("/", 1)[1]))
    try:
        yield
    finally:
        _inside.reset(token)
        delete(spark, at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, path: str | None = None, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, kept when executors go, with a short lineage.

    Where about how many rows it has is known, it has a file for each FILE_ROWS of them at most, as a
    file costs more than many rows.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quill_path = path
    return out


def done(*tables: DataFrame) -> None:
    """Deletes tables that written() gave, of which no more is to be read: what was made of them is a table by now."""
    for t in tables:
        if path := getattr(t, "quill_path", None):
            delete(t.sparkSession, path)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has a bound of its own.

    A batch stands several times over in a task, in the JVM and in Python, and long texts make the
    default bound of 64 MB a large part of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sums_before(rows: DataFrame, keys: list[str], n: str, name: str, count: int | None = None) -> DataFrame:
    """rows, one for each value of the keys, with the sum of n over all rows of smaller keys, nulls last, as `name`; a table.

    Rows are dealt to ranges of the keys; a range is summed up by itself and shifted by the totals of those before
    it, a table of as many rows as there are ranges. No step sees all rows in one task. count is about how many rows there are.
    """
    order = [F.col(c).asc_nulls_last() for c in keys]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    dealt = written(dealt, "sums-ranges", rows=count)
    dealt_by = dealt.withColumn("__range", F.shiftright("__id", 33))
    until = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = dealt_by.groupBy("__range").agg(F.sum(n).alias("__total"))
    totals = totals.select(F.col("__range").alias("__of"), until(Window.orderBy("__range"), "__total").alias("__shift"))
    inside = dealt_by.withColumn("__i", until(Window.partitionBy("__range").orderBy("__id"), n))
    out = inside.join(totals, F.col("__range") == F.col("__of")).withColumn(name, F.col("__i") + F.col("__shift"))
    out = written(out.select(*rows.columns, name), "sums", rows=count)
    done(dealt)
    return out


def numbered(df: DataFrame, name: str, leading: list[str] = (), seed: int = 0) -> DataFrame:
    """df with gapless row numbers from 0 in column `name`, in a fixed pseudo-random order; a table in the shared folder.

    The order is by `leading`, then by a hash of the whole row, then by the row itself, so it depends on
    the rows alone. Equal rows are counted before the shuffle, numbered as one run and expanded after it:
    they never meet in one task. Rows are dealt to buckets of the hash of about sqrt(rows) each; a bucket
    is numbered by itself and shifted by the rows of the buckets before it, a table of about sqrt(rows)
    entries and as many as `leading` has values, which is summed up by ranges then. No step sees all rows in one task.
    """
    cols = df.columns
    at = F.xxhash64(F.lit(seed), *cols)
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", at)
    rows = table = written(rows, "numbered")
    total = rows.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("t")).first()["t"]
    sizes = max(16, int(total**0.5))
    groups = rows.groupBy(*leading).agg(F.count(F.lit(1)).alias("__g")) if leading else rows.agg(F.count(F.lit(1)).alias("__g"))
    groups = groups.withColumn("__b", F.ceil(F.col("__g") / sizes)).drop("__g")
    if leading:
        rows = matched(rows, groups, leading)
    else:
        rows = rows.withColumn("__b", F.lit(max(1, -(-total // sizes))).cast("long"))
    # the upper 32 bits of the hash, scaled to 0 .. __b - 1: buckets follow the order of the hash
    upper = F.shiftrightunsigned(F.col("__h"), 32)
    rows = rows.withColumn("__k", F.floor(upper * F.col("__b") / F.lit(2.0**32)).cast("long")).drop("__b")
    keys = [*leading, "__k"]
    counts = rows.groupBy(*keys).agg(F.sum("__n").alias("__c"))
    if leading:
        buckets = groups.agg(F.coalesce(F.sum("__b"), F.lit(0)).alias("b")).first()["b"]
        sums = counts = sums_before(counts, keys, "__c", "__o", buckets)
        counts = counts.drop("__c")
    else:
        before = Window.orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    inside = Window.partitionBy(*keys).orderBy(unsigned(F.col("__h")), *cols).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__i", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    out = matched(rows, counts, keys).select(*cols, "__n", (F.col("__i") + F.col("__o")).alias("__f"))
    one = F.explode(F.sequence(F.col("__f"), F.col("__f") + F.col("__n") - 1))
    out = written(out.select(*cols, one.alias(name)), "numbered")
    done(table, *([sums] if leading else []))
    return out


def matched(rows: DataFrame, more: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of `more`, which has one row for each value of the keys; null equals null."""
    other = more.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(keys)], *[c for c in more.columns if c not in keys])
    on = F.lit(True)
    for i, c in enumerate(keys):
        on &= F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return rows.join(other, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can meet another that comes from the same table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def shielded(df: DataFrame, *names: str):
    """df with columns whose names begin with two underscores, which are the operators' own, called otherwise.

    With it come the names given, as they are now, and a function that gives a table its names back.
    """
    new = {c: f"own_{i}{c}" for i, c in enumerate(df.columns) if c.startswith("__")}
    back = lambda out: out.withColumnsRenamed({now: was for was, now in new.items() if now in out.columns}) if new else out
    return df.withColumnsRenamed(new) if new else df, [new.get(n, n) for n in names], back


def unsigned(h: Column) -> Column:
    """A key that sorts longs as unsigned numbers."""
    return h.bitwiseXOR(F.lit(-(2**63)))


def uniform(*of: Column, seed: int) -> Column:
    """A number of [0, 1) that depends on the arguments alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) * F.lit(2.0**-53)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: one row (node, component) per node of an edge.

    component is the smallest node reachable. Alternating large-star and small-star rounds
    (Kiveris et al. 2014): each links nodes to the smallest of their neighbours by a grouped minimum
    and a join, until nothing changes; rounds grow with the logarithm of the longest path. Every round
    is a table in the shared folder, and so is what stands above each node, so that a join can split
    the many edges below one node among tasks. Null ends and loops are dropped; no edges give no rows.
    """

    def table(e: DataFrame, rows: int | None = None) -> tuple[DataFrame, dict]:
        seen = Observation()
        said = e.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        return written(said, "edges", rows=rows), seen.get

    at, seen = table(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")))
    for _ in range(rounds):
        if not seen["n"]:
            break
        # a is the larger end: what stands over a goes to the least that stands over b, if anything does
        above = written(at.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("g")), "edges-above", rows=seen["n"])
        large = at.join(above, F.col("b") == F.col("u"), "left").select("a", F.coalesce("g", "b").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = fresh(large).join(least, F.col("a") == F.col("u")).select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b")
        was, before = at, seen
        at, seen = table(small, seen["n"])
        done(was, above)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    roots = at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
