"""Operator 1, sharding: a Feistel permutation with cycle walking over global row numbers.

Row r of n goes to place P(r), and place p is slot p div k of shard p mod k. P is a permutation of
0 .. n - 1, so shards differ by one row at most and slots have no gaps, and P is computed from r, n and
the seed alone: where any row goes can be told without the others. Built-in functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, shielded

ROUNDS, WALKS = 6, 64


def feistel(x: Column, n: int, seed: int) -> Column:
    """The place of x in a permutation of 0 .. n - 1 (x: a long of that range).

    A Feistel network over pairs (left, right) of 0 .. a-1 and 0 .. b-1 with a * b >= n, whose rounds add
    a hash of one half to the other by turns; what falls outside 0 .. n - 1 walks on along its cycle.
    Less than a of the a * b pairs lie outside: for n up to 4096 at most WALKS steps are ever needed, and
    beyond, a walk as long has a chance under 2^-384, and would raise an error.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    keys = F.array(*[F.lit(seed * 1000 + i).cast("long") for i in range(ROUNDS)])

    def turn(s: Column, k: Column) -> Column:
        left = F.when(k % 2 == 0, (s["l"] + F.pmod(F.xxhash64(k, s["r"]), F.lit(a))) % a).otherwise(s["l"])
        right = F.when(k % 2 == 0, s["r"]).otherwise((s["r"] + F.pmod(F.xxhash64(k, s["l"]), F.lit(b))) % b)
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def once(v: Column) -> Column:
        halves = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(keys, halves, turn, lambda s: s["l"] * b + s["r"])

    first = F.aggregate(F.array(F.lit(0)), x.cast("long"), lambda v, _: once(v))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("feistel: the walk is too long")).cast("long"))


def shard_rows(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """df with long `row` (its global number), `place`, `slot` and int `shard`.

    The rows alone decide: reruns and other partitionings give the same multiset of rows. Equal rows take
    places of their own. Nulls are values like others; an empty table gives no rows. The four columns
    replace columns of their names.
    """
    df, _, back = shielded(df.drop("row", "place", "slot", "shard"))
    rows = numbered(df, "row", seed=seed)
    n = rows.count()
    out = back(rows).withColumn("place", feistel(F.col("row"), n, seed))
    return out.withColumn("shard", F.pmod(F.col("place"), F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return shard_rows(rows, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "place")
