"""A corpus from documents in five stages, each one operator of quillspark.llm.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs; all but
the last return the columns of documents, whatever else docs has. An empty table gives an empty one; nulls,
empty and very long texts, and repeated rows are what the stages' own descriptions say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, jaccard, mixing, substring, toxicity
from quillspark.llm.common import done, matched, n_words, passing, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on the labelled ones among docs.

    Without labels of both classes all stay. A null text is judged as an empty one, rows each by itself.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity of 0.75 or more) the smallest doc_id stays.

    One row of each group stays, also where doc_ids repeat or are null: a null one counts as the largest, and
    of rows with the smallest one that with the least hash stays. Texts without words are in no group.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row"), F.xxhash64(*COLUMNS).alias("__hash")), "pipeline-rows")
    found = jaccard.similar(rows, key="__row").select(F.col("__row").alias("row"), F.col("component_id").alias("group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__hash").alias("hash"), F.col("__row").alias("row"))
    found = written(rows.select("__row", order.alias("order")).join(found, F.col("__row") == F.col("row")).select("group", "row", "order"), "pipeline-groups")
    best = found.groupBy("group").agg(F.min("order")["row"].alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = matched(found.select("group", "row"), best, ["group"]).where("row <> best").select(F.col("row").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document has go from later ones; texts that lose nothing stay as they are, null ones too.

    A text all of whose words go is an empty one. Rows of one doc_id are no earlier documents of each other, rows
    without one come last.
    """
    out = substring.dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it, up to three times, or not at all.

    Rows of one doc_id are told apart by a hash of the whole row; equal rows are given as often as the mix
    takes them all together.
    """
    row = F.xxhash64(*COLUMNS).alias("__hash")
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row)
    taken = mixing.mix(sizes).groupBy("doc_id", "__hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    taken = written(taken, "pipeline-taken")
    docs, keys = docs.select(*COLUMNS, row), ["doc_id", "__hash"]
    rows = matched(docs, taken.where("n = 1").drop("n"), keys)
    if taken.where("n > 1").limit(1).count():
        rows = rows.unionByName(matched(docs, taken.where("n > 1").drop("n"), keys).dropDuplicates(keys))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each text and the digests of its ids and of the text decoded from them; a null text has none."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"), full=False)


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("substring_repeats", repeats), ("mixing", mixed), ("bpe", encoded)]

#: SQL can't express the learned model, the random mix or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is a table in the shared folder before the next begins, and what it was made of goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path, was = scratch(spark, f"pipeline-{name}"), docs
        with passing(spark, name):
            docs = written(stage(spark, docs, sf_dir), name, path)
        done(was)
    return STAGES[-1][1](spark, docs, sf_dir)
