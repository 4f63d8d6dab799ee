"""Knowledge graphs of triplets: filtering, alignment of entities, conditional edges, link prediction, mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_entity
from .graph import adamic_adar

#: Words of an entity at most; the relation of an edge that was predicted.
MOST_WORDS, PREDICTED = 5, "[PREDICTED]"
#: Edges of the domain, which stand where both of their ends do.
DOMAIN = [("S0", "Schwarz Crystal", "is model of"), ("S1", "Schwarz Crystal", "is model of"), ("S4", "Schwarz Crystal", "is model of"), ("Mean Curvature", "Minimal Surface", "defines"), ("Polycrystalline Copper", "Copper", "is form of")]


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def triplets(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, source, target, relation) of mined rows: ends cleaned, of MOST_WORDS words at most and not the same; relations in lower case."""
    x = rows.select(key, clean_entity(F.col("source")).alias("source"), clean_entity(F.col("target")).alias("target"), F.lower(F.trim("relation")).alias("relation"))
    return x.where((words(F.col("source")) <= MOST_WORDS) & (words(F.col("target")) <= MOST_WORDS) & (F.col("source") != F.col("target")))


def entities(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entity): the distinct ends of triplets."""
    return rows.select(key, F.explode(F.array("source", "target")).alias("entity")).distinct()


def aligned(rows: DataFrame, merged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct triplets by the names that merged (key, entity, name) gives their ends; such as join an end to itself go."""
    names = merged.groupBy(key, "entity").agg(F.min(F.trim("name")).alias("name"))
    to = lambda end: names.select(key, F.col("entity").alias(end), F.col("name").alias(f"__{end}"))
    x = rows.join(to("source"), [key, "source"], "left").join(to("target"), [key, "target"], "left")
    x = x.select(key, F.coalesce("__source", F.trim("source")).alias("source"), F.coalesce("__target", F.trim("target")).alias("target"), "relation")
    return x.where("source <> target").distinct()


def domain_edges(rows: DataFrame, key: str = "doc_id", edges: list[tuple[str, str, str]] = DOMAIN) -> DataFrame:
    """The domain's edges of each key both of whose ends are in its triplets."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame(edges, "source string, target string, relation string").select(clean_entity(F.col("source")).alias("source"), clean_entity(F.col("target")).alias("target"), "relation")
    there = entities(rows, key)
    # a handful of literal edges
    out = there.withColumnRenamed("entity", "source").join(F.broadcast(fixed), "source")
    return out.join(there.withColumnRenamed("entity", "target"), [key, "target"], "left_semi").select(key, "source", "target", "relation")


def predicted(rows: DataFrame, top: int = 15) -> DataFrame:
    """(source, target, relation): pairs that triplets don't join, with the most weight of common neighbours."""
    found = adamic_adar(rows.select(F.col("source").alias("source_doi"), F.col("target").alias("target_doi")), top)
    return found.select(F.col("i").alias("source"), F.col("j").alias("target"), F.lit(PREDICTED).alias("relation"))


def graph_tables(rows: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (key, entity, degree) and edges (key, source, target, relations) of triplets, edges without direction and parallels."""
    edges = rows.select(key, F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "relation")
    edges = edges.groupBy(key, "source", "target").agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    nodes = edges.select(key, F.explode(F.array("source", "target")).alias("entity")).groupBy(key, "entity").agg(F.count(F.lit(1)).alias("degree"))
    return nodes, edges


def mined(chunks: DataFrame, provider, key: str = "doc_id") -> DataFrame:
    """(key, path, source, target, relation) that a model names in chunks (key, path, chunk); what isn't a list of triplets gives none."""
    from ..providers import chat

    shape = "array<struct<source:string,target:string,relation:string>>"
    answers = chat(chunks.withColumn("prompt", F.concat(F.lit("Name the triplets of this section as JSON.\nSection: "), "path", F.lit("\n"), "chunk")), "prompt", provider)
    found = F.explode(F.from_json(F.regexp_extract("answer", r"(?s)\[.*\]", 0), shape)).alias("t")
    return answers.select(key, "path", found).select(key, "path", "t.*").where("source is not null and target is not null and relation is not null")
