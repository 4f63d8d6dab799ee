"""Quality of answers: entity matches and F1, specificity, relation strength, edge connectivity and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reachable
from .paths import EXACT, hops, mean_distance
from .retrieval import PLACES, candidates

MATCH, TOP = 0.99, 5


def best_matches(left: DataFrame, right: DataFrame, keys: list[str], top: int = TOP) -> DataFrame:
    """(keys, a, b, sim, rank) of entities (keys, entity, v) within one sample: the `top` most alike; ties to the later entity."""
    # entities that stand in both lists under one name are compared as well
    a = left.select(*keys, F.struct(F.col("entity").alias("a")).alias("query_id"), F.col("v").alias("q"))
    rows = candidates(a, right.select(*keys, F.col("entity").alias("id"), "v"), keys, top, largest=True).select(*keys, "query_id.a", F.col("id").alias("b"), F.round("score", PLACES).alias("sim"))
    rank = F.row_number().over(Window.partitionBy(*keys, "a").orderBy(F.desc("sim"), F.desc("b")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def one_way(left: DataFrame, right: DataFrame, keys: list[str], name: str, threshold: float = MATCH, top: int = TOP) -> DataFrame:
    """(keys, name): the share of left entities with a match on the right: alike beyond the threshold, or equal among the top but for case."""
    hit = best_matches(left, right, keys, top).groupBy(*keys, "a").agg(F.max(((F.col("sim") > threshold) & (F.col("rank") == 1) | (F.lower("a") == F.lower("b"))).cast("int")).alias("hit"))
    rows = left.select(*keys, F.col("entity").alias("a")).join(hit, [*keys, "a"], "left")
    return rows.groupBy(*keys).agg(F.avg(F.coalesce("hit", F.lit(0))).alias(name))


def entity_f1(truth: DataFrame, said: DataFrame, keys: list[str], threshold: float = MATCH) -> DataFrame:
    """(keys, precision, recall, f1), rounded to 4 places; 0 where either side is empty."""
    recall, precision = one_way(truth, said, keys, "recall", threshold), one_way(said, truth, keys, "precision", threshold)
    rows = recall.join(precision, keys, "full")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return rows.select(*keys, F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def mean_score(items: DataFrame, scores: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the mean of scores (keys, item, score) over the distinct items; a missing score is 0."""
    rows = items.select(*keys, "item").distinct().join(scores, [*keys, "item"], "left")
    return rows.groupBy(*keys).agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 4).alias(name))


def edge_connectivity(truth: DataFrame, said: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mec): the share of true edges (keys, a, b) whose ends are connected in the answer's graph."""
    comp = reachable(said, keys)
    ends = truth.join(comp.select(*keys, F.col("node").alias("a"), F.col("component").alias("ca")).hint("merge"), [*keys, "a"], "left").join(comp.select(*keys, F.col("node").alias("b"), F.col("component").alias("cb")).hint("merge"), [*keys, "b"], "left")
    return ends.groupBy(*keys).agg(F.round(F.avg(F.coalesce((F.col("ca") == F.col("cb")).cast("int"), F.lit(0))), 4).alias("mec"))


def edge_distance(truth: DataFrame, said: DataFrame, keys: list[str], exact: int = EXACT) -> DataFrame:
    """(keys, med): the mean over true edges of hops in the answer's graph, relative to the mean path of its largest component.

    Ends that aren't there or aren't connected count as the number of its nodes, at least 2, and so do edges to themselves.
    Only the ends of true edges are searched from. The mean path is exact for components of up to `exact` nodes.
    """
    far = hops(said, keys, truth)
    comp = reachable(said, keys)
    size = comp.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)), F.lit(2)).alias("penalty"))
    largest = comp.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.max(F.struct("c", "component"))["component"].alias("component"))
    inside = comp.join(largest, [*keys, "component"], "left_semi").select(*keys, F.col("node").alias("a"))
    mean = mean_distance(said.join(inside, [*keys, "a"], "left_semi"), keys, exact)
    rows = truth.join(far, [*keys, "a", "b"], "left").join(size, keys, "left").join(mean, keys, "left")
    d = F.coalesce(F.col("dist").cast("double"), F.col("penalty").cast("double"), F.lit(2.0))
    return rows.groupBy(*keys).agg(F.round(F.avg(F.try_divide(d, F.coalesce("mean", F.lit(1.0)))), 4).alias("med"))


def run_metrics(scores: DataFrame) -> DataFrame:
    """(pipeline, metric, value) of scores (pipeline, metric, question, value): means, a missing value as 0."""
    return scores.groupBy("pipeline", "metric").agg(F.round(F.avg(F.coalesce("value", F.lit(0.0))), 6).alias("value"))
