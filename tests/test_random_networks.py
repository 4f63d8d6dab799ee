"""Networks whose papers cite at random: what papers have goes to few tasks, narrow, and papers are never gathered at the driver."""

import random

from pyspark.sql import functions as F

from quillspark.functions import vector
from quillspark.operators import features, graph
from quillspark.plans import graph_queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_that_papers_share_are_held_once(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 3)
    held = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [0.0, 0.0]), (9, [1.0, 1.0])], "key long, v array<float>")
    keys = spark.createDataFrame([(d, d % 6) for d in range(20)] + [(20, None)], "doi long, v long")
    rng = random.Random(3)
    pairs = spark.createDataFrame(sorted({(rng.randint(0, 22), rng.randint(0, 22)) for _ in range(200)}), "i long, j long")
    own = keys.withColumnRenamed("v", "key").join(held, "key").select("doi", "v")
    want = pairs.join(own.toDF("i", "vi"), "i", "left").join(own.toDF("j", "vj"), "j", "left").select("i", "j", F.round(vector.cosine(F.col("vi"), F.col("vj")), 9).alias("x"))
    got = features.semantic(pairs, keys, "x", held)
    assert sorted(map(str, got.select("i", "j", F.round("x", 9).alias("x")).collect())) == sorted(map(str, want.collect()))
    none = features.semantic(pairs, keys, "x", held.limit(0))
    assert none.where("x is not null").count() == 0 and none.count() == pairs.count()


def test_lists_go_narrow_where_their_numbers_fit(spark):
    rows = spark.createDataFrame([(1, [5, -7]), (2, [2**40, 5]), (3, None), (4, [-(2**31), 2**31 - 1])], "doi long, m array<long>")
    out = rows.select("doi", *features.narrowed("m")).orderBy("doi")
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "array<int>", "array<bigint>"]
    assert [tuple(r)[1:] for r in out.collect()] == [([5, -7], None), (None, [2**40, 5]), (None, None), ([-(2**31), 2**31 - 1], None)]
    pairs = spark.createDataFrame([(1, 2), (2, 4), (1, 3), (4, 1)], "i long, j long")
    assert {(r.i, r.j): r.common_m for r in features.meet(pairs, [rows], ("m",)).collect()} == {(1, 2): 1, (2, 4): 0, (1, 3): None, (4, 1): 0}


def test_papers_are_not_gathered_at_the_driver(spark):
    folder = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{folder}/part.parquet").select(F.col("p_partkey").alias("doi"))
    edges = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("doi"))
    assert "Broadcast" not in plan_of(features.cited_local(part, edges))
    nodes = part.withColumn("ord", F.col("doi"))
    assert "Broadcast" not in plan_of(graph.load_graph(nodes, edges.toDF("source_doi", "target_doi"))[1])
    assert "Broadcast" not in plan_of(graph_queries.authors(spark, folder))
