"""Sets and vectors of numbered papers that meet in blocks, against the same by hand and pair by pair."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import vector
from quillspark.operators import features


@pytest.mark.parametrize("small,block,share", [(256, 4096, 1 << 18), (6, 2, 3), (0, 1, 1)])
def test_numbered_sets_meet_in_blocks(spark, monkeypatch, small, block, share):
    for name, value in (("SMALL", small), ("BLOCK", block), ("SHARE", share), ("LOOKED_UP", 7)):
        monkeypatch.setattr(features, name, value)
    rng = random.Random(5)
    sets = {o: {rng.randint(-9, 2**40) if rng.random() < 0.1 else rng.randint(0, 20) for _ in range(rng.randint(1, 15))} for o in (-3, 0, 1, 5, 2**33)}
    rows = spark.createDataFrame([(o, m) for o, ms in sets.items() for m in ms], "owner long, member long")
    pairs = [(i, j) for i in [*sets, 7] for j in [*sets, 7] if i != j]
    found = features.overlap(spark.createDataFrame(pairs, "i long, j long"), rows).collect()
    assert len(found) == len(pairs)
    for r in found:
        a, b = sets.get(r.i), sets.get(r.j)
        assert (r.ni, r.nj, r.common) == (a and len(a), b and len(b), len(a & b) if a and b else None)


def test_numbered_vectors_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 3)
    held = {1: [1.0, 2.0], 2: [0.5, -1.0], 3: [0.0, 0.0], 4: None, 5: [1.0, None], 6: [1.0, 2.0, 3.0], 7: [], 8: [float("nan"), 1.0]}
    vectors = spark.createDataFrame(list(held.items()), "doi long, v array<float>")
    pairs = spark.createDataFrame([(i, j) for i in range(1, 10) for j in range(1, 10) if i != j], "i long, j long")
    a, b = vectors.toDF("i", "vi"), vectors.toDF("j", "vj")
    want = pairs.join(a, "i", "left").join(b, "j", "left").select("i", "j", F.round(vector.cosine(F.col("vi"), F.col("vj")), 9).alias("x"))
    got = features.semantic(pairs, vectors, "x").select("i", "j", F.round("x", 9).alias("x"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
