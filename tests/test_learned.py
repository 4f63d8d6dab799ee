"""The learned edge classifier against an independent fit."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators.learned import PENALTY, LearnedClassifier, confusion, is_held_out

FEATURES = ["a", "b", "c"]


def edges(n=600):
    rng, rows = random.Random(10), []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.random() * 5
        c = None if rng.random() < 0.3 else float("nan") if rng.random() < 0.05 else rng.gauss(2, 3)
        score = a + (0.5 if c is None or c != c else 0.2 * c) + rng.gauss(0, 0.5)
        rows.append((f"i{i}", f"j{i % 7}", a, b, c, None if i % 50 == 0 else "high" if score > 1 else "low" if score < -0.3 else "middle"))
    return rows


def independent(x, y, k):
    """Multinomial logistic regression by gradient steps on standardised columns; weights on the columns as they are."""
    s = x.std(axis=0, ddof=1)
    z, t = (x - x.mean(axis=0)) / s, np.eye(k)[y]
    w, b = np.zeros((k, x.shape[1])), np.zeros(k)
    for _ in range(20_000):
        p = np.exp(z @ w.T + b)
        p /= p.sum(1, keepdims=True)
        g = (p - t).T @ z / len(x) + PENALTY * w
        w, b = w - 0.5 * g, b - 0.5 * (p - t).mean(axis=0)
    w = w / s
    b = b - w @ x.mean(axis=0)
    return w - w.mean(axis=0), b - b.mean()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(edges(), "i string, j string, a double, b double, c double, label string").withColumn("held_out", is_held_out("i", "j"))


def test_weights_of_an_independent_fit(spark, rows, tmp_path):
    LearnedClassifier.fit(rows.where("not held_out"), FEATURES).save(f"file://{tmp_path}/model")
    model = LearnedClassifier.load(spark, f"file://{tmp_path}/model")
    assert model.labels == ["high", "low", "middle"]
    own = [r for r in rows.collect() if not r.held_out and r.label]
    x = np.array([[0.0 if v is None or v != v else v for v in (r.a, r.b, r.c)] + [float(v is None or v != v) for v in (r.a, r.b, r.c)] for r in own])
    live = x.std(axis=0) > 0
    w, b = independent(x[:, live], np.array([["high", "low", "middle"].index(r.label) for r in own]), 3)
    got = {(r.label, r.feature, r.missing): r.weight for r in model.weights(spark).collect()}
    for y, name in enumerate(["high", "low", "middle"]):
        line = [got[name, f, m] for m in (False, True) for f in FEATURES]
        assert np.array(line)[live] == pytest.approx(w[y], abs=2e-3) and got[name, None, None] == pytest.approx(b[y], abs=2e-3)
        assert not np.array(line)[~live].any()


def test_held_out_edges(spark, rows):
    model = LearnedClassifier.fit(rows.where("not held_out"), FEATURES)
    found = confusion(rows, model).where("held_out and label is not null").collect()
    assert sum(r.edges for r in found if r.label == r.predicted) > 0.7 * sum(r.edges for r in found) > 60
    out = model(rows.withColumn("tier", F.lit("old")))
    assert out.count() == rows.count() and out.where("label is null or tier = 'old' or probability < 0.33").count() == 0
    unseen = rows.limit(3).select("i", "j", *[F.lit(None).cast("double").alias(f) for f in FEATURES])
    assert model(unseen).where("label is not null").count() == 3 and model(unseen.limit(0)).count() == 0
