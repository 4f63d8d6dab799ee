"""Likeness of texts by bounds and a matcher, against the matcher alone."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.operators import markdown


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def near(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.randrange(3)] = rng.choice(["", "x", "é𝒳", "ab"])
    return "".join(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["grain", "boundary", "of", "the", "minimal", "surface", "é", "𝒳𝒴", "ab", "aaaa"]
    pairs = [(None, None), (None, "a"), ("a", None), ("", ""), ("", "a"), ("a", ""), ("ab" * 200, "ab" * 200), ("ab" * 200, "ba" * 200), ("abc", "cba")]
    for _ in range(400):
        a = " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 30, 60])))
        b = near(rng, a, rng.choice([0, 1, 3, 10, 40])) if rng.random() < 0.7 else " ".join(rng.sample(words, 5))
        pairs += [(a, b), (b, a)]
    return pairs


@pytest.mark.parametrize("least", [0.0, 0.7, 0.85, 1.0])
def test_alike(spark, texts, least):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "i long, a string, b string")
    got = {r.i: r.same for r in markdown.with_alike(rows, "same", F.upper("a"), F.upper("b"), least).collect()}
    assert got == {i: None if a is None or b is None else ratio(a.upper(), b.upper()) > least for i, (a, b) in enumerate(texts)}


def test_bounds_decide(spark, texts):
    rows = spark.createDataFrame(texts, "a string, b string")
    got = rows.select("a", "b", markdown._bounded(F.col("a"), F.col("b"), 0.85).alias("x")).select("a", "b", "x.sure", F.col("x.a").alias("open")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.sure is None and r.open is None
        elif r.sure is None:
            assert r.open == r.a and r.a != r.b
        else:
            assert r.open is None and r.sure == (ratio(r.a, r.b) > 0.85)
    assert sum(r.sure is not None for r in got) > len(got) / 3


def test_is_title_measures_what_is_written(spark):
    """The lengths of the chunk and the title as they are written must be near, not those of their normal forms."""
    cases = [("# On Grain Boundaries!", "On grain boundaries", True), ("############ On grain boundaries", "On grain boundaries", False), ("On grain", None, False), (None, "x", False), ("# -", "!", True), ("Other words", "On grain", False)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "chunk string, title string")
    assert [r.t for r in markdown.with_title(rows, "t", F.col("chunk"), F.col("title")).collect()] == [c[2] for c in cases]


def test_title_comes_first(spark):
    """The matcher compares the title with the chunk, which isn't the same the other way round."""
    title, chunk = "tide", "diet"
    one, other = ratio(title, chunk), ratio(chunk, title)
    assert one != other
    rows = spark.createDataFrame([(chunk, title), (title, chunk)], "chunk string, title string")
    got = markdown.with_title(rows, "t", F.col("chunk"), F.col("title"), least=(one + other) / 2).collect()
    assert [r.t for r in got] == [one > other, other > one]
