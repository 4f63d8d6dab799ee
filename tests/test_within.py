"""Texts of one key inside one another, in one task where the key is small, by their pieces where it is large."""

import random

import pytest

from quillspark.operators import matching


@pytest.mark.parametrize("chars,tried", [(1 << 19, 1 << 21), (60, 1 << 21), (1 << 19, 12)])
def test_texts_of_small_keys_meet_uncut(spark, monkeypatch, chars, tried):
    cut, was = [], matching.grams
    monkeypatch.setattr(matching, "grams", lambda c, q: cut.append(q) or was(c, q))
    monkeypatch.setattr(matching, "CHARS", chars)
    monkeypatch.setattr(matching, "TRIED", tried)
    monkeypatch.setattr(matching, "BUNDLE", 50)
    rng = random.Random(2)
    text = lambda: "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
    asked = sorted({(k, text()) for k in range(5) for _ in range(2 + 3 * k)})
    known = sorted({(k, t): p for p, (k, t) in enumerate((k, text()) for k in range(1, 6) for _ in range(2 + 2 * k))}.items())
    want = {}
    for k, a in asked:
        at = [p for (q, t), p in known if q == k and (t in a or a in t)]
        if at:
            want[k, a] = min(at)
    found = matching.within(spark.createDataFrame(asked, "k long, norm string"), spark.createDataFrame([(k, t, p) for (k, t), p in known], "k long, rnorm string, ref_pos int"), "k")
    assert want and {(r.k, r.norm): r.ref_pos for r in found.collect()} == want and found.count() == len(want)
    assert bool(cut) == ((chars, tried) != (1 << 19, 1 << 21))
