"""References against records by brute force: most words in common, texts inside one another, titles."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import matching


def words(rng, n):
    return [rng.choice("the of in and on a".split()) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.5)) % 200}" for _ in range(n)]


def brute(refs, titles, letters=1):
    form = lambda t: {w for w in re.sub(r"[^a-z0-9 ]", " ", t.lower()).split() if len(w) >= letters}
    own, held = {}, {}
    for k, t in refs:
        own.setdefault(k, set()).update(form(t))
    for k, t in titles:
        held.setdefault(k, set()).update(form(t))
    out = {}
    for k, w in own.items():
        less, doi = min(((-len(w & t), d) for d, t in held.items()), default=(0, None))
        out[k] = (doi, -less) if less else (None, None)
    return out


def test_best_overlap(spark):
    rng = random.Random(8)
    titles = [(i, " ".join(words(rng, rng.randint(0, 12)))) for i in range(400)] + [(1000, "the of in and on a"), (1001, "the of in and on a")]
    refs = [(i, " ".join(words(rng, rng.randint(0, 14)))) for i in range(300)] + [(500 + i, " ".join(["the of", "of and a", "in", "zzz", ""][i % 5].split())) for i in range(50)]
    a, b = spark.createDataFrame(refs, "key long, text string"), spark.createDataFrame(titles, "doi long, title string")
    want = brute(refs, titles)
    assert {r.key: (r.doi, r.shared) for r in matching.best_record(a, b, "key", letters=1).collect()} == want
    split = lambda t, n: t.select(t[0], matching.words_of(t[1], 1).alias("words")).toDF(n, "words")
    for rounds in ((1, 4, 16, None), (None,)):
        got = {r.key: (r.doi, r.shared) for r in matching.best_overlap(split(a, "key"), split(b, "doi"), rounds).collect()}
        assert got == {k: v for k, v in want.items() if v[0] is not None}
    assert matching.best_record(a, b.limit(0), "key").where("doi is not null").count() == matching.best_record(a.limit(0), b, "key").count() == 0


def test_common_words_are_not_looked_up(spark, monkeypatch):
    """Every text has one word in common and one of its own: no pair of texts meets by the common one."""
    tables, n = {}, 500
    was = matching.written

    def seen(df, name):
        out = was(df, name)
        tables.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(matching, "written", seen)
    refs = spark.createDataFrame([(i, f"common own{i}") for i in range(n)], "key long, text string")
    titles = spark.createDataFrame([(i, f"own{i} common common") for i in range(n)], "doi long, title string")
    got = matching.best_record(refs, titles, "key").collect()
    assert all((r.doi, r.shared) == (r.key, 2) for r in got) and len(got) == n
    assert sum(t.count() for t in tables["overlap-open"]) <= n


def test_contained(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    outer = {(k, text(rng.randint(1, 40))) for k in range(3) for _ in range(40)} | {(0, ""), (1, "x" * 500)}
    inner = {(k, text(rng.randint(1, 14))) for k in range(3) for _ in range(40)} | {(0, ""), (1, "x" * 9), (1, "x"), (2, "zz"), (9, "ab")} | {(k, t[3:-3]) for k, t in outer if len(t) > 12}
    got = matching.contained(spark.createDataFrame(sorted(outer), "k int, outer string"), spark.createDataFrame(sorted(inner), "k int, inner string"), ["k"])
    assert sorted((r.k, r.outer, r.inner) for r in got.collect()) == sorted((k, a, b) for k, a in outer for j, b in inner if j == k and a and b and b in a)


def test_match_titles(spark):
    refs = [(1, 0, "Smith, A study of things, 2001", "A study"), (1, 1, "SMITH: a study of things. 2001", "Same"), (1, 2, "Jones, Other work", None), (1, 3, "things", "Short"), (2, 0, "Alone", "Two")]
    raws = [(1, "Smith, A study of things, 2001"), (1, "smith a study of THINGS 2001"), (1, "[4] Jones, Other work, p. 4"), (1, "all things"), (1, "ing"), (1, "nothing of it"), (1, "?!"), (2, "Smith, A study of things, 2001"), (2, "alone"), (2, "alone")]
    a, b = spark.createDataFrame(raws, "doc_id int, raw string"), spark.createDataFrame(refs, "doc_id int, ref_pos int, text string, title string")
    tiers = {(r.doc_id, r.raw): (r.ref_pos, r.tier) for r in matching.resolve_references(a, b).collect()}
    assert tiers == {
        (1, raws[0][1]): (0, 1), (1, raws[1][1]): (0, 2), (1, raws[2][1]): (2, 3), (1, "all things"): (3, 3), (1, "ing"): (0, 3),
        (1, "nothing of it"): (None, None), (1, "?!"): (None, None), (2, raws[0][1]): (None, None), (2, "alone"): (0, 2),
    }
    titles = {(r.doc_id, r.raw): r.title for r in matching.match_titles(a, b).collect()}
    assert titles[1, raws[0][1]] == titles[1, raws[1][1]] == titles[1, "ing"] == "A study" and titles[1, raws[2][1]] is None and titles[2, "alone"] == "Two" and len(titles) == 9


def test_pieces_of_long_texts_go_without_the_text(spark, monkeypatch):
    """A text's pieces are cut in parts and looked up by its number: none of the tables of pieces holds texts."""
    monkeypatch.setattr(matching, "CUT", 5, raising=False)
    kept, written = {}, matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    text = "abcdefghäöü-" * 30 + "xyz" + "q" * 40
    outer = spark.createDataFrame([(1, text), (1, "abc"), (2, text)], "k int, outer string")
    inner = spark.createDataFrame([(1, "hhh"), (1, "äöü-abcdefghäöü"), (1, "c"), (1, "xyzqqq"), (2, "zq"), (2, "nowhere in it")], "k int, inner string")
    got = {(r.k, len(r.outer), r.inner) for r in matching.contained(outer, inner, ["k"]).collect()}
    assert got == {(1, len(text), "äöü-abcdefghäöü"), (1, len(text), "c"), (1, 3, "c"), (1, len(text), "xyzqqq"), (2, len(text), "zq")}
    assert kept["grams"].count() and all(f.dataType.typeName() != "string" for f in kept["grams"].schema.fields)
    for q in (1, 5, 8):
        assert set(spark.range(1).select(matching.grams(F.lit(text), q)).first()[0]) == {text[i : i + q] for i in range(len(text) - q + 1)}
