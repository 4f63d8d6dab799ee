"""Operators 11 to 13 against brute force, round trips and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chat, clustering, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- Merkle manifest


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, as the contract says."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """The last node, and each leaf's steps."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for i, p in enumerate(at):
                run = runs[p // 16]
                steps[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            nodes, at = [H("".join(run)) for run in runs], [p // 16 for p in at]
        return nodes[0], steps

    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    below = []
    for s in names:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        below.append((own, *climb([leaf(r, r[1]) for r in own])))
    if not below:
        return []
    root, above = climb([b[1] for b in below])
    out = []
    for (own, subroot, steps), more in zip(below, above, strict=True):
        for r, mine in zip(own, steps, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf(r, lower(r[1]) if hit else r[1])
            for a, b in mine + more:
                fold = H(a + fold + b)
            out.append((r[0], leaf(r, r[1]), subroot, root, H("".join(a + b for a, b in mine + more)), fold, fold == root))
    return out


def documents(counts):
    rng, rows, i = random.Random(11), [], 0
    for s, n in counts.items():
        for _ in range(n):
            rows.append((i, rng.choice([None, "", "Ab c", "lower é🙂", "X" * 3000, f"Text {i}"]), rng.choice(["en", None]), s, rng.choice([None, i])))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "rows",
    [documents({"a": 1}), documents({"b": 17, None: 16, "": 2, "B": 1, "é": 3}), documents({f"s{i}": 1 + i % 3 for i in range(40)} | {"hot": 300})]
    + [[(None, "A", "en", None, 1)] * 3 + [(5, "B", None, "s", None)] * 20 + [(5, "C", None, "s", None), (None, "D", None, "s", 2)], []],
    ids=["one", "borders", "many", "repeated", "none"],
)
def test_op11_query(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit("x")).withColumn("steps", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(by_hand(rows))


def test_places_in_many_ranges(spark):
    rows = spark.range(3000).select(F.concat(F.lit("="), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string"))).alias("tree"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("k"))
    rows.write.parquet(path := merkle.scratch(spark, "places"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out = merkle.placed(spark.read.parquet(path), ["k"], "places").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tree in {r.tree for r in out}:
        own = sorted((r for r in out if r.tree == tree), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.k is None or -1 for r in own] == sorted((r.k is None or -1 for r in own), reverse=True) and [r.k for r in own if r.k is not None] == sorted(r.k for r in own if r.k is not None)


def test_manifest_is_opened_by_a_later_job(spark, tmp_path):
    rows = documents({"a": 40, "b": 3, None: 1})
    made = merkle.manifest(spark.createDataFrame(rows, DOCS), ["doc_id", "text"], path=f"file://{tmp_path}/m")
    again = merkle.opened(spark, f"file://{tmp_path}/m")
    assert again.root == made.root and len(again.levels) == len(made.levels) == 3
    proofs = again.proofs().select(merkle.folded(F.col("digest"), F.col("steps")).alias("root")).distinct().collect()
    assert [r.root for r in proofs] == [made.root]
    assert merkle.manifest(spark.createDataFrame([], DOCS), ["doc_id", "text"]).root is None


# ---- clusters


def kmeans(vectors, d=64, k=16, rounds=3):
    """As the contract says, in Python's integers."""
    floor = lambda x: int(np.floor(np.float64(x) * 64))
    kept = [(i, [floor(x) for x in v]) for i, v in vectors if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, H(f"1:{r[0]}"), r[1]))[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [[] for _ in centroids]
        for _, v in kept:
            own[near(v)].append(v)
        centroids = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centroids, strict=True)]
    found = [(i, (c := near(v)), far(v, centroids[c])) for i, v in kept]
    sums = Counter()
    for _, c, x in found:
        sums[c] += x
    fits = lambda x: x if x < 2**63 else None
    large = {c for _, c, x in found if x >= 2**63}
    return Counter((i, c, fits(x), None if c in large else fits(sums[c]), None if large else fits(sum(sums.values())), H(",".join(map(str, centroids[c])))) for i, c, x in found)


def vectors(case):
    rng = np.random.default_rng(5)
    if case == "plain":
        base = rng.normal(size=(20, 64)) * np.linspace(0.05, 1, 64)
        return [(i, (base[i % 20] + rng.normal(size=64) * 0.1).tolist()) for i in range(300)]
    if case == "ties":
        return [(i, [float(i % 3)] * 64) for i in range(40)] + [(i % 5, [0.5, -0.25] * 32) for i in range(60)]
    if case == "odd":
        ok = [(i, rng.normal(size=64).tolist()) for i in range(30)]
        return ok + [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63), (None, [0.25] * 64), (None, [-0.25] * 64)]
    if case == "few":
        return [(7, [0.1] * 64), (9, [-3.7] * 64), (None, [1.0] * 64)]
    if case == "wide":
        return [(i, (rng.normal(size=64) * 10.0 ** rng.integers(-2, 9)).tolist()) for i in range(80)] + [(1000, [1e30] * 64), (1001, [-1e200] + [0.0] * 63)]
    return []


@pytest.mark.parametrize("case", ["plain", "ties", "odd", "few", "wide", "none"])
def test_op12_query(spark, tmp_path, case):
    rows = vectors(case)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clustering.op12(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == kmeans(rows)


def test_partial_distances_spare_work():
    rng = np.random.default_rng(1)
    c = rng.integers(-60, 60, (16, 64))
    x = c[rng.integers(0, 16, 500)] + rng.integers(-3, 4, (500, 64))
    near, best, work = clustering.nearest(x, c, np.arange(64))
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (near == whole.argmin(1)).all() and (best == whole.min(1)).all() and work < 0.4 * whole.size * 64


def test_limbs():
    for sums in ([0, 0], [5, -5], [2**40, -(2**40)], [2**200 + 7, -(2**199) - 3], [2**63, 1]):
        digits = clustering.limbs(sums)
        assert [sum(d[j] << 40 * i for i, d in enumerate(digits)) for j in range(2)] == sums and all(abs(x) <= 2**40 for d in digits for x in d)


# ---- chats

PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]", "\\", "[", "<", "/", "]", "INST]", "s>", "a", " ", "\n", "é🙂"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=5), st.integers(1, 9))
def test_chat_round_trip(said, width):
    parts = [chat.rendered(r, t) for r, t in said]
    whole = chat.START + "".join(p[0] for p in parts)
    assert list(chat.turns([whole])) == said
    assert list(chat.turns(whole[i : i + width] for i in range(0, len(whole), width))) == said
    for (_, t), (part, a, b, passes) in zip(said, parts, strict=True):
        assert chat.unescaped(part[a:b]) == t and (passes == 1) <= (part[a:b] == t)


def test_chat_grammar():
    assert list(chat.turns(["<s>"])) == []
    for bad in ("", "x", "[INST]a[/INST]", "<s>a", "<s>[INST]a", "<s>[INST]a</s>", "<s><s>", "<s>[ROLE]a[/ROLE]", "<s>[ANS]a</s>b"):
        with pytest.raises(ValueError):
            list(chat.turns([bad]))


def test_chat_escapes_in_linear_time():
    for t in ("[" * 300_000, "[" + "\\" * 300_000 + "INST]", "<s>" * 100_000, "[INST" * 60_000):
        assert list(chat.turns([chat.START, chat.rendered("user", t)[0]])) == [("user", t)]


def test_op13_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "plain", "[INST] x [/INST]", r"[\INST] [\\INST]", "</s>", "é🙂\n<s>", "x" * 200_000]
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool", "ro[ROLE]le", None]), rng.choice(texts)) for c in (1, 2, None) for i in range(rng.randint(1, 9))]
    rows += [(3, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(2000)] + [(4, None, "user", "a"), (4, 0, "user", "b"), (4, 0, "user", "b"), (4, 0, "assistant", "a")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, passes int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    odd = "</s>[INST] ok [/INST]"
    said = {-7: [("user", odd), ("assistant", odd)]}
    for c, _, r, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said.setdefault(c, []).append((r or "", t or ""))
    got = {r.conv_id: r for r in chat.op13(spark, str(tmp_path)).collect()}
    assert got.keys() == said.keys()
    for c, turns in said.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        part = "<s>" + "".join(chat.rendered(r, t)[0] for r, t in turns)
        assert tuple(got[c])[1:] == (len(turns), H("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), H(loss), len(part))


def test_chat_parts(spark):
    chats = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "[ANS]"), (2, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    parts = chat.formatted(chats)
    rows = {(r.conv_id, r.part): r for r in parts.collect()}
    whole = rows[1, 0].text + rows[1, 1].text
    assert whole == r"<s>[INST]hi[/INST][ANS][\ANS]</s>" and whole[rows[1, 1].loss_from : rows[1, 1].loss_to] == r"[\ANS]"
    assert rows[1, 0].loss_from is None and (rows[1, 0].passes, rows[1, 1].passes) == (1, 2)
    assert chat.read_back(parts.repartition(3)).collect() and chat.formatted(chats.limit(0)).count() == 0
