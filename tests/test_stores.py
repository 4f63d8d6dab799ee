"""Snapshots, registries and the vector index: writers at once, replays, time travel, exact answers."""

import os
import random
import shutil
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import citations
from quillspark.operators.vector_index import VectorIndex
from quillspark.sources.snapshots import Conflict, Registry, Snapshots
from quillspark.sources.tables import shared


def test_shared_tables_follow_the_files(spark, tmp_path):
    folder = str(tmp_path / "data")
    read = lambda s, f: s.read.parquet(f"{f}/t.parquet")
    spark.range(5).write.parquet(f"{folder}/t.parquet")
    assert shared(spark, folder, "t", read).count() == shared(spark, folder, "t", read).count() == 5
    shutil.rmtree(f"{folder}/t.parquet")
    spark.range(7).write.parquet(f"{folder}/t.parquet")
    assert shared(spark, folder, "t", read).count() == 7


def test_split_references_by_hand(spark):
    cases = {
        "References 1. First reference of them all 2. Second one of them all": ["First reference of them all", "Second one of them all"],
        "references and notes\n(1) One in round brackets (2020) x\nmore of it\n[2] 3. Third one after an empty one": ["One in round brackets (2020) x\nmore of it", "Third one after an empty one"],
        "Text before\n$^{7}$ Superscript number as a mark\n[8] With $a\\ 9. b$ a formula in the middle": ["Superscript number as a mark", "With  a formula in the middle"],
        " \n [1] White space in front of it all, 12345. no mark": ["White space in front of it all, 12345. no mark"],
        "nothing of the kind": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", citations.split_references(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == cases


def test_commits_exclude_each_other(spark, tmp_path):
    log = Snapshots(spark, f"file://{tmp_path}/log")
    log.add({"rows": spark.range(1)})
    one, two = log.manifest(), log.manifest()
    assert log.commit(one | {"version": one["version"] + 1}) == 1
    with pytest.raises(Conflict):
        log.commit(two | {"version": two["version"] + 1})
    assert log.versions() == [0, 1] and not [f for f in os.listdir(tmp_path / "log/_versions") if f.startswith(".") and not f.endswith(".crc")]


def test_no_writer_is_lost(spark, tmp_path):
    paths = [f"file://{tmp_path}/registry"] * 6
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda x: Registry(spark, x[1], ["k"], ["t"]).upsert(spark.createDataFrame([(x[0], 1, "a"), (x[0], 2, "b"), (100, x[0], "c")], "k int, t int, v string")), enumerate(paths)))
    reg = Registry(spark, paths[0], ["k"], ["t"])
    assert len(reg.log.versions()) == 6
    got = {r.k: r.v for r in reg.rows().collect()}
    assert got == {**dict.fromkeys(range(6), "b"), 100: "c"}


def test_registry_versions_and_replays(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}/registry", ["k"], ["t"])
    assert reg.rows() is None and reg.compact() == -1
    frame = lambda *rows: spark.createDataFrame(rows, "k int, t int, v string")
    reg.upsert(frame((1, 1, "a"), (2, 1, "a"), (None, 1, "n")), writer="w", epoch=0)
    reg.delete(frame((1, 0, ""), (9, 0, "")))
    reg.upsert(frame((1, 0, "again"), (2, 0, None)), writer="w", epoch=1)
    before = reg.log.manifest()
    assert reg.upsert(frame((5, 5, "replay")), writer="w", epoch=1) == reg.upsert(frame((5, 5, "replay")), writer="w", epoch=0) == 2 and reg.log.manifest() == before
    rows = lambda v=None: sorted(((r.k, r.v) for r in reg.rows(v).collect()), key=str)
    assert rows(0) == [(1, "a"), (2, "a"), (None, "n")] and rows(1) == [(2, "a"), (None, "n")] and rows() == [(1, "again"), (2, None), (None, "n")]
    reg.log.spark.range(1).write.parquet(f"{reg.log.path}/part-{'0' * 32}")  # of a writer that died before it committed
    was = rows()
    reg.compact()
    assert rows() == was and len(reg.log.parts("rows")) == 1 and not reg.log.parts("gone") and rows(0) == [(1, "a"), (2, "a"), (None, "n")]
    reg.upsert(frame((7, 0, "x")))
    assert reg.log.vacuum(keep=1) == 4 and rows() == sorted([*was, (7, "x")], key=str) and reg.log.versions() == [4]


def brute(rows, queries, k):
    unit = lambda v: v / n if (n := np.linalg.norm(v)) else v
    out = {}
    for q, v in queries:
        if v is not None:
            found = [(-round(float(unit(np.array(v)) @ unit(np.array(x))), 6), i) for i, x in rows if i != q and len(x) == len(v)]
            out.update({(q, r): (i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)})
    return out


@pytest.mark.parametrize("kind", ["clustered", "random", "odd"])
def test_index_is_exact(spark, tmp_path, kind):
    rng = np.random.default_rng(4)
    if kind == "clustered":
        base = rng.normal(size=(12, 16))
        rows = [(i, (base[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(400)]
    elif kind == "random":
        rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    else:
        rows = [(i, [[0.0, 0.0], [1.0, 0.0], [0.0, -2.0], [1.0, 1.0], [3.0], [1.0, 0.0, 0.0]][i % 6]) for i in range(60)] + [(60, [1e-9, 1e-9])]
    frame = lambda found, s="s": spark.createDataFrame([(i, s, v) for i, v in found], "id long, source string, v array<double>")
    half = len(rows) // 2
    made = VectorIndex.create(frame(rows[:half] + [(1000 + i, v) for i, v in rows[:20]]), f"file://{tmp_path}/index")
    made.delete(spark.range(1000, 1020))
    if kind == "odd":
        made.append(spark.createDataFrame([(90, "s", None), (91, "s", []), (92, "s", [None, 1.0])], "id long, source string, v array<double>"))
    made.append(frame(rows[half:], "late"))
    made.append(frame([(1000, rows[0][1])], "late"))
    rows.append((1000, rows[0][1]))
    queries = [(i, v) for i, v in rows if i % 7 == 0] + [(-1, rows[1][1]), (-2, None), (-3, [1.0] * 50)]
    asked = spark.createDataFrame(queries, "query_id long, q array<double>")
    index = VectorIndex(spark, made.log.path)
    search = lambda: {(r.query_id, r["rank"]): (r.id, r.score) for r in index.search(asked, 5).collect()}
    want = brute(rows, queries, 5)
    assert search() == want
    if kind == "clustered":
        least = spark.createDataFrame([(q, v, 16, want[q, 5][1]) for q, v in queries if (q, 5) in want], "query_id long, q array<double>, d int, least double")
        looked = index.probes(least).join(index.rows().groupBy("cell", "ring").count(), ["cell", "ring"]).agg(F.sum("count")).first()[0]
        assert looked < 0.5 * least.count() * len(rows)
    index.compact()
    assert len(index.log.parts("rows")) == 1 and search() == want
    index.delete_source("late")
    assert search() == brute(rows[:half], queries, 5)


def test_replayed_append_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", [float(random.Random(i).random()), 1.0]) for i in range(30)], "id long, source string, v array<double>")
    index = VectorIndex.create(rows, f"file://{tmp_path}/index")
    for epoch in (0, 1, 0, 1):
        index.append(rows.withColumn("id", F.col("id") + 100 * (epoch + 1)), writer="stream", epoch=epoch)
    assert index.rows().count() == 90 and index.rows().distinct().count() == 90
    with pytest.raises(ValueError):
        VectorIndex(spark, f"file://{tmp_path}/none").append(rows)
