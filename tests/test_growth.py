"""Steps whose work must not grow faster than what they read."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quillspark.operators import citations, features, graph, markdown, matching, paths, retrieval, sections, vector_index
from quillspark.plans import graph_queries, record_queries, stream_queries, text_queries
from quillspark.sources.snapshots import Registry
from quillspark.streaming import stores


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_many_are_counted_without_being_made(spark, tmp_path):
    spark.range(4000).select((F.col("id") * 7 - 50).alias("s_suppkey")).repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.i: r.partners for r in record_queries.all_pairs(spark, str(tmp_path)).collect()}
    assert got == {k * 7 - 50: 3999 - k for k in range(3999)}
    few = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "doi string")
    assert sorted(map(tuple, features.partners(few).collect())) == [("a", 2), ("b", 1)]


def test_equal_markers_and_references_meet_once(spark):
    markers = spark.createDataFrame([(1, "Lee", "1990")] * 5 + [(1, "Ng", "1990"), (2, "Lee", "1990"), (1, None, "1990")], "doc_id int, surname string, year string")
    refs = spark.createDataFrame([(1, 9, "By Lee", ["x"], "1990"), (1, 4, "by LEE", ["X"], "1990"), (1, 7, "none", ["Ann NG"], "1990"), (1, 8, "none", None, "1990")], "doc_id int, ref_pos int, text string, author array<string>, year string")
    found = citations.find_author_year(markers, refs)
    got = {(r.doc_id, r.surname): r.ref_pos for r in found.collect()}
    assert got == {(1, "Lee"): 4, (1, "Ng"): 7, (2, "Lee"): None, (1, None): None}
    # both sides of the join on document and year are made distinct below it
    joined = found._jdf.queryExecution().optimizedPlan().toString().lower().split("contains(")[-1]
    assert joined.count("aggregate [") == 2


def test_chunks_leave_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(markdown, "AT_ONCE", 50)
    rng = random.Random(6)
    texts = [(k, None if k == 3 else " ".join(rng.choice(["ab", "c.", "\n\n", "defg"]) for _ in range(rng.randint(0, 400)))) for k in range(9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = [(k, i, c) for k, t in texts for i, c in enumerate(markdown.recursive_chunks(t, 60, 10))]
    assert [tuple(r) for r in markdown.chunk_documents(docs, size=60, overlap=10).collect()] == want


def test_hops_go_half_way_from_both_ends(spark, monkeypatch):
    rng, reached, spread = random.Random(7), [], paths.spread
    edges = [("k", rng.randint(0, 150), rng.randint(0, 150)) for _ in range(160)]
    near = {}
    for _, a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [("k", rng.randint(0, 155), rng.randint(0, 155)) for _ in range(400)]
    monkeypatch.setattr(paths, "spread", lambda either, sources, keys, most=None: reached.append(most) or spread(either, sources, keys, most))
    for most in (1, 2, 3, 4):
        want = {}
        for _, a, b in asked:
            seen, front = {a}, {a}
            for d in range(1, most + 1):
                front = {y for x in front for y in near.get(x, ())} - seen
                seen |= front
                if b in front:
                    want[a, b] = d
        frame, pairs = spark.createDataFrame(edges, "k string, a long, b long"), spark.createDataFrame(asked, "k string, a long, b long")
        assert {(r.a, r.b): r.dist for r in paths.hops(frame, ["k"], pairs, most).collect()} == want
        assert max(reached) <= most - most // 2
        reached.clear()


def test_components_gather_nothing_at_the_driver(spark, monkeypatch):
    plans, written = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: plans.append(plan_of(df)) or written(df, name))
    edges = spark.createDataFrame([("k", f"n{i}", f"n{i + 1}") for i in range(20) if i != 9], "k string, a string, b string")
    assert {r.component for r in graph.reachable(edges, ["k"]).collect()} == {"n0", "n10"}
    assert plans and not any("Broadcast" in p for p in plans)


def test_lines_to_the_end_are_counted_from_there(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a", "[1] x", "prose", "prose", "[2] y", "", "prose", "[3] z", "tail"])], "doc_id int, pos int, line string")
    found = sections.reference_section(lines)
    assert [r.pos for r in found.orderBy("pos").collect()] == [4, 5, 6, 7, 8]
    # a frame from here to the end is summed anew for each row
    assert "currentrow$(), unboundedfollowing" not in plan_of(found).lower()


def test_blocks_are_classified_once(spark):
    rows = [(1, k, c, t) for k, (c, t) in enumerate([("references", "[1] a"), ("figure", "f"), ("references", "[2] b"), ("figure", "g"), ("main_letter", " c"), ("table", "t"), ("main_letter", "d."), ("main_letter", "")])]
    merged = markdown.merge_adjacent(spark.createDataFrame(rows, "doc_id int, pos int, category string, content string"))
    assert [tuple(r) for r in merged.orderBy("pos").collect()] == [(1, 0, "figure", "f\n\ng"), (1, 1, "main_letter", " c"), (1, 2, "table", "t"), (1, 3, "main_letter", "d."), (1, 4, "reference", "[1] a\n[2] b")]
    stitched = markdown.stitch(merged)
    assert [tuple(r)[2:] for r in stitched.orderBy("pos").collect()] == [("figure", "f\n\ng"), ("main_letter", "c"), ("table", "t"), ("main_letter", "d."), ("reference", "[1] a\n[2] b")]
    assert plan_of(stitched).count("Scan ExistingRDD") == 1


def test_citations_are_sorted_and_found_once(spark):
    folder = "/root/testdata/sf0.001"
    assert plan_of(text_queries.cited(spark, folder)).count("Sort [") == 1
    assert plan_of(text_queries.citation_by_article(spark, folder)).count("posexplode(") == 1


def test_pairs_by_way_of_a_node_are_not_shuffled(spark):
    arms = spark.createDataFrame([(z, n, 0.5, 3) for z in (1, 2) for n in (3, 4, 5)], "z long, n long, w double, d long")
    found = graph._scores(arms, 2)
    assert "hashpartitioning(i" not in plan_of(found) and "hashpartitioning(b" in plan_of(found)
    assert [tuple(r) for r in found.orderBy("i", "j").collect()] == [(3, 4, 1.0), (3, 5, 1.0)]
    numbers = spark.createDataFrame([(9, 1), (9, 10), (9, 2), (10, 3), (2, 3)], "source_doi long, target_doi long")
    got = graph.adamic_adar(numbers, 2, name=lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))).collect()
    assert [(r.i, r.j) for r in got] == [("p3", "p9"), ("p10", "p2")]


def test_records_are_read_for_asked_words_only(spark, monkeypatch):
    tables, written = {}, matching.written
    monkeypatch.setattr(matching, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    asked = spark.createDataFrame([("k", ["a", "b"])], "key string, words array<string>")
    held = spark.createDataFrame([(2, ["a", "x", "y"]), (1, ["b", "z"]), (3, ["q"]), (2, ["b"])], "doi long, words array<string>")
    assert [tuple(r) for r in matching.best_overlap(asked, held).collect()] == [("k", 2, 2)]
    assert sorted((r.doi, len(r.ids)) for r in tables["overlap-records"].collect()) == [(1, 1), (2, 2)]


def test_a_query_goes_once_to_a_part_of_the_index(spark, tmp_path, monkeypatch):
    rng, sent, was = random.Random(4), [], vector_index.candidates
    monkeypatch.setattr(vector_index, "candidates", lambda queries, *a, **kw: sent.append(queries) or was(queries, *a, **kw))
    rows = spark.createDataFrame([(i, "s", [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)], "id long, source string, v array<double>")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got = vector_index.VectorIndex.create(rows, f"{tmp_path}/index").search(queries, 3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in retrieval.nearest(queries, rows.select("id", "v"), 3).collect()}
    assert sent[-1].count() == 15


def test_users_of_a_bucket_are_merged_together():
    row = lambda user, began, ended=None, n=1, total=1.0: (user, began, began if ended is None else ended, n, total)
    frame = lambda *rows: pd.DataFrame(rows, columns=["user", "began", "ended", "n", "total"])
    known = frame(row("a", 10, 20, 3, 3.0), row("a", 30, 35, 2, 2.0), row("b", 10, 12, 2, 2.0))
    now, gone = stores.merged_all(known, frame(row("a", 25), row("b", 40), row("c", 1), row("a", -60)), 5, 100)
    assert sorted(now.itertuples(index=False, name=None)) == [("a", -60, -60, 1, 1.0, True), ("a", 10, 35, 6, 6.0, True), ("b", 10, 12, 2, 2.0, False), ("b", 40, 40, 1, 1.0, True), ("c", 1, 1, 1, 1.0, True)]
    assert list(gone.itertuples(index=False, name=None)) == [("a", 30)]
    # older than `late` before the user's last event
    assert len(stores.merged_all(known, frame(row("a", -60), row("b", -60)), 5, 90)[0]) == 4


def test_parts_of_events_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(6000).select((F.col("id") % 40).alias("user_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), F.lit(1.0).alias("value"))
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    stream_queries._sessions(spark, str(tmp_path), f"file://{tmp_path}/sessions")
    landed = spark.read.parquet(f"file://{tmp_path}/sessions-landing")
    assert len(landed.inputFiles()) > 4 and landed.count() == 6000
    found = Registry(spark, f"file://{tmp_path}/sessions", ["user", "began"])
    assert found.rows().agg(F.sum("n")).first()[0] == 6000 and len(found.log.versions()) == 4


def test_sums_of_ranks_leave_links_by_blocks(spark, monkeypatch):
    rng, plans, was = random.Random(8), [], graph._round_in_blocks
    monkeypatch.setattr(graph, "BITS", 5)
    monkeypatch.setattr(graph, "LINKED", 40)

    def seen(*a):
        new = was(*a)
        plans.append(plan_of(new[0]))
        return new

    monkeypatch.setattr(graph, "_round_in_blocks", seen)
    ids = [k - 70 for k in range(200) if k % 9]
    pairs = sorted({(rng.choice(ids[:150]), rng.choice(ids)) for _ in range(900)} | {(-70 + 1, k) for k in ids[:120]})
    nodes, edges = spark.createDataFrame([(k,) for k in ids], "doi long"), spark.createDataFrame(pairs, "source_doi long, target_doi long")
    want, out = {k: 1 / len(ids) for k in ids}, {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    for _ in range(4):
        lost = sum(r for k, r in want.items() if k not in out) / len(ids)
        new = {k: 0.15 / len(ids) + 0.85 * lost for k in ids}
        for a, bs in out.items():
            for b in bs:
                new[b] += 0.85 * want[a] / len(bs)
        want = new
    got = {r.doi: r.pagerank for r in graph.pagerank(nodes, edges, rounds=4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v / sum(want.values())) < 1e-12 for k, v in want.items())
    # neither links nor nodes are shuffled in a round: ranks go to the links, and sums, a list for each block, to the nodes
    assert len(plans) == 4 and all(p.count("Exchange hashpartitioning") == 2 and p.count("Bucketed: true") >= 2 for p in plans[1:])
    far = spark.createDataFrame([(k * 10**9,) for k in range(4)], "doi long")
    ring = spark.createDataFrame([(k * 10**9, (k + 1) % 4 * 10**9) for k in range(4)], "source_doi long, target_doi long")
    assert {round(r.pagerank, 12) for r in graph.pagerank(far, ring).collect()} == {0.25} and len(plans) == 4


def test_papers_that_are_needed_lead(spark):
    """Tables of papers are dealt to where they are needed, never joined with each other before."""
    pairs = spark.createDataFrame([(1, 2), (2, 40_000), (40_000, 1)], "i long, j long")
    sets = {c: spark.createDataFrame([(1, 5), (2, 5), (2, 6), (7, 5), (None, 1)], "owner long, member long") for c in ("refs", "citers")}
    ranks = spark.createDataFrame([(1, 0.5), (2, 0.25), (9, 0.25)], "doi long, pagerank double")
    met = features.overlap_in_blocks(pairs, sets, (ranks,), values=("pagerank",))
    got = {(r.i, r.j): (r.common_refs, r.n_citers_i, r.n_citers_j, r.pagerank_i, r.pagerank_j) for r in met.collect()}
    assert got == {(1, 2): (1, 1, 2, 0.5, 0.25), (2, 40_000): (None, 2, None, 0.25, None), (40_000, 1): (None, None, 1, None, 0.5)}
    assert "FullOuter" not in plan_of(met)


def test_papers_of_a_block_are_dealt_by_their_number(spark, monkeypatch):
    """A block whose citing papers are too many for a task is parted, though its pairs are few."""
    monkeypatch.setattr(features, "HELD", 20)
    pairs = spark.range(200).select(F.col("id").alias("i"), F.lit(7).cast("long").alias("j"))
    values = spark.range(200).select(F.col("id").alias("doi"), (F.col("id") * 2).alias("n"))
    met = features.meet(pairs, [values], values=("n",))
    assert {tuple(r) for r in met.collect()} == {(k, 7, 2 * k, 14) for k in range(200)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert met.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_meet_distinct_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 0.5, 1.5, 2.0]), rng.choice([None, 1, 2, 3, 4]), 3.0) for _ in range(500)]
    frame = spark.createDataFrame([(x, None if y is None or x is None else y + x, z) for x, y, z in rows], "x double, y double, z double")
    pd_rows = frame.toPandas().dropna()
    want = pd_rows.x.rank().corr(pd_rows.y.rank())
    found = features.spearman(frame, "x", "y")
    assert abs(found.first()[0] - want) < 1e-12
    # before ranks are joined, equal pairs of values are counted
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x#" in joined and joined.index("Join Inner") < joined.rindex("Aggregate [x#")
    assert features.spearman(frame, "x", "z").first()[0] is None and features.spearman(frame.limit(0), "x", "y").first()[0] is None


def test_features_are_not_joined_with_the_edges_they_belong_to(spark):
    folder = "/root/testdata/sf0.001"
    rows = graph_queries.judged(spark, folder)
    assert "Exchange" not in plan_of(rows) and "Join" not in plan_of(rows)
    raw = {(r.s, r.t) for r in graph_queries.cited(spark, folder).where("s <> t").collect()}
    fifth = {r.p_partkey for r in spark.read.parquet(f"{folder}/part.parquet").where("p_size % 5 = 0").collect()}
    known = {(r.i, r.j) for r in graph_queries.pairs(spark, folder).collect()}
    name = lambda a, b: (f"10.1234/p{a}", f"10.1234/p{b}")
    got = [(r.i, r.j, r.missing) for r in rows.collect()]
    assert sorted(got) == sorted((*name(*e), e not in known) for e in known | {(t, s) for s, t in raw if s in fifth})
    assert all(r.pagerank_target is None and r.label == "peripheral" for r in rows.where("missing").collect())
