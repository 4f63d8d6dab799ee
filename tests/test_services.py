"""Crawls, providers, settings, layout, logs and operators whose queries can't show every case."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark import config, logs, providers
from quillspark.functions import records
from quillspark.operators import adjudicate, citations, crawl, features, graph, knowledge, retrieval, sections
from quillspark.operators import markdown as md
from quillspark.sources import layout, sinks, tables

EDGES = "source_doi string, target_doi string"


def table_source(spark, edges, **more):
    meta = spark.createDataFrame([(d, f"T{d}") for d in {x for e in edges for x in e if x}], "doi string, title string")
    return providers.TableSource(spark.createDataFrame(edges, EDGES), meta, **more)


def doi(n):
    return f"10.1234/{n}"


def test_crawl(spark, tmp_path):
    edges = [(doi(a), doi(b)) for a, b in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 1), (7, 6), (1, 1)]] + [(doi(2), None)]
    broken = spark.createDataFrame([(doi(3), "HTTP 404")], "doi string, reason string")
    sources = {"a": table_source(spark, edges, broken=broken)}
    seeds = spark.createDataFrame([("doi:" + doi(1),), ("https://doi.org/" + doi(1),), ("junk",)], "seed string")
    whole = crawl.crawl(seeds, sources, ["none", "a"], ["a"])
    assert {(r.doi, r.depth) for r in whole.nodes.collect()} == {(doi(1), 0), (doi(2), 1), (doi(3), 1), (doi(6), 1), (doi(4), 2)}
    assert {tuple(r) for r in whole.edges.collect()} == {(doi(1), doi(2)), (doi(1), doi(3)), (doi(6), doi(1)), (doi(2), doi(4))}
    assert [tuple(r) for r in whole.failed.collect()] == [(doi(3), "HTTP 404")] and whole.status == crawl.DONE and whole.dropped == 1 and whole.hits["a"] >= 2
    assert {r.title for r in whole.nodes.where("depth < 2").collect()} == {"T" + doi(n) for n in (1, 2, 3, 6)}
    # no more nodes than asked for, edges of those that weren't admitted all the same
    few = crawl.crawl(seeds, sources, ["a"], ["a"], most=3)
    assert few.status == crawl.FULL and {r.doi for r in few.nodes.collect()} == {doi(1), doi(2), doi(3)} and few.edges.count() == 3
    back = crawl.crawl(seeds, sources, ["a"], ["a"], direction="backward")
    assert doi(6) not in {r.doi for r in back.nodes.collect()}
    with pytest.raises(ValueError, match="direction"):
        crawl.crawl(seeds, sources, ["a"], ["a"], direction="up")
    # stopped after a level, and resumed from what was saved
    at = "file://" + str(tmp_path / "state")
    assert crawl.load_state(spark, at) is None
    assert crawl.crawl(seeds, sources, ["a"], ["a"], checkpoint=at, levels=1).status == "running"
    again = crawl.crawl(seeds, sources, ["a"], ["a"], checkpoint=at, resume=True)
    assert {tuple(r) for r in again.nodes.collect()} == {tuple(r) for r in whole.nodes.collect()} and again.status == crawl.DONE
    crawl.clear_state(spark, at)
    assert crawl.load_state(spark, at) is None
    note = json.loads(crawl.network_metadata(whole, seeds, backward=2).first()[0])
    assert (note["total_nodes"], note["failed_count"], note["backward"], note["seeds"]) == (5, 1, 2, 3)


def test_fetching():
    waits, answers = [], [(503, ""), (429, ""), (200, "{}")]
    get = providers.fetching(lambda url, params: answers.pop(0), sleep=waits.append, between=0.5)
    assert get("u", {}) == "{}" and waits == [0.5, 1.0, 0.5, 2.0, 0.5]
    gone = providers.fetching(lambda url, params: (404, ""), sleep=waits.append)
    with pytest.raises(providers.DeterministicFailure) as e:
        gone("u", {})
    assert e.value.reason == "HTTP 404"
    with pytest.raises(providers.Passing):
        providers.fetching(lambda url, params: (500, ""), tries=2, sleep=lambda s: None)("u", {})


def test_parse_and_search(spark):
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b""))], "path string, content binary").coalesce(1)
    got = {r.path: (r.text, r.state) for r in providers.parse(files, lambda xs: [x.decode() or None for x in xs]).collect()}
    assert got == {"a": ("one", 1), "b": (None, 0)}

    def down(xs):
        raise OSError("down")

    assert {r.state for r in providers.parse(files, down).collect()} == {-1}
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, query string")

    def web(q, n):
        if q == "y":
            raise OSError("down")
        return [("T", "http://a", "b"), ("U", None, "c")]

    said = {r.query_id: r.message for r in retrieval.search_message(providers.search(asked, web)).collect()}
    assert said == {1: "[1] T\nhttp://a\nb", 2: "Can't find any result."}


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"chat": "other", "neighbours": 7}')
    got = config.load(str(path), {"QUILL_NEIGHBOURS": "9", "QUILL_SCOPE": "all_local"})
    assert (got.chat, got.neighbours, got.scope, got.chunk_size) == ("other", 9, "all_local", 1200) and config.load(None, {}) == config.Config()
    path.write_text('{"nothing": 1}')
    with pytest.raises(ValueError, match="nothing"):
        config.load(str(path), {})
    assert config.api_key("acme", {"ACME_API_KEY": "k"}) == "k"
    with pytest.raises(ValueError, match="ACME"):
        config.api_key("acme", {})


def test_layout(spark):
    assert layout.path("ann", "set", "data_clean", "doi.json", "f1") == "users/ann/set/data_clean/f1/doi.json" and layout.registry("a", "b") == "users/a/b/documents.json"
    for bad in (("ann", "set", "nowhere", "x"), ("ann", "set", "parse", "x.md"), ("a/b", "set", "parse", "full.md")):
        with pytest.raises(ValueError, match="."):
            layout.path(*bad)
    rows = spark.createDataFrame([("users/a/b/documents/f",), (None,)], "p string")
    assert [r[0] and tuple(r[0]) for r in rows.select(layout.owner(F.col("p"))).collect()] == [("a", "b"), None]
    with pytest.raises(Exception, match="no document's path"):
        spark.createDataFrame([("else",)], "p string").select(layout.owner(F.col("p"))).collect()


def test_logs(tmp_path):
    log = logs.logger(str(tmp_path), "ann", "set", size=200, kept=2)
    for i in range(20):
        log.info("line %d", i)
    assert logs.logger(str(tmp_path), "ann", "set") is log and len(log.handlers) == 1
    assert {p.name for p in (tmp_path / "ann" / "set").iterdir()} == {"log.txt", "log.txt.1", "log.txt.2"}


def test_records(spark):
    text = json.dumps({"title": ["On It"], "author": [{"given": "A", "family": "Lee-Wu"}], "issued": {"date-parts": [[None]]}, "published-online": {"date-parts": [[2001, 2]]}, "reference": [{"key": "r", "year": "1999"}]})
    rows = spark.createDataFrame([(1, text), (2, "{}"), (3, "no json"), (4, None)], "id long, x string").withColumn("record", records.article(F.col("x")))
    got = {r.id: r.b for r in rows.select("id", records.bibjson(F.col("record"), F.lit("other")).alias("b")).collect()}
    assert (got[1].author, got[1].year, got[1].bibkey, got[1].abstract, got[1].journal) == (["A Lee-Wu"], "2001", "LeeWu2001On", "other", None)
    assert got[2].author == [] and got[2].year == "XXXX" and got[2].bibkey == "UnknownXXXXNoTitle"
    assert [tuple(r) for r in records.references(rows, "id").collect()] == [(1, 0, None, '{"key":"r","year":"1999"}')]


@pytest.mark.parametrize("small", [256, 6, 0])
def test_overlap_looks_from_the_smaller_side(spark, monkeypatch, small):
    monkeypatch.setattr(features, "SMALL", small)
    rng = random.Random(3)
    sets = {o: {rng.randint(0, 20) for _ in range(rng.randint(1, 15))} for o in "abcde"}
    rows = spark.createDataFrame([(o, str(m)) for o, ms in sets.items() for m in ms], "owner string, member string")
    pairs = [(i, j) for i in "abcdez" for j in "abcdez" if i != j]
    got = {(r.i, r.j): (r.ni, r.nj, r.common) for r in features.overlap(spark.createDataFrame(pairs, "i string, j string"), rows).collect()}
    for i, j in pairs:
        a, b = sets.get(i), sets.get(j)
        assert got[i, j] == (a and len(a), b and len(b), len(a & b) if a and b else None)


def test_ranks_without_one_window(spark):
    rng = random.Random(4)
    rows = [(float(rng.randint(0, 40)), rng.random()) for _ in range(500)]
    got = sorted(features.running(spark.createDataFrame(rows, "x double, y double").groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", "n", "before").collect())
    assert [r.before for r in got] == [sum(x < r.x for x, _ in rows) for r in got]


def adamic_by_hand(edges, top):
    from math import log

    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = []
    for a in near:
        for b in near:
            if a < b and b not in near[a] and (both := near[a] & near[b]):
                out.append((a, b, sum(1 / log(len(near[z])) for z in both)))
    return sorted(out, key=lambda x: (-round(x[2], 8), x[0], x[1]))[:top]


def test_adamic_adar_of_hubs(spark, monkeypatch):
    rng = random.Random(5)
    edges = [("hub", f"n{i:03}") for i in range(60)] + [(f"n{rng.randint(0, 59):03}", f"n{rng.randint(0, 59):03}") for _ in range(120)]
    df = spark.createDataFrame(edges, EDGES)
    monkeypatch.setattr(graph, "ARMS", 7)
    monkeypatch.setattr(graph, "PROBED", 9)
    got = [(r.i, r.j, round(r.score, 8)) for r in graph.adamic_adar(df, 10).collect()]
    assert got == [(a, b, round(s, 8)) for a, b, s in adamic_by_hand(edges, 10)]
    assert graph.adamic_adar(df, None).count() == len(adamic_by_hand(edges, 10**6))


def test_nearest_blocks(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    a, b = ({tuple(r) for r in retrieval.nearest(asked, df, 4, block=n).collect()} for n in (2048, 7))
    assert a == b and len(a) == 4 * 6 and [r[2] for r in sorted(x for x in a if x[0] == 100)] == [101, 102, 103, 104]


def test_candidates_have_a_bound(spark):
    papers = spark.createDataFrame([(str(i),) for i in range(5)], "doi string")
    assert features.all_local(papers).count() == 10
    with pytest.raises(ValueError, match="more than 9"):
        features.all_local(papers, 9)
    with pytest.raises(ValueError, match="scope"):
        features.build_candidates(papers, papers, "other")


def test_components_that_dont_end(spark):
    path = spark.createDataFrame([("k", i, i + 1) for i in range(40)], "k string, a long, b long")
    assert {r.component for r in graph.reachable(path, ["k"]).collect()} == {0}
    with pytest.raises(RuntimeError, match="no end"):
        graph.reachable(path, ["k"], rounds=2)


def stitched_by_hand(rows):
    import re

    out, held, late = [], [], []

    def flush():
        if held:
            out.append(("main_letter", " ".join(held).strip()))
        out.extend(late)
        held.clear()
        late.clear()

    for category, content in rows:
        if category in ("equation", "table") or category == "main_letter" and content.lstrip().startswith("#"):
            flush()
            out.append((category, content))
        elif category == "main_letter":
            held.append(content)
            if re.search(md.ENDS_SENTENCE, content):
                flush()
        else:
            (late if held else out).append((category, content))
    flush()
    return out


def test_stitch_by_hand(spark):
    rng = random.Random(7)
    docs = {d: [(rng.choice(["main_letter", "main_letter", "figure", "equation", "title"]), rng.choice(["Some text", "Ends.", "Ends.3,4 ", "# Head", "more"])) for _ in range(rng.randint(1, 14))] for d in range(40)}
    rows = spark.createDataFrame([(d, i, *x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id long, pos int, category string, content string")
    got = {}
    for r in md.stitch(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append((r.category, r.content))
    assert got == {d: stitched_by_hand(xs) for d, xs in docs.items()}


def section_by_hand(lines):
    import re

    for i, x in enumerate(lines):
        if re.search(md.REF_HEADER, x):
            return lines[i + 1 :]
    at = [i for i, x in enumerate(lines) if re.match(sections.ENTRY, x)]
    if len(at) < 3:
        return []
    start, prose = at[-1], 0
    for i in range(at[-1] - 1, -1, -1):
        if i in at:
            start, prose = i, 0
        elif lines[i].strip():
            prose += 1
            if prose > 1:
                break
    return lines[start:]


def test_reference_section_by_hand(spark):
    rng = random.Random(8)
    pick = ["[1] one of them", "(2) two of them", "3. three of them", "", "prose here", "prose there", "# References"]
    docs = {d: [rng.choices(pick, [4, 3, 3, 2, 3, 3, 0.4])[0] for _ in range(rng.randint(1, 16))] for d in range(80)}
    rows = spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], "doc_id long, pos int, line string")
    got = {}
    for r in sections.reference_section(rows).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {d: s for d, xs in docs.items() if (s := section_by_hand(xs))}


def test_mined_triplets(spark):
    chunks = spark.createDataFrame([("d", "A > B", "some text")], "doc_id string, path string, chunk string")
    answer = 'sure: [{"source": "GBs", "target": "Copper", "relation": " In "}, {"source": "x"}]'
    got = knowledge.triplets(knowledge.mined(chunks, lambda prompts: [answer for _ in prompts]))
    assert [tuple(r) for r in got.collect()] == [("d", "Grain Boundary", "Copper", "in")]
    assert knowledge.mined(chunks, lambda prompts: ["none" for _ in prompts]).count() == 0
    rows = spark.createDataFrame([("d", a, b, "r") for a, b in ("ab", "bc", "bd", "de")], "doc_id string, source string, target string, relation string")
    assert {(r.source, r.target, r.relation) for r in knowledge.predicted(rows, 2).collect()} <= {(a, b, "[PREDICTED]") for a in "abcde" for b in "abcde" if a < b}


def test_classifier_and_table_reports(spark, tmp_path):
    rows = spark.createDataFrame([("10.1/A", "10.1/b ", 1, 0.2), ("doi:10.1/a", "10.1/B", 2, 0.01), (None, "10.1/b", 3, 0.5)], "i string, j string, n int, citation_freq double")
    known = adjudicate.feature_lookup(rows, ["n"])
    assert [(r.i, r.j, r.citation_freq) for r in known.collect()] == [("10.1/a", "10.1/b", 0.01)]
    sinks.save_failures(spark.createDataFrame([("d", "HTTP 404")], "doi string, reason string"), str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()[0] == "d\tHTTP 404"
    sinks.save_embeddings(spark.createDataFrame([("d", [1.0]), ("e", None)], "doi string, embedding array<double>"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).dtypes == [("doi", "string"), ("embedding", "array<float>")] and spark.read.parquet(str(tmp_path / "e")).count() == 1
    made = []

    def make(s, folder):
        made.append(folder)
        return s.range(3)

    assert tables.shared(spark, "here", "x", make).count() == tables.shared(spark, "here", "x", make).count() == 3 and made == ["here"]
    assert citations.ordered_articles(spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", None)], "doc_id int, article string, first_ref int")).orderBy("place").select("article").collect() == [("a",), ("b",), ("c",)]
