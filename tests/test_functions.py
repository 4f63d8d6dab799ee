"""Golden values and edge cases of functions and operators."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import jsons, vector
from quillspark.functions import text as fx
from quillspark.operators import adjudicate, citations, graph, ingest
from quillspark.operators import features as ft
from quillspark.operators import markdown as md


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (fx.crawl_doi, "https://doi.org/10.1234/ABC", "10.1234/abc"), (fx.crawl_doi, "  DOI: 10.1/X  ", "10.1/x"), (fx.crawl_doi, None, None), (fx.crawl_doi, "see 10.1234/q.", "10.1234/q."),
        (fx.normalize_doi, "https://doi.org/10.48550/arXiv.2410.05779", "10.48550/arxiv.2410.05779"), (fx.normalize_doi, "doi: ", None), (fx.is_valid_doi, "10.1/x", False), (fx.is_valid_doi, " 10.1234/X ", True),
        (fx.name_key, "Zhaohui Jin", "jin z"), (fx.name_key, "K. Lu", "lu k"), (fx.name_key, "X. Y. Li", "li x"), (fx.name_key, "H.L. Fu", "fu h"), (fx.name_key, "Family, G.", "family g"), (fx.name_key, "Plato", "plato"), (fx.name_key, "", None),
        (fx.keywords, "# Keywords: a, b", ["a", "b"]), (fx.clean_entity, "High enhanced GBs", "Grain Boundary"), (fx.clean_entity, "stress", "Stress"), (fx.short_id, "https://x.org/W12/", "W12"),
        (fx.path_parts, "users/ann/set/raw/documents/a.pdf", ("ann", "set")), (fx.path_parts, "users/ann/documents", None), (fx.first_doi, '{"a": "see doi:10.1234/x]"}', "10.1234/x"), (fx.as_double, "NaN", None), (fx.as_double, "x", None),
        (citations.mark_superscripts, "single crystals.8,20 Therefore", "single crystals ⟦SUP:8,20⟧. Therefore"), (citations.mark_superscripts, "in Fig. 3 The", "in Fig. 3 The"), (citations.render_markers, "a ⟦SUP:8,20⟧.", "a ^{8,20}."),
        (citations.expand_numbers, "1–3, 5", [1, 2, 3, 5]), (citations.expand_numbers, "3-1", []), (citations.expand_numbers, "007", []), (citations.expand_numbers, "1-2-3", []),
    ],
)
def test_golden(spark, f, given, want):
    got = one(spark, f, given)[0]
    assert (tuple(got) if isinstance(want, tuple) else got) == want


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("as shown (9-12).", ["9-12"]), ("Eq. (9) holds.", []), ("(1) open pores", []), ("along (100), (010) lattice directions", []), ("too large (500).", []), ("seen before (3-1).", []),
        ("(007) and (05, 6).", ["05, 6"]), ("first (2), then (4, 7) and", ["2", "4, 7"]), ("", []), (None, None), ("in Fig. 2 (3).", ["3"]),
    ],
)
def test_paren_markers(spark, sentence, want):
    got = spark.createDataFrame([(sentence,)], "x string").select(citations.paren_markers(F.col("x"), F.lit(40))).first()[0]
    assert (got or []) == (want or [])


def test_citation_styles(spark):
    lines = ["Plain.", "One ⟦SUP:2,9⟧ [1-2] (3).", "Smith et al. (2001) and (Lee, 1999; Smith, 2001).", "Both [4] by Ng (1998)."]
    rows = citations.citation_contexts(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, sentence string"), most=F.lit(5)).orderBy("citation_id").collect()
    assert [(r.citation_id, r.pos, r.style, list(r.forms), list(r.markers), list(r.refs)) for r in rows] == [
        (1, 1, "numeric", ["bracket", "superscript", "paren"], ["[1-2]", "^{2,9}", "(3)"], [1, 2, 3]),
        (2, 2, "author-year", [], ["Smith 2001", "Lee 1999"], []), (3, 3, "numeric", ["bracket"], ["[4]"], [4]), (4, 3, "author-year", [], ["Ng 1998"], []),
    ]
    assert rows[0].context == "Plain. One ^{2,9} [1-2] (3). " + lines[2] and rows[0].prev_sentence == "Plain."
    registry = spark.createDataFrame([(1, None), (2, None), (3, "done")], "doc_id long, citation_state string")
    todo = citations.open_citations(registry)
    assert {r.doc_id for r in todo.collect()} == {1, 2}
    done = citations.with_citation_state(registry, todo, spark.createDataFrame([(1,)], "doc_id long"))
    assert {tuple(r) for r in done.collect()} == {(1, "done"), (2, "Not_Found"), (3, "done")}


def test_paragraph_sentences(spark):
    got = one(spark, md.paragraph_sentences, "See Fig. 3 and e.g. 2.5 mm. Next one! Last")[0]
    assert got == ["See Fig. 3 and e.g. 2.5 mm.", "Next one!", "Last"]


def test_recursive_chunks():
    text = "\n\n".join("word " * 30 for _ in range(40))
    got = md.recursive_chunks(text, 400, 100)
    assert all(len(c) <= 400 for c in got) and md.recursive_chunks(None) == [] and md.recursive_chunks("x" * 2500, 1000, 0) == ["x" * 1000, "x" * 1000, "x" * 500]


def test_split_references(spark):
    text = "# References\n[1] A long enough reference text, 2020\n(2) short\n3. Another long enough reference text $^{4}$ x $a+b$ 5. The last long enough reference"
    got = one(spark, citations.split_references, text, "", None)
    assert got[0] == ["A long enough reference text, 2020", "Another long enough reference text [4] x", "The last long enough reference"] and got[1] == [] and not got[2]


def test_graph_load_first_wins(spark):
    nodes = spark.createDataFrame([("a", "1", 0), ("a", "2", 1), ("b", "3", 2), (None, "4", 3)], "doi string, title string, ord int")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "z"), ("z", "a")], "source_doi string, target_doi string")
    n, e, c = graph.load_graph(nodes, edges)
    assert {(r.doi, r.title) for r in n.collect()} == {("a", "1"), ("b", "3")}
    assert [tuple(r) for r in e.collect()] == [("a", "b")]
    assert c.first().asDict() == {"rows": 4, "outside": 1, "loops": 1}


def test_null_is_not_zero(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "x")], "i string, j string")
    sets = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("c", "9")], "owner string, member string")
    got = {r.j: (r.bibcoupling_raw, r.bibcoupling_jaccard) for r in ft.bibcoupling(pairs, sets).collect()}
    assert got == {"b": (1, 0.5), "c": (0, 0.0), "x": (None, None)}
    mentions = spark.createDataFrame([("a", None, 3), ("a", "b", 1)], "i string, j string, n int")
    freq = {r.j: (r.citation_count, r.citation_freq) for r in ft.citation_frequency(pairs, mentions).collect()}
    assert freq == {"b": (1, 0.25), "c": (0, 0.0), "x": (0, 0.0)}


def test_pagerank_links_stay_where_they_are(spark):
    """From the first round on what is shuffled is ranks and sums: the links are scanned in buckets."""
    nodes = spark.range(300).select(F.col("id").cast("string").alias("doi"))
    edges = spark.range(2000).select((F.col("id") % 300).cast("string").alias("source_doi"), (F.col("id") * 7 % 293).cast("string").alias("target_doi")).distinct()
    links = graph.Bucketed(edges.withColumn("deg", F.lit(7)), "source_doi")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new, _ = graph._round(nodes.withColumn("dangling", F.lit(None).cast("boolean")), links.rows, nodes.withColumn("rank", F.lit(1.0)), 300, 0.85, 0.0)
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    scan = plan[: plan.index("FileScan parquet spark_catalog")].rsplit("SortMergeJoin", 1)[1]
    assert "Exchange" not in scan and "Bucketed: true" in plan
    links.close()
    assert not spark.catalog.tableExists(links.name)


def test_pagerank_sums_to_one(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "doi string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "source_doi string, target_doi string")
    r = {x.doi: x.pagerank for x in graph.pagerank(nodes, edges, rounds=100, tolerance=1e-9).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["c"] < r["b"] * 2


def test_constant_column_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert rows.agg(ft.pearson(F.col("x"), F.col("y")).alias("p")).first()["p"] is None


def test_rule_table(spark):
    cols = "citation_freq double, cocitation_salton double, bibcoupling_jaccard double, author_jaccard double, title_sim double, abstract_sim double, pagerank_target double, stage1_label string, missing boolean"
    rows = [
        (None, None, None, None, None, None, None, "inheritance", True), (0.16, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "unknown", False), (0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "unknown", False), (0.0, 0.3, 0.05, 0.0, 0.0, 0.0, 0.0, "unknown", False),
        (0.0, 0.3, 0.0, 0.0, 0.0, 0.0, 0.0, "unknown", False), (None, None, None, None, None, None, None, None, True), (0.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, None, False), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, False),
    ]
    got = [(r.label, r.tier) for r in adjudicate.classify(spark.createDataFrame(rows, cols)).collect()]
    assert got == [("inheritance", "high"), ("inheritance", "high"), ("inheritance", "medium"), ("parallel", "high"), ("parallel", "medium"), ("peripheral", "low"), ("peripheral", "medium"), ("peripheral", "high")]


def test_json_answers(spark):
    labels = one(spark, jsons.parse_label, 'x {"label": "Parallel", "reason": "r"} y', "it is an inheritance", "no idea")
    assert [x["label"] for x in labels] == ["parallel", "inheritance", "unknown"]
    assert one(spark, jsons.parse_entities, '["a", "b"]', 'so: ["c"] ok', "none") == [["a", "b"], ["c"], None]
    assert one(spark, jsons.parse_scores, '[{"entity": "a", "specificity": 1}, {"entity": "a", "specificity": 0}]') == [{"a": 0.0}]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in rows.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]
    assert abs(sum(x * x for x in one(spark, vector.hashed_embedding, "a b b")[0]) - 1) < 1e-9


def test_new_files(spark):
    listing = spark.createDataFrame([("p/a", "a", 1), ("q/a", "a", 1), ("p/b", "b", 2)], "file_path string, file_name string, file_size long")
    known = spark.createDataFrame([("b", 2)], "file_name string, file_size long")
    assert [(r.file_path, len(r.file_id)) for r in ingest.new_files(listing, known).collect()] == [("p/a", 26)]
