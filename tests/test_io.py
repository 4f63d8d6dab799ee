"""Readers, sinks, providers, question answering and streams."""

import json

from pyspark.sql import functions as F

from quillspark import providers
from quillspark.plans import rag
from quillspark.sources import sinks, tables, web
from quillspark.streaming import ingest


def test_readers(spark, tmp_path):
    assert tables.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert tables.list_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a.md").write_text("# T\n\nx")
    (tmp_path / "seeds.txt").write_text("10.1/a\n\n10.1/b\n")
    (tmp_path / "seeds.json").write_text('["10.1/c"]')
    (tmp_path / "reg.json").write_text(json.dumps({"f1": {"file_name": "a", "file_size": 3}, "f2": {"file_name": "b", "file_size": 4}}))
    assert tables.read_texts(spark, str(tmp_path / "a.md")).first().text == "# T\n\nx"
    assert [r.name for r in tables.list_files(spark, str(tmp_path), "*.md").collect()] == ["a.md"]
    assert [r.seed for r in tables.read_seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["10.1/a", "10.1/b"]
    assert [r.seed for r in tables.read_seeds(spark, str(tmp_path / "seeds.json")).collect()] == ["10.1/c"]
    assert {(r.file_id, r.file_size) for r in tables.read_registry(spark, str(tmp_path / "reg.json"), "file_name string, file_size bigint").collect()} == {("f1", 3), ("f2", 4)}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("10.1/a", 'A & "B" <c>', 0, True), ("10.1/b", None, 1, False)], "doi string, title string, depth int, is_seed boolean")
    edges = spark.createDataFrame([("10.1/a", "10.1/b", "parallel")], "source_doi string, target_doi string, label string")
    import xml.etree.ElementTree as ET

    for name, lines, nodes_at in (("g", sinks.graphml(nodes, edges), 2), ("x", sinks.gexf(nodes, edges), 2)):
        sinks.save_document(lines, str(tmp_path / name))
        root = ET.fromstring(next((tmp_path / name).glob("part*")).read_text())
        assert sum(e.tag.endswith("}node") for e in root.iter()) == nodes_at and sum(e.tag.endswith("}edge") for e in root.iter()) == 1
    sinks.save_table(edges, str(tmp_path / "t"), {"version": 1})
    assert sinks.table_metadata(spark.read.parquet(str(tmp_path / "t"))) == {"version": 1}
    sinks.save_csv(edges.withColumn("label", F.lit('a "q", b')), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').first().label == 'a "q", b'


def test_documents_in_fragments(spark, tmp_path):
    """Several tasks write one document, which parsers and readers take back whole."""
    import xml.etree.ElementTree as ET

    nodes = spark.range(500).select(F.concat(F.lit("10.1/n"), F.col("id").cast("string")).alias("doi"), F.concat(F.lit('t "<&'), F.col("id").cast("string"), F.lit("\n&lt;")).alias("title"), (F.col("id") % 7).cast("int").alias("depth"), (F.col("id") % 2 == 0).alias("is_seed"))
    edges = spark.range(900).select(F.concat(F.lit("10.1/n"), (F.col("id") % 500).cast("string")).alias("source_doi"), F.concat(F.lit("10.1/n"), (F.col("id") % 37).cast("string")).alias("target_doi"), F.lit("a > b").alias("label")).distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = {name: sinks.save_document(lines, f"file://{tmp_path}/{name}").collect() for name, lines in (("g", sinks.graphml(nodes, edges)), ("x", sinks.gexf(nodes, edges)))}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for name, rows in made.items():
        at = b""
        for r in rows:
            part = (tmp_path / name / r.fragment).read_bytes()
            assert (r.offset, r.bytes) == (len(at), len(part))
            at += part
        assert len(rows) > 2
        root = ET.fromstring(at)
        assert sum(e.tag.endswith("}node") for e in root.iter()) == 500 and sum(e.tag.endswith("}edge") for e in root.iter()) == edges.count()
    n, e = sinks.read_graphml(spark, f"file://{tmp_path}/g")
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.select("source_doi", "target_doi").collect()))
    n, e = sinks.read_gexf(spark, f"file://{tmp_path}/x")
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.select("doi", "title").collect())) and sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.collect()))


def test_providers(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, p string")
    got = {r.id: r.answer for r in providers.chat(df, "p", providers.echo_chat).collect()}
    assert got[1] == got[2] != None and got[3] is None  # noqa: E711

    def broken(prompts):
        raise RuntimeError("down")

    assert {r.error for r in providers.chat(df, "p", broken).collect()} == {"down", None}
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 2:
            raise OSError
        return x

    assert providers.retrying(flaky, wait=0)(5) == 5


def test_rag(spark):
    chunks = spark.createDataFrame([(1, "s1", "red green"), (2, "s2", "blue sky")], "id long, source string, content string")
    store = rag.index(chunks)
    assert rag.index(chunks, store).count() == 0
    q = spark.createDataFrame([(0, "blue sky"), (1, "green red")], "query_id long, query string")
    human = {r.query_id: r.human for r in rag.Pipeline(k=1).messages(q, store=store).collect()}
    assert "Source: s2" in human[0] and "Source: s1" in human[1]
    assert all(r.answer.startswith("answer") for r in rag.Pipeline("simple").query(q).collect())


def test_web():
    assert web.chosen_text('<p>no</p><div class="post-content">yes <b>it<br> is</div><p>no') == "yes \nit\n is"


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    for _ in range(2):
        ingest.run_once(ingest.document_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["one"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.window_counts(events).agg(F.sum("n")).first()[0] == events.count()
