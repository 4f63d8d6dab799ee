"""Sinks: JSON, text, CSV, tables with run metadata, GraphML and GEXF. All are Spark writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_text(df: DataFrame, column: str, path: str, by: list[str] = ()) -> None:
    """Texts, each with a line end behind it; with `by` in folders named by the values of these columns."""
    df.select(*by, F.col(column).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def save_registry(rows: DataFrame, path: str) -> None:
    """A registry's rows (file_id, row) as one JSON document, which its readers want whole."""
    whole = rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file_id", "row"))))).alias("value"))
    save_text(whole, "value", path)


def save_csv(df: DataFrame, path: str, tabs: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=not tabs, sep="\t" if tabs else ",", quote='"', escape='"')


def save_table(df: DataFrame, path: str, metadata: dict) -> None:
    """Parquet whose columns carry the run's metadata."""
    note = {"feature_metadata": json.dumps(metadata, sort_keys=True)}
    for c in df.columns:
        df = df.withMetadata(c, note)
    df.write.mode("overwrite").parquet(path)


def save_embeddings(rows: DataFrame, path: str) -> None:
    """(doi, embedding) as arrays of floats, without those that are null."""
    rows.where("embedding is not null").select("doi", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def save_failures(failed: DataFrame, path: str) -> None:
    """(doi, reason), parted by tabs."""
    save_csv(failed.select("doi", "reason"), path, tabs=True)


def report(coverage: DataFrame, tier: DataFrame, correlations: DataFrame, note: dict) -> DataFrame:
    """One row (report): coverage of each feature, the tier, correlations and notes, as one JSON document."""
    as_list = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    whole = as_list(coverage, "coverage").join(F.broadcast(as_list(tier, "tier"))).join(F.broadcast(as_list(correlations, "correlations")))
    return whole.select(F.to_json(F.struct("coverage", "tier", "correlations", F.lit(json.dumps(note, sort_keys=True)).alias("metadata"))).alias("report"))


def edgelist(edges: DataFrame) -> DataFrame:
    """(id, value): the lines of a CSV of edges (source_doi, target_doi, ...), cells with a comma, quote or line end quoted."""
    cell = lambda c: F.when(F.col(c).cast("string").rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return edges.select(F.concat_ws(" ", "source_doi", "target_doi").alias("id"), F.concat_ws(",", *[cell(c) for c in edges.columns]).alias("value"))


def table_metadata(df: DataFrame) -> dict:
    return json.loads(df.schema[0].metadata.get("feature_metadata", "{}")) if df.schema.fields else {}


#: Characters of texts that XML has other forms of; line breaks too, so that a row is a line.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"))


def xml_text(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def xml_plain(c: Column) -> Column:
    """What xml_text() was made of, but for null, which comes back as an empty text."""
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _document(parts: list[tuple[DataFrame | None, str]]) -> DataFrame:
    """(pos, id, value): the lines of an XML document, literal parts between rows."""
    spark = next(d.sparkSession for d, _ in parts if d is not None)
    out = None
    for i, (rows, text) in enumerate(parts):
        part = spark.createDataFrame([(i, "", text)], "pos int, id string, value string") if rows is None else rows.select(F.lit(i).alias("pos"), "id", "value")
        out = part if out is None else out.union(part)
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (pos, id, value) of a directed GraphML document of nodes (doi, title, depth, is_seed) and edges."""
    node = F.concat(F.lit('<node id="'), xml_text(F.col("doi")), F.lit('"><data key="title">'), xml_text(F.col("title")), F.lit('</data><data key="depth">'), F.col("depth").cast("string"), F.lit('</data><data key="is_seed">'), F.col("is_seed").cast("string"), F.lit("</data></node>"))
    edge = F.concat(F.lit('<edge source="'), xml_text(F.col("source_doi")), F.lit('" target="'), xml_text(F.col("target_doi")), F.lit('"/>'))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "".join(f'<key id="{k}" for="node" attr.name="{k}" attr.type="{t}"/>\n' for k, t in (("title", "string"), ("depth", "int"), ("is_seed", "boolean"))) + '<graph edgedefault="directed">'
    return _document([(None, head), (nodes.select(F.col("doi").alias("id"), node.alias("value")), ""), (edges.select(F.concat_ws(" ", "source_doi", "target_doi").alias("id"), edge.alias("value")), ""), (None, "</graph>\n</graphml>")])


def gexf(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines (pos, id, value) of a directed GEXF document of nodes (doi, title) and edges (source_doi, target_doi, label)."""
    node = F.concat(F.lit('<node id="'), xml_text(F.col("doi")), F.lit('" label="'), xml_text(F.col("title")), F.lit('"/>'))
    key = F.concat_ws(" ", "source_doi", "target_doi")
    edge = F.concat(F.lit('<edge id="'), xml_text(key), F.lit('" source="'), xml_text(F.col("source_doi")), F.lit('" target="'), xml_text(F.col("target_doi")), F.lit('" label="'), xml_text(F.col("label")), F.lit('"/>'))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="directed">\n<nodes>'
    return _document([(None, head), (nodes.select(F.col("doi").alias("id"), node.alias("value")), ""), (None, "</nodes>\n<edges>"), (edges.select(key.alias("id"), edge.alias("value")), ""), (None, "</edges>\n</graph>\n</gexf>")])


def save_document(lines: DataFrame, path: str) -> DataFrame:
    """Writes the lines in order, as fragments that follow one another by their names, and what manifest_of() says of them.

    Tasks write ranges of the document at once; none sees more than its own. The document is the fragments' bytes one after the other.
    """
    lines.repartitionByRange("pos", "id").sortWithinPartitions("pos", "id").select("value").write.mode("overwrite").text(path)
    manifest = manifest_of(lines.sparkSession, path)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return manifest


def manifest_of(spark, path: str) -> DataFrame:
    """(fragment, bytes, offset) of a saved document: where in it each fragment begins. A row for each fragment."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    rows, at = [], 0
    for name, size in sorted((f.getPath().getName(), f.getLen()) for f in found):
        rows.append((name, size, at))
        at += size
    return spark.createDataFrame(rows, "fragment string, bytes bigint, offset bigint")


def _fields(row: Column, names: dict[str, str]) -> list[Column]:
    return [xml_plain(F.regexp_extract(row, shape, 1)).alias(name) for name, shape in names.items()]


def read_graphml(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (doi, title, depth, is_seed) and edges (source_doi, target_doi) of a document that graphml() and save_document() made."""
    row = F.col("value")
    lines = spark.read.text(path, pathGlobFilter="part-*")
    data = {"doi": '^<node id="([^"]*)"'} | {k: f'<data key="{k}">([^<]*)</data>' for k in ("title", "depth", "is_seed")}
    nodes = lines.where(row.startswith("<node ")).select(*_fields(row, data)).withColumn("depth", F.col("depth").cast("int")).withColumn("is_seed", F.col("is_seed").cast("boolean"))
    return nodes, lines.where(row.startswith("<edge ")).select(*_fields(row, {"source_doi": ' source="([^"]*)"', "target_doi": ' target="([^"]*)"'}))


def read_gexf(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (doi, title) and edges (source_doi, target_doi, label) of a document that gexf() and save_document() made."""
    row = F.col("value")
    lines = spark.read.text(path, pathGlobFilter="part-*")
    nodes = lines.where(row.startswith("<node ")).select(*_fields(row, {"doi": '^<node id="([^"]*)"', "title": ' label="([^"]*)"'}))
    return nodes, lines.where(row.startswith("<edge ")).select(*_fields(row, {"source_doi": ' source="([^"]*)"', "target_doi": ' target="([^"]*)"', "label": ' label="([^"]*)"'}))


def degree_layout(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(doi, degree, size, hue) for a drawing: size by degree, hue by its place between least and most."""
    rows = nodes.select("doi").join(degrees.select("doi", (F.col("in_degree") + F.col("out_degree")).alias("degree")), "doi", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ends = rows.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    frac = F.coalesce(F.try_divide(F.col("degree") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return rows.join(F.broadcast(ends)).select("doi", "degree", (15 + 3 * F.col("degree")).alias("size"), (0.66 * (1 - frac)).alias("hue"))
