"""Queries on records, sources, candidates, crawls and knowledge graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import records as rc
from ..functions import text as fx
from ..operators import adjudicate, crawl, features, graph, knowledge, matching
from ..sources import sinks
from ..sources.tables import shared_path, table, written
from .graph_queries import DEG, RAW, SEEDS, network, papers, raw_edges, references

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def part(spark, d):
    return table(spark, d, "part")


def key(c="p_partkey"):
    return F.col(c).cast("string")


def kind(n, c="p_size"):
    return F.col(c) % n


# Records in JSON ------------------------------------------------------------------------------------------------


def articles(spark, d):
    """Parts as articles' records in JSON, in which fields are missing by rule."""
    date = lambda y: F.struct(F.array(F.array(y, F.lit(1))).alias("date-parts"))
    y = F.col("p_size") + 1950
    person = lambda given, family: F.struct(given.alias("given"), family.alias("family"))
    none = F.lit(None).cast("string")
    people = F.when(kind(4) == 0, F.array(person(F.lit("Ann "), F.lit("Lee")), person(none, F.col("p_brand")))).when(kind(4) == 1, F.array(person(F.lit("Solo"), none))).when(kind(4) == 2, F.array().cast("array<struct<given:string,family:string>>"))
    fields = {
        "DOI": F.concat(F.lit("10.1234/P"), key()), "URL": F.concat(F.lit("https://x.org/"), key()), "title": F.array("p_name"), "author": people,
        "container-title": F.when(kind(3) == 0, F.array("p_type")).when(kind(3) == 1, F.array(F.lit(""))), "short-container-title": F.when(kind(3) == 1, F.array(F.concat(F.lit("S "), "p_type"))), "publisher": F.col("p_brand"),
        "published-print": F.when(kind(5) == 0, date(y)), "published": F.when(kind(5) == 1, date(y)), "issued": F.when(kind(5) < 3, date(y + 1)), "published-online": F.when(kind(5) == 3, date(y)),
        "volume": F.when(kind(2) == 0, F.col("p_size").cast("string")), "issue": F.when(kind(3) == 0, F.lit("7")).when(kind(3) == 1, F.lit("")), "journal-issue": F.when(kind(3) == 1, F.struct(F.lit("8").alias("issue"))),
        "page": F.when(kind(3) == 0, F.lit("1-9")), "article-number": F.when(kind(3) == 1, F.lit("e5")), "eLocator": F.when(kind(3) == 2, F.lit("L3")), "abstract": F.when(kind(2) == 0, F.concat(F.lit("<jats:p>On <b>"), "p_name", F.lit("</b> </jats:p>"))),
    }
    return part(spark, d).select("p_partkey", "p_name", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("json"))


@query("bibjson", """SELECT p_partkey, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'Ann Lee; ' || p_brand WHEN 1 THEN 'Solo' ELSE '' END AS author, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN 'S ' || p_type ELSE p_brand END AS journal,
'10.1234/P' || p_partkey AS doi, 'https://x.org/' || p_partkey AS url, CASE p_size % 5 WHEN 2 THEN (p_size + 1951)::VARCHAR WHEN 4 THEN 'XXXX' ELSE (p_size + 1950)::VARCHAR END AS year, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS volume,
CASE p_size % 3 WHEN 0 THEN '7' WHEN 1 THEN '8' END AS number, CASE p_size % 3 WHEN 0 THEN '1-9' WHEN 1 THEN 'e5' ELSE 'L3' END AS pages,
CASE WHEN p_size % 4 = 0 THEN 'Lee' ELSE 'Unknown' END || CASE p_size % 5 WHEN 2 THEN (p_size + 1951)::VARCHAR WHEN 4 THEN 'XXXX' ELSE (p_size + 1950)::VARCHAR END || string_split(p_name, ' ')[1] AS bibkey,
CASE WHEN p_size % 2 = 0 THEN 'On ' || p_name ELSE 'Elsewhere ' || p_name END AS abstract FROM part""")  # fmt: skip
def bibjson(spark, d):
    rows = articles(spark, d).select("p_partkey", rc.bibjson(rc.article(F.col("json")), F.concat(F.lit("Elsewhere "), "p_name")).alias("b")).select("p_partkey", "b.*")
    return rows.withColumn("author", fx.authors_text(F.col("author")))


def cited_records(spark, d):
    """Orders as articles' records with three references each."""
    ref = lambda n, doi, text: F.struct(F.lit(n).alias("key"), doi.alias("DOI"), text.alias("unstructured"))
    none = F.lit(None).cast("string")
    refs = F.array(ref("r1", F.concat(F.lit("https://doi.org/10.1234/O"), key("o_orderkey")), none), ref("r2", none, F.col("o_orderpriority")), ref("r3", F.lit(" "), F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", rc.article(F.to_json(F.struct(refs.alias("reference")))).alias("record"))


REFERENCES = """SELECT o_orderkey, 0 AS pos, '10.1234/o' || o_orderkey AS doi, '{"key":"r1","doi":"https://doi.org/10.1234/O' || o_orderkey || '"}' AS entry FROM orders
UNION ALL SELECT o_orderkey, 1, NULL, '{"key":"r2","unstructured":"' || o_orderpriority || '"}' FROM orders UNION ALL SELECT o_orderkey, 2, NULL, '{"key":"r3","doi":" ","unstructured":"' || o_orderstatus || '"}' FROM orders"""


@query("article_references", REFERENCES)
def article_references(spark, d):
    return rc.references(cited_records(spark, d), "o_orderkey")


@query("article_dropped", "SELECT o_orderkey, 1 AS resolved, 2 AS dropped FROM orders")
def article_dropped(spark, d):
    return rc.resolved(article_references(spark, d), "o_orderkey")


@query("openalex_references", f"""WITH {RAW}, w AS (SELECT i, list(t ORDER BY t) AS ts FROM raw GROUP BY i) SELECT i AS doi, ts[1]::VARCHAR AS first_work, len(list_filter(ts, lambda t: t % 3 <> 0)) AS resolved, len(list_filter(ts, lambda t: t % 3 = 0)) AS dropped, list_min(list_filter(ts, lambda t: t % 3 <> 0)) AS least
FROM w""")  # fmt: skip
def openalex_references(spark, d):
    listed = raw_edges(spark, d).groupBy("i").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    text = F.to_json(F.struct(F.transform("ts", lambda t: F.concat(F.lit("https://openalex.org/W"), t.cast("string"))).alias("referenced_works")))
    works = listed.select("i", rc.work(text).alias("work"))
    ids = part(spark, d).where("p_partkey % 3 <> 0").select(F.concat(F.lit("https://openalex.org/W"), key(), F.lit("/")).alias("work_id"), F.concat(F.lit("https://doi.org/10.1234/P"), key()).alias("doi"))
    found = rc.work_references(works, "i", ids)
    number = F.regexp_extract("doi", r"(\d+)$", 1).try_cast("bigint")
    sums = found.groupBy("i").agg(F.min_by("work_id", "pos").alias("w"), F.count("doi").alias("resolved"), F.count_if(F.col("doi").isNull()).alias("dropped"), F.min(number).alias("least"))
    return sums.select(F.col("i").alias("doi"), F.substring("w", 2, 20).alias("first_work"), "resolved", "dropped", "least")


@query("work_records", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE '10.1234/p' || p_partkey END AS doi, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'D ' || p_name END AS title, 'W' || p_partkey AS work_id, 1950 + p_size AS year, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE '' END AS authors FROM part")
def work_records(spark, d):
    people = F.array(F.struct(F.struct(F.when(kind(4) == 0, F.col("p_brand")).alias("display_name")).alias("author")))
    fields = F.struct(F.concat(F.lit("https://openalex.org/W"), key()).alias("id"), F.when(kind(3) != 0, F.concat(F.lit("https://doi.org/10.1234/P"), key())).alias("doi"), F.when(kind(2) == 0, F.col("p_name")).alias("title"),
                      F.concat(F.lit("D "), "p_name").alias("display_name"), (F.col("p_size") + 1950).alias("publication_year"), people.alias("authorships"))
    return part(spark, d).select("p_partkey", rc.work_meta(rc.work(F.to_json(fields))).alias("m")).select("p_partkey", "m.doi", "m.title", "m.work_id", "m.year", fx.authors_text(F.col("m.authors")).alias("authors"))


PAGED = "ranked AS (SELECT i, t, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS rn FROM raw)"


@query("semantic_pages", f"WITH {RAW}, {PAGED} SELECT i, rn AS pos, CASE WHEN t % 4 <> 0 THEN '10.1234/p' || t END AS doi FROM ranked")
def semantic_pages(spark, d):
    """References of each paper in pages of four."""
    rn = F.row_number().over(Window.partitionBy("i").orderBy("t")) - 1
    one = F.struct(F.struct(F.struct(F.when(F.col("t") % 4 != 0, F.concat(F.lit("10.1234/P"), key("t"))).alias("DOI")).alias("externalIds")).alias("citedPaper"))
    rows = raw_edges(spark, d).withColumn("rn", rn).withColumn("offset", F.floor(F.col("rn") / 4) * 4)
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col("rn"), one.alias("x")))), lambda x: x["x"])
    return rc.page_edges(rows.groupBy("i", "offset").agg(F.to_json(F.struct(items.alias("data"))).alias("page")), "i")


@query("author_sets", """WITH a AS (SELECT s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'id::0000-' || s_suppkey % 7 WHEN 1 THEN 'id::a' || s_suppkey ELSE 'supplier' || lpad(s_suppkey::VARCHAR, 9, '0') END AS x FROM supplier) SELECT s_nationkey, string_agg(x, '|' ORDER BY x) AS authors FROM (SELECT DISTINCT * FROM a) GROUP BY s_nationkey""")
def author_sets(spark, d):
    k, none = F.col("s_suppkey") % 3, F.lit(None).cast("string")
    person = F.struct(F.when(k == 0, F.concat(F.lit("0000-"), (F.col("s_suppkey") % 7).cast("string"))).otherwise("").alias("orcid"), F.when(k == 1, F.concat(F.lit(" A"), key("s_suppkey"))).alias("openalex_id"), none.alias("id"), F.replace("s_name", F.lit("#"), F.lit("")).alias("name"), none.alias("display_name"))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(person).alias("a")).select("s_nationkey", F.array_join(rc.author_ids(F.col("a")), "|").alias("authors"))


@query("record_lookup", "SELECT DISTINCT o_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS record FROM orders JOIN customer ON c_custkey = o_custkey")
def record_lookup(spark, d):
    asked = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_custkey", F.concat(F.lit("https://doi.org/10.1/C"), key("o_custkey")).alias("doi")).distinct()
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("doi:10.1/c"), key("c_custkey")).alias("doi"), F.col("c_name").alias("record"))
    return rc.lookup(asked, known).select("o_custkey", "record")


WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3))"


@query("best_records", f"""WITH r AS (SELECT item_id, unnest({WORDS.format('text')}) AS w FROM benchmark), t AS (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents), s AS (SELECT item_id, doc_id, count(*) AS shared FROM r JOIN t USING (w) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM s) SELECT item_id, b.doc_id AS doi, shared FROM benchmark LEFT JOIN b USING (item_id) WHERE coalesce(k, 1) = 1""")  # fmt: skip
def best_records(spark, d):
    """The document, as a whole, that shares most words with each item."""
    records = table(spark, d, "documents").select(F.col("doc_id").alias("doi"), F.col("text").alias("title"))
    return matching.best_record(table(spark, d, "benchmark").select("item_id", "text"), records, "item_id")


# Candidates -----------------------------------------------------------------------------------------------------


@query("local_papers", """WITH r AS (SELECT o_orderkey, o_custkey, '10.1/c' || o_custkey AS doi, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey % 5 <> 0 AND o_orderstatus <> 'P')
SELECT doi, o_orderkey AS file_id, CASE WHEN o_custkey % 3 = 0 THEN 'File ' || o_orderkey ELSE 'Title ' || o_custkey END AS title FROM r WHERE k = 1""")  # fmt: skip
def local_papers(spark, d):
    o = table(spark, d, "orders")
    registry = o.select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("https://doi.org/10.1/C"), key("o_custkey"))).alias("doi"), F.concat(F.lit("File "), key("o_orderkey")).alias("file_name"))
    known = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("Title "), key("o_custkey"))).otherwise("").alias("title"))
    return graph.local_papers(registry, known, ["file_id"])


LOCAL = f"{RAW}, loc AS (SELECT DISTINCT i, doi FROM (SELECT i, j AS doi FROM raw WHERE s % 2 = 0 UNION ALL SELECT i, j FROM raw WHERE t % 3 = 0) WHERE i <> doi AND doi IN (SELECT doi FROM papers) AND i IN (SELECT doi FROM papers))"


def local_out(spark, d):
    raw = raw_edges(spark, d).select("s", "t", "i", F.col("j").alias("doi"))
    return features.local_references(papers(spark, d), raw.where("s % 2 = 0"), raw.where("t % 3 = 0"))


@query("local_references", f"WITH {LOCAL} SELECT i, doi FROM loc")
def local_references(spark, d):
    return local_out(spark, d)


@query("candidate_edges", f"WITH {LOCAL} SELECT (SELECT count(*) FROM papers) AS papers, count(*) AS pairs, count(*) > 1000 AS over, min(i || ' ' || doi) AS first_pair FROM loc")
def candidate_edges(spark, d):
    pairs, said = features.build_candidates(papers(spark, d), local_out(spark, d), most=1000)
    return said.join(F.broadcast(pairs.agg(F.min(F.concat_ws(" ", "i", "j")).alias("first_pair"))))


@query("all_pairs", "SELECT a.s_suppkey AS i, count(*) AS partners FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey GROUP BY 1")
def all_pairs(spark, d):
    return features.partners(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doi")))


@query("reference_vocab", f"WITH {RAW} SELECT count(DISTINCT i) AS papers_with_references, count(DISTINCT j) AS reference_vocab_size FROM raw")
def reference_vocab(spark, d):
    return features.reference_summary(references(spark, d))


@query("feature_lookup", """WITH f AS (SELECT l_partkey AS p, l_suppkey AS s, arg_max(l_quantity, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS q FROM lineitem GROUP BY ALL),
e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT '10.1/p' || c AS i, '10.1/s' || e.s AS j, f.p IS NULL AS missing, q FROM e LEFT JOIN f ON f.p = e.c AND f.s = e.s""")  # fmt: skip
def feature_lookup(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("doi:10.1/P"), key("l_partkey")).alias("i"), F.concat(F.lit("10.1/S"), key("l_suppkey"), F.lit(" ")).alias("j"), F.col("l_quantity").alias("q"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    known = adjudicate.feature_lookup(rows, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]).select("i", "j", "q")
    edges = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("10.1/p"), key("o_custkey")).alias("i"), F.concat(F.lit("10.1/s"), key("l_suppkey")).alias("j")).distinct()
    return adjudicate.with_features(edges, known).select("i", "j", "missing", "q")


ENDS = "edges AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, 's' || l_suppkey AS i, 'p' || l_partkey AS j, CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_orderkey ELSE '' END AS st, CASE WHEN l_linenumber % 3 = 0 THEN 'P' || l_orderkey ELSE '' END AS tt FROM lineitem)"


@query("end_nodes", f"""WITH {ENDS}, n AS (SELECT i AS doi, st AS title, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM edges UNION ALL SELECT j, tt, l_orderkey, l_linenumber, l_extendedprice, l_quantity FROM edges)
SELECT doi, coalesce(arg_min(title, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) FILTER (WHERE title <> ''), '') AS title FROM n GROUP BY doi""")  # fmt: skip
def end_nodes(spark, d):
    n, o = F.col("l_linenumber"), key("l_orderkey")
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", F.concat(F.lit("s"), key("l_suppkey")).alias("i"), F.concat(F.lit("p"), key("l_partkey")).alias("j"), F.when(n % 2 == 0, F.concat(F.lit("S"), o)).otherwise("").alias("source_title"), F.when(n % 3 == 0, F.concat(F.lit("P"), o)).alias("target_title"))
    return adjudicate.end_nodes(edges, ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])


@query("asked_edges", f"WITH {RAW}, m AS (SELECT i, j, count(*) FILTER (WHERE s % 3 = 0) AS n_contexts FROM raw WHERE i <> j GROUP BY i, j) SELECT i, j, n_contexts, CASE WHEN n_contexts = 0 THEN 'unknown' ELSE 'parallel' END AS label FROM m")
def asked_edges(spark, d):
    rows = raw_edges(spark, d).where("i <> j").groupBy("i", "j").agg(F.count_if(F.col("s") % 3 == 0).alias("n_contexts"))
    some, rest = adjudicate.asked(rows)
    from ..functions.jsons import parse_label

    said = parse_label(F.concat(F.lit('{"label": "Parallel", "reason": "'), "i", F.lit('"}')))["label"]
    return some.withColumn("label", said).unionByName(rest)


# Crawls ---------------------------------------------------------------------------------------------------------

FROM = """src AS (SELECT '10.1234/p' || l_partkey AS i, '10.1234/p' || t AS j, flag FROM (SELECT l_partkey, l_returnflag AS flag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t FROM lineitem) WHERE t IS NOT NULL)"""
CRAWL = f"""{FROM}, ref AS (SELECT DISTINCT i, j FROM src WHERE i NOT LIKE '%7' AND (flag = 'R' OR i NOT IN (SELECT i FROM src WHERE flag = 'R'))), cit AS (SELECT DISTINCT i, j FROM src WHERE j NOT LIKE '%7'),
n AS (SELECT doi, min(depth) AS depth FROM (WITH RECURSIVE r(doi, depth) AS (SELECT unnest(['10.1234/p1', '10.1234/p2', '10.1234/p3']), 0 UNION (SELECT ref.j, r.depth + 1 FROM r JOIN ref ON ref.i = r.doi WHERE r.depth < 2 UNION ALL SELECT cit.i, r.depth + 1 FROM r JOIN cit ON cit.j = r.doi WHERE r.depth < 1)) SELECT * FROM r) GROUP BY doi),
ed AS (SELECT ref.i, ref.j FROM ref JOIN n ON n.doi = ref.i WHERE depth < 2 AND ref.i <> ref.j UNION SELECT cit.i, cit.j FROM cit JOIN n ON n.doi = cit.j WHERE depth < 1 AND cit.i <> cit.j)"""


def crawl_sources(spark, d):
    from .graph_queries import LINE

    w = Window.partitionBy("l_orderkey").orderBy(*LINE)
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("flag"), F.lead("l_partkey").over(w).alias("t")).where("t is not null")
    rows = written(rows.select(F.concat(F.lit("10.1234/p"), key("l_partkey")).alias("source_doi"), F.concat(F.lit("10.1234/p"), key("t")).alias("target_doi"), "flag"), "crawl-source")
    meta = papers(spark, d).where("p_partkey % 2 = 0").select("doi", F.col("p_name").alias("title"))
    broken = papers(spark, d).where("doi like '%7'").select("doi", F.lit("HTTP 404").alias("reason"))
    first = providers.TableSource(rows.where("flag = 'R'").drop("flag"), meta, cited_by=False, broken=broken)
    return {"first": first, "second": providers.TableSource(rows.drop("flag"), meta)}


def seeds(spark):
    return spark.createDataFrame([("https://doi.org/10.1234/P1",), ("doi:10.1234/p2",), ("10.1234/p3",), ("10.1234/P3",), ("no doi",)], "seed string")


@query("crawl_run", f"WITH {CRAWL} SELECT depth, count(*) AS nodes, (SELECT count(*) FROM ed) AS edges, (SELECT count(*) FROM n WHERE depth < 2 AND doi LIKE '%7') AS failed FROM n GROUP BY depth")
def crawl_run(spark, d):
    s = crawl.crawl(seeds(spark), crawl_sources(spark, d), ["first", "second"], ["first", "second"])
    sums = s.edges.agg(F.count(F.lit(1)).alias("edges")).join(F.broadcast(s.failed.agg(F.count(F.lit(1)).alias("failed"))))
    return s.nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(sums))


@query("crawl_resume", f"WITH {CRAWL} SELECT n.doi, depth, depth = 0 AS is_seed, CASE WHEN depth < 2 AND p_partkey % 2 = 0 THEN p_name ELSE 'Unknown Title' END AS title FROM n LEFT JOIN part ON '10.1234/p' || p_partkey = n.doi")
def crawl_resume(spark, d):
    """A crawl that ends after one level and goes on from its saved state."""
    at, sources = crawl.scratch_checkpoint(spark), crawl_sources(spark, d)
    crawl.crawl(seeds(spark), sources, ["first", "second"], ["second"], checkpoint=at, levels=1)
    return crawl.crawl(seeds(spark), sources, ["first", "second"], ["second"], checkpoint=at, resume=True).nodes


NODES = f"{RAW}, nod AS (SELECT doi, p_name AS title FROM papers)"


@query("network_lines", f"""WITH {NODES} SELECT 'node' AS kind, doi AS id, '{{"doi":"' || doi || '","title":"' || title || '","depth":0,"is_seed":false}}' AS value FROM nod UNION ALL SELECT 'edge', i || ' ' || j, '{{"source_doi":"' || i || '","target_doi":"' || j || '"}}' FROM e""")
def network_lines(spark, d):
    nodes, edges = network(spark, d)
    return crawl.network_lines(nodes.select("doi", "title", F.lit(0).alias("depth"), F.lit(False).alias("is_seed")), edges)


@query("edgelist_lines", "SELECT 'c' || c_custkey || ' n' || c_nationkey AS id, 'c' || c_custkey || ',n' || c_nationkey || ',' || CASE WHEN c_custkey % 2 = 0 THEN '\"' || c_mktsegment || ', \"\"' || c_name || '\"\"\"' ELSE c_name END AS value FROM customer")
def edgelist_lines(spark, d):
    label = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(', "'), "c_name", F.lit('"'))).otherwise(F.col("c_name"))
    return sinks.edgelist(table(spark, d, "customer").select(F.concat(F.lit("c"), key("c_custkey")).alias("source_doi"), F.concat(F.lit("n"), key("c_nationkey")).alias("target_doi"), label.alias("label")))


XML = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def xml_nodes(spark, d):
    return part(spark, d).select(F.concat(F.lit("10.1234/p"), key()).alias("doi"), F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_brand", F.lit('"')).alias("title"), F.col("p_size").alias("depth"), (F.col("p_size") % 2 == 0).alias("is_seed"))


TITLE = XML.format("'<' || p_name || '> & \"' || p_brand || '\"'")


@query("graphml_lines", f"""WITH {RAW} SELECT '10.1234/p' || p_partkey AS id, '<node id="10.1234/p' || p_partkey || '"><data key="title">' || {TITLE} || '</data><data key="depth">' || p_size || '</data><data key="is_seed">' || (p_size % 2 = 0)::VARCHAR || '</data></node>' AS value FROM part
UNION ALL SELECT i || ' ' || j, '<edge source="' || i || '" target="' || j || '"/>' FROM e""")  # fmt: skip
def graphml_lines(spark, d):
    return sinks.graphml(xml_nodes(spark, d), network(spark, d)[1]).where("id <> ''").select("id", "value")


@query("gexf_lines", f"""WITH {RAW} SELECT '10.1234/p' || p_partkey AS id, '<node id="10.1234/p' || p_partkey || '" label="' || {TITLE} || '"/>' AS value FROM part
UNION ALL SELECT i || ' ' || j, '<edge id="' || i || ' ' || j || '" source="' || i || '" target="' || j || '" label="cites"/>' FROM e""")  # fmt: skip
def gexf_lines(spark, d):
    return sinks.gexf(xml_nodes(spark, d), network(spark, d)[1].withColumn("label", F.lit("cites"))).where("id <> ''").select("id", "value")


@query("graph_files", f"""WITH {RAW} SELECT 'graphml' AS format, 'node' AS kind, '10.1234/p' || p_partkey AS id, '<' || p_name || '> & "' || p_brand || '"' AS title FROM part UNION ALL SELECT 'graphml', 'edge', i || ' ' || j, NULL FROM e
UNION ALL SELECT 'gexf', 'node', '10.1234/p' || p_partkey, '<' || p_name || '> & "' || p_brand || '"' FROM part UNION ALL SELECT 'gexf', 'edge', i || ' ' || j, 'cites' FROM e""")  # fmt: skip
def graph_files(spark, d):
    """The nodes and edges of the network as the files of two formats give them back."""

    def make(s, f, path):
        edges = network(s, f)[1].withColumn("label", F.lit("cites"))
        sinks.save_document(sinks.graphml(xml_nodes(s, f), edges), f"{path}/graphml")
        sinks.save_document(sinks.gexf(xml_nodes(s, f), edges), f"{path}/gexf")

    path = shared_path(spark, d, "graph-files", make)
    out = None
    for name, (nodes, edges) in {"graphml": sinks.read_graphml(spark, f"{path}/graphml"), "gexf": sinks.read_gexf(spark, f"{path}/gexf")}.items():
        label = F.col("label") if name == "gexf" else F.lit(None).cast("string")
        rows = nodes.select(F.lit(name).alias("format"), F.lit("node").alias("kind"), F.col("doi").alias("id"), "title")
        rows = rows.union(edges.select(F.lit(name), F.lit("edge"), F.concat_ws(" ", "source_doi", "target_doi"), label))
        out = rows if out is None else out.union(rows)
    return out


@query("layout_degrees", f"WITH {RAW}, {DEG}, g AS (SELECT doi, in_degree + out_degree AS degree FROM deg) SELECT doi, degree, 15 + 3 * degree AS size, round(0.66 * (1 - (degree - (SELECT min(degree) FROM g)) / nullif((SELECT max(degree) - min(degree) FROM g), 0)::DOUBLE), 8) AS hue FROM g")
def layout_degrees(spark, d):
    nodes, edges = network(spark, d)
    return sinks.degree_layout(nodes, graph.degrees(nodes, edges)).withColumn("hue", F.round("hue", 8))


# Knowledge graphs -----------------------------------------------------------------------------------------------

CLEAN = "list_aggregate(list_transform(string_split({0}, ' '), lambda w: upper(left(w, 1)) || substring(w, 2)), 'string_agg', ' ')"
#: Names that need no synonym: only letters' case, a qualifier and a plural matter.
MINED = """mined AS (SELECT c_nationkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'High ' || lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 2 THEN 'GBs' ELSE 'one two three four five six' END AS source,
  CASE c_custkey % 5 WHEN 0 THEN 'Copper' WHEN 1 THEN 'polycrystalline copper' WHEN 2 THEN lower(c_mktsegment) WHEN 3 THEN 'TPMS' ELSE 'mean curvature' END AS target, ' Rel' || c_custkey % 3 || ' ' AS relation FROM customer),
low AS (SELECT doc_id, lower(regexp_replace(source, '^High ', '')) AS s, lower(target) AS t, lower(trim(relation)) AS relation FROM mined),
syn AS (SELECT doc_id, CASE s WHEN 'gbs' THEN 'grain boundary' ELSE s END AS s, CASE t WHEN 'tpms' THEN 'minimal surface' ELSE t END AS t, relation FROM low),
one AS (SELECT doc_id, CASE WHEN s LIKE '%s' AND s NOT LIKE '%ss' THEN left(s, length(s) - 1) ELSE s END AS s, CASE WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END AS t, relation FROM syn),
tri AS (SELECT doc_id, """ + CLEAN.format("s") + " AS source, " + CLEAN.format("t") + " AS target, relation FROM one WHERE len(string_split(s, ' ')) <= 5 AND s <> t)"  # fmt: skip


def kg(spark, d):
    n, seg = F.col("c_custkey"), F.col("c_mktsegment")
    source = F.when(n % 4 == 0, F.concat(F.lit("High "), F.lower(seg))).when(n % 4 == 1, seg).when(n % 4 == 2, "GBs").otherwise("one two three four five six")
    target = F.when(n % 5 == 0, "Copper").when(n % 5 == 1, "polycrystalline copper").when(n % 5 == 2, F.lower(seg)).when(n % 5 == 3, "TPMS").otherwise("mean curvature")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), source.alias("source"), target.alias("target"), F.concat(F.lit(" Rel"), (n % 3).cast("string"), F.lit(" ")).alias("relation"))
    return knowledge.triplets(rows)


@query("kg_triplets", f"WITH {MINED} SELECT doc_id, source, target, relation FROM tri")
def kg_triplets(spark, d):
    return kg(spark, d)


@query("kg_entities", f"WITH {MINED} SELECT doc_id, source AS entity FROM tri UNION SELECT doc_id, target FROM tri")
def kg_entities(spark, d):
    return knowledge.entities(kg(spark, d))


ALIGNED = f"{MINED}, al AS (SELECT DISTINCT doc_id, CASE source WHEN 'Grain Boundary' THEN 'Copper' ELSE source END AS source, CASE target WHEN 'Mean Curvature' THEN 'Minimal Surface' ELSE target END AS target, relation FROM tri)"


def aligned(spark, d):
    rows = kg(spark, d)
    names = rows.select("doc_id").distinct().withColumn("x", F.explode(F.array(*[F.struct(F.lit(a).alias("entity"), F.lit(b).alias("name")) for a, b in (("Grain Boundary", " Copper"), ("Mean Curvature", "Minimal Surface "))]))).select("doc_id", "x.*")
    return knowledge.aligned(rows, names)


@query("kg_align", f"WITH {ALIGNED} SELECT doc_id, source, target, relation FROM al WHERE source <> target")
def kg_align(spark, d):
    return aligned(spark, d)


@query("kg_domain", f"WITH {MINED}, n AS (SELECT doc_id, source AS x FROM tri UNION SELECT doc_id, target FROM tri), f(source, target, relation) AS (VALUES ('Mean Curvature', 'Minimal Surface', 'defines'), ('Polycrystalline Copper', 'Copper', 'is form of')) SELECT a.doc_id, f.source, f.target, f.relation FROM f JOIN n a ON a.x = f.source JOIN n b ON b.x = f.target AND b.doc_id = a.doc_id")
def kg_domain(spark, d):
    return knowledge.domain_edges(kg(spark, d))


@query("kg_graph", f"WITH {ALIGNED}, g AS (SELECT doc_id, least(source, target) AS a, greatest(source, target) AS b, string_agg(DISTINCT relation, '|' ORDER BY relation) AS relations FROM al WHERE source <> target GROUP BY ALL) SELECT doc_id, a || ' - ' || b AS name, relations FROM g UNION ALL SELECT doc_id, x, count(*)::VARCHAR FROM (SELECT doc_id, a AS x FROM g UNION ALL SELECT doc_id, b FROM g) GROUP BY doc_id, x")
def kg_graph(spark, d):
    nodes, edges = knowledge.graph_tables(aligned(spark, d))
    lines = edges.select("doc_id", F.concat_ws(" - ", "source", "target").alias("name"), F.array_join("relations", "|").alias("relations"))
    return lines.union(nodes.select("doc_id", "entity", F.col("degree").cast("string")))


@query("article_order", "WITH a AS (SELECT l_orderkey, 'T' || l_partkey % 5 AS title, min(l_linenumber) AS first_ref FROM lineitem GROUP BY ALL) SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_ref, title) AS place, title, first_ref FROM a")
def article_order(spark, d):
    from ..operators.citations import ordered_articles

    rows = table(spark, d, "lineitem").groupBy("l_orderkey", F.concat(F.lit("T"), (F.col("l_partkey") % 5).cast("string")).alias("title")).agg(F.min("l_linenumber").alias("first_ref"))
    return ordered_articles(rows, "l_orderkey", "title").select("l_orderkey", "place", "title", "first_ref")


@query("feature_report")
def feature_report(spark, d):
    from .graph_queries import correlation, coverage_audit, feature_coverage

    return sinks.report(feature_coverage(spark, d), coverage_audit(spark, d), correlation(spark, d), {"seeds": SEEDS})
