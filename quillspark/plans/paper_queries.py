"""Queries on the texts of papers: forms of words, model answers, sections, equations, figures, searches, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import providers
from ..functions import jsons, vector
from ..functions import text as fx
from ..operators import citations as ct
from ..operators import evaluation as ev
from ..operators import ingest, knowledge, matching, sections
from ..operators import markdown as md
from ..operators import retrieval as rt
from ..sources import layout
from ..sources.tables import table
from .rag import index
from .text_queries import BLOCKS, CITED, MERGED, ORDERED, SHAPED, cited, docs, ordered, paragraphs, shaped, told

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


# Forms of words -------------------------------------------------------------------------------------------------

RAW_IDS = ["null", "", "", "x (https://doi.org/10.1234/AB{}) y", '{"a": "doi: 10.5555/z{}"]}', "https://openalex.org/W{}/"]


@query("identifier_forms", r"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'null' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'x (https://doi.org/10.1234/AB' || p_partkey || ') y' WHEN 4 THEN '{"a": "doi: 10.5555/z' || p_partkey || '"]}' ELSE 'https://openalex.org/W' || p_partkey || '/' END AS raw, p_name, p_size FROM part)
SELECT p_partkey, raw IS NULL OR raw IN ('', 'null') AS empty, nullif(regexp_extract(raw, '(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,9}/[^\s\])"]+)', 1), '') AS first_doi, string_split(rtrim(raw, '/'), '/')[-1] AS short_id,
'title::' || nullif(trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), '') AS title_key, left(trim(regexp_replace(regexp_replace(repeat(p_name || ': a/b? ', 1 + p_size), '[<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g')), 200) AS file_name,
CASE WHEN p_size % 3 <> 2 THEN 'u' || p_size % 3 END AS owner, CASE WHEN p_size % 3 <> 2 THEN 'd' || p_size % 2 END AS dataset FROM r""")  # fmt: skip
def identifier_forms(spark, d):
    raw = told(F.col("p_partkey") % 6, RAW_IDS, F.col("p_partkey"))
    raw = F.when(F.col("p_partkey") % 6 == 2, F.lit(None)).otherwise(raw)
    size = F.col("p_size")
    path = F.when(size % 3 == 2, "somewhere/else.pdf").otherwise(F.concat(F.lit("users/u"), (size % 3).cast("string"), F.lit("\\d"), (size % 2).cast("string"), F.lit("\\raw\\documents\\f.pdf")))
    long = F.repeat(F.concat("p_name", F.lit(": a/b? ")), size + 1)
    rows = part(spark, d).select("p_partkey", raw.alias("raw"), long.alias("long"), fx.path_parts(path).alias("path"))
    x = F.col("raw")
    return rows.select("p_partkey", fx.is_empty_doi(x).alias("empty"), fx.first_doi(x).alias("first_doi"), fx.short_id(x).alias("short_id"), fx.title_key(x).alias("title_key"), fx.file_name(F.col("long")).alias("file_name"), F.col("path.user").alias("owner"), F.col("path.dataset").alias("dataset"))


@query("record_forms", """SELECT p_partkey, p_name || '|' || p_type || '|x' AS keywords, replace(p_brand, '#', '') || (1900 + p_size) || string_split(p_name, ' ')[1] AS citation_key, p_name || '; ' || p_type AS authors, left(p_name || ' ' || p_type, 15) AS abstract,
CASE p_partkey % 4 WHEN 0 THEN 1.5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE p_size::DOUBLE END AS number, 'in crystals ⟦SUP:8,' || p_size || '⟧. Then Fig. 3 The' AS marked, 'in crystals ^{8,' || p_size || '}. Then Fig. 3 The' AS rendered FROM part""")  # fmt: skip
def record_forms(spark, d):
    size = F.col("p_size").cast("string")
    words = F.concat(F.lit("# Keywords: "), "p_name", F.lit(", "), "p_type", F.lit(", ,x"))
    text = F.concat(F.lit("# Head\n\n"), "p_name", F.lit("\n\n$$x$$\n \n"), "p_type")
    said = told(F.col("p_partkey") % 4, ["1.5", "NaN", "x", "{}"], F.col("p_size"))
    marked = ct.mark_superscripts(F.concat(F.lit("in crystals.8,"), size, F.lit(" Then Fig. 3 The")))
    return part(spark, d).select(
        "p_partkey", F.array_join(fx.keywords(words), "|").alias("keywords"), fx.citation_key(F.col("p_brand"), F.col("p_size") + 1900, F.col("p_name")).alias("citation_key"), fx.authors_text(F.array("p_name", "p_type")).alias("authors"),
        fx.abstract_of(text, 15).alias("abstract"), fx.as_double(said).alias("number"), marked.alias("marked"), ct.render_markers(marked).alias("rendered"),
    )


@query("vector_forms", "SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN NULL ELSE list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])) END, 8) AS raw, round(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])) END, 8) AS zeroed FROM embeddings")
def vector_forms(spark, d):
    v = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.cosine_raw(v, F.reverse("embedding")), 8).alias("raw"), F.round(vector.cosine(v, F.reverse("embedding")), 8).alias("zeroed"))


# Model answers --------------------------------------------------------------------------------------------------

LABELS = ['{"label": " Parallel ", "reason": "r{}"}', "I think Inheritance it is, {}", "no idea {}", 'so: {"label": "odd"} or peripheral']


@query("answer_labels", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'parallel' WHEN 1 THEN 'inheritance' WHEN 2 THEN 'unknown' ELSE 'peripheral' END AS label, CASE p_partkey % 4 WHEN 0 THEN 'r' || p_size ELSE '' END AS reason FROM part""")
def answer_labels(spark, d):
    said = F.concat(F.replace(told(F.col("p_partkey") % 4, [x.replace('{"label"', '<"label"') for x in LABELS], F.col("p_size")), F.lit('<"label"'), F.lit('{"label"')))
    return part(spark, d).select("p_partkey", jsons.parse_label(said).alias("x")).select("p_partkey", "x.label", "x.reason")


ENTITIES = ['["a{}", "b"]', 'Here: ["x{}"] as asked', "none", '["c\\d{}"]']


@query("answer_entities", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a' || p_size || '|b' WHEN 1 THEN 'x' || p_size WHEN 3 THEN 'c\d' || p_size END AS entities FROM part""")
def answer_entities(spark, d):
    said = told(F.col("p_partkey") % 4, ENTITIES, F.col("p_size"))
    return part(spark, d).select("p_partkey", F.array_join(jsons.parse_entities(said), "|").alias("entities"))


@query("answer_relations", """SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '' ELSE 'e' || p_size END AS entities, CASE p_partkey % 3 WHEN 0 THEN 'a' || p_size || '>b' WHEN 1 THEN 's>t' || p_size END AS relations FROM part""")
def answer_relations(spark, d):
    size = F.col("p_size").cast("string")
    pairs = F.concat(F.lit('{"entities": ["e'), size, F.lit('"], "relations": [["a'), size, F.lit('", "b"], ["one"]]}'))
    objects = F.concat(F.lit('{"entities": ["e'), size, F.lit('"], "relations": [{"source": "s", "target": "t'), size, F.lit('"}]}'))
    said = F.when(F.col("p_partkey") % 3 == 0, pairs).when(F.col("p_partkey") % 3 == 1, objects).otherwise("nothing")
    x = part(spark, d).select("p_partkey", jsons.parse_relations(said).alias("x"))
    return x.select("p_partkey", F.array_join("x.entities", "|").alias("entities"), F.array_join(F.transform("x.relations", lambda r: F.concat(r["source"], F.lit(">"), r["target"])), "|").alias("relations"))


@query("answer_scores", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a:' || p_size || '.0|b:0.5' END AS scores FROM part""")
def answer_scores(spark, d):
    one = F.concat(F.lit('[{"entity": "a", "specificity": 1}, {"entity": "b", "specificity": 0.5}, {"entity": "a", "specificity": '), F.col("p_size").cast("string"), F.lit("}]"))
    x = part(spark, d).select("p_partkey", jsons.parse_scores(F.when(F.col("p_partkey") % 2 == 0, one).otherwise("no list")).alias("m"))
    return x.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "|").alias("scores"))


@query("equation_answers", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x is the size ' || p_size END AS description FROM part")
def equation_answers(spark, d):
    said = told(F.col("p_partkey") % 3, ["x is the size {}", "Not clear from what is given here", "too short"], F.col("p_size"))
    return sections.described(part(spark, d).select("p_partkey", said.alias("answer"))).select("p_partkey", "description")


@query("chat_answers", "SELECT p_partkey, 'answer ' || left(sha256('Name ' || p_name), 8) AS answer FROM part")
def chat_answers(spark, d):
    rows = part(spark, d).select("p_partkey", F.concat(F.lit("Name "), "p_name").alias("prompt"))
    return providers.chat(rows, "prompt", providers.provider(providers.CHAT, "echo")).select("p_partkey", "answer")


# Sentences, equations, figures ----------------------------------------------------------------------------------

_DOTS = "x"
for _a in md.ABBREVIATIONS:
    _DOTS = f"replace({_DOTS}, '{_a}', '{_a.replace('.', md.DOT)}')"


@query("paragraph_sentences", rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || chr(10) || '# Head' || chr(10) || 'See Fig. 3 of 2.5 mm, e.g. here. And so on!', '(?s)\$\$.*?\$\$', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\$[^$\n]*\$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t), k AS (SELECT * FROM l WHERE regexp_matches(x, '\p{{L}}') AND NOT regexp_matches(x, '^\s*#')),
s AS (SELECT doc_id, n, regexp_replace(regexp_replace({_DOTS}, '(\d)\.(\d)', '\1{md.DOT}\2', 'g'), '([.!?])\s+', '\1<S>', 'g') AS y FROM k),
p AS (SELECT doc_id, n, unnest(string_split(y, '<S>')) AS z, generate_subscripts(string_split(y, '<S>'), 1) AS m FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, m) - 1 AS pos, md5(replace(regexp_replace(z, '^\s+|\s+$', '', 'g'), '{md.DOT}', '.')) AS sentence_md5 FROM p WHERE regexp_replace(z, '^\s+|\s+$', '', 'g') <> ''""")  # fmt: skip
def paragraph_sentences(spark, d):
    text = F.concat("text", F.lit("\n# Head\nSee Fig. 3 of 2.5 mm, e.g. here. And so on!"))
    return md.document_sentences(docs(spark, d), "doc_id", text).select("doc_id", "pos", F.md5("sentence").alias("sentence_md5"))


EQUATIONS = ["Plain it is.", "Let $x = {} + b$ hold.", "Tiny $a$ only.", "As $$E = m^{}$$ says."]


@query("equation_contexts", f"""WITH s AS (SELECT doc_id, pos // 2 AS block, pos, (l_partkey + l_suppkey) % 4 AS kind, a, b FROM ({ORDERED})),
t AS (SELECT *, CASE kind WHEN 0 THEN 'Plain it is.' WHEN 1 THEN 'Let $x = ' || a || ' + b$ hold.' WHEN 2 THEN 'Tiny $a$ only.' ELSE 'As $$E = m^' || a || '$$ says.' END AS sentence FROM s),
c AS (SELECT *, string_agg(sentence, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM t)
SELECT doc_id, pos, '$x = ' || a || ' + b$' AS equation, context FROM c WHERE kind = 1 UNION ALL SELECT doc_id, pos, '$$E = m^' || a || '$$', context FROM c WHERE kind = 3""")  # fmt: skip
def equation_contexts(spark, d):
    kind = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(4))
    rows = ordered(spark, d).select("doc_id", F.expr("pos div 2").alias("block"), "pos", told(kind, EQUATIONS, F.col("a")).alias("sentence"))
    return sections.equation_rows(rows).select("doc_id", "pos", "equation", "context")


FIGURES = ["![a](images/{}.jpg)", "Fig. 1. What {} shows", "plain {}"]


@query("figure_groups", f"""WITH s AS (SELECT *, (l_partkey + l_suppkey) % 3 AS kind FROM ({ORDERED})), m AS (SELECT *, CASE WHEN kind = 0 AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), 9) <> 0 THEN 1 ELSE 0 END AS new FROM s), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM m)
SELECT doc_id, string_agg('images/' || a || '.jpg', '|' ORDER BY pos) FILTER (WHERE kind = 0) AS images, coalesce(string_agg(CASE kind WHEN 1 THEN 'Fig. 1. What ' || a || ' shows' ELSE 'plain ' || a END, ' ' ORDER BY pos) FILTER (WHERE kind <> 0), '') AS description FROM g WHERE g > 0 GROUP BY doc_id, g""")  # fmt: skip
def figure_groups(spark, d):
    kind = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(3))
    rows = ordered(spark, d).select("doc_id", "pos", told(kind, FIGURES, F.col("a")).alias("line"))
    return md.figure_groups(rows).select("doc_id", F.array_join("figure", "|").alias("images"), "description")


# Sections -------------------------------------------------------------------------------------------------------


@query("clean_documents", f"""WITH {MERGED} SELECT doc_id, md5('## T' || doc_id || coalesce(chr(10) || chr(10) || string_agg(CASE WHEN starts_with(content, '# ') THEN '#' || content ELSE content END, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE category IN ('main_letter', 'equation')), '')) AS document_md5 FROM documents LEFT JOIN merged USING (doc_id) GROUP BY doc_id""")
def clean_documents(spark, d):
    rows = md.classify_blocks(shaped(spark, d)).withColumn("category", F.when(F.col("category") == "undecided", "main_letter").otherwise(F.col("category")))
    titles = docs(spark, d).select("doc_id", F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"))
    return md.clean_document(md.merge_adjacent(rows), titles).select("doc_id", F.md5("document").alias("document_md5"))


@query("main_sections", f"""WITH {SHAPED}, b AS (SELECT *, pos = 1 AND doc_id % 2 = 0 AS title_here FROM flags), f AS (SELECT *, min(pos) FILTER (WHERE title_here) OVER (PARTITION BY doc_id) AS t FROM b), g AS (SELECT * FROM f WHERE t IS NULL OR pos >= t),
h AS (SELECT *, min(pos) OVER w AS first, min(pos) FILTER (WHERE is_reference) OVER w AS ref FROM g WINDOW w AS (PARTITION BY doc_id)), e AS (SELECT *, min(pos) FILTER (WHERE pos > ref AND regexp_matches(content, '^#\\s+\\w')) OVER (PARTITION BY doc_id) AS stop FROM h)
SELECT doc_id, pos, CASE WHEN pos = first THEN 'title' WHEN pos >= ref THEN 'references' ELSE 'other' END AS category FROM e WHERE stop IS NULL OR pos < stop""")  # fmt: skip
def main_sections(spark, d):
    """The second block of every other document is its title, in other letters and with a mark; the others' titles are nowhere."""
    rows = shaped(spark, d)
    second = rows.where("pos = 1 and doc_id % 2 = 0").select("doc_id", F.concat(F.lit("## "), F.lower("content")).alias("title"))
    titles = docs(spark, d).select("doc_id").join(second, "doc_id", "left").withColumn("title", F.coalesce("title", F.repeat(F.lit("zq "), 9000)))
    first = rows.join(second.select("doc_id"), "doc_id", "left_semi").where("pos >= 1").union(rows.join(second.select("doc_id"), "doc_id", "left_anti"))
    early = rows.join(second.select("doc_id"), "doc_id", "left_semi").where("pos < 1").withColumn("content", F.concat("content", F.repeat(F.lit(" padding"), 900)))
    return sections.main_section(first.union(early), titles).select("doc_id", "pos", "category")


LINES = ["[{}] Some reference of it", "", "Plain prose of {}.", "({}) Another one of them", "{}. The last kind of entry"]
LINED = """l AS (SELECT p_size AS doc_id, p_partkey AS pos, CASE WHEN p_size % 4 = 0 AND p_partkey % 11 = 3 THEN 9 ELSE p_partkey % 7 END AS kind FROM part),
n AS (SELECT *, CASE kind WHEN 9 THEN '# References' WHEN 0 THEN '[' || pos || '] Some reference of it' WHEN 1 THEN '' WHEN 3 THEN '(' || pos || ') Another one of them' WHEN 4 THEN (pos % 100) || '. The last kind of entry' ELSE 'Plain prose of ' || pos || '.' END AS line, kind IN (0, 3, 4) AS entry, kind NOT IN (0, 1, 3, 4, 9) AS prose FROM l)"""


@query("reference_sections", f"""WITH {LINED}, e AS (SELECT *, min(pos) FILTER (WHERE kind = 9) OVER w AS head, count(*) FILTER (WHERE entry) OVER w AS entries, sum(CASE WHEN prose THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM n WINDOW w AS (PARTITION BY doc_id)),
g AS (SELECT doc_id, pos, p - lag(p) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM e WHERE entry AND head IS NULL AND entries >= 3), b AS (SELECT doc_id, coalesce(max(pos) FILTER (WHERE gap >= 2), min(pos)) AS start FROM g GROUP BY doc_id)
SELECT doc_id, pos, line FROM e LEFT JOIN b USING (doc_id) WHERE pos > head OR (head IS NULL AND pos >= start)""")  # fmt: skip
def reference_sections(spark, d):
    k, n = F.col("p_partkey") % 7, F.col("p_partkey")
    line = told(F.when(k == 0, 0).when(k == 1, 1).when(k == 3, 3).when(k == 4, 4).otherwise(2), LINES, F.when(k == 4, n % 100).otherwise(n))
    line = F.when((F.col("p_size") % 4 == 0) & (n % 11 == 3), "# References").otherwise(line)
    return sections.reference_section(part(spark, d).select(F.col("p_size").alias("doc_id"), n.alias("pos"), line.alias("line")))


@query("detail_categories", f"""WITH {SHAPED}, a AS (SELECT *, CASE WHEN pos % 5 = 0 THEN 'title' ELSE 'other' END AS given, length(content) >= 20 AND pos % 3 = 1 AS said FROM flags), f AS (SELECT *, min(pos) FILTER (WHERE given = 'other' AND said) OVER (PARTITION BY doc_id) AS abs FROM a)
SELECT doc_id, pos, CASE WHEN given <> 'other' THEN given WHEN pos = abs THEN 'abstract' WHEN is_figure THEN 'figure' WHEN is_table THEN 'table' WHEN is_equation THEN 'equation' WHEN length(content) > 100 THEN 'main_letter' ELSE 'other' END AS category FROM f""")  # fmt: skip
def detail_categories(spark, d):
    said = F.when(F.col("pos") % 3 == 1, " Abstract").otherwise("no")
    rows = shaped(spark, d).withColumn("category", F.when(F.col("pos") % 5 == 0, "title").otherwise("other")).withColumn("abstract", sections.is_abstract(F.col("content"), said))
    return sections.detail(rows, F.length("content") > 100).select("doc_id", "pos", "category")


@query("abstract_choice", f"""WITH {BLOCKS}, o AS (SELECT doc_id, content FROM blocks WHERE pos = 0) SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN lower(content) ELSE content END) AS chunk_md5, md5(CASE doc_id % 3 WHEN 0 THEN lower(content) ELSE content END) AS abstract_md5 FROM o""")
def abstract_choice(spark, d):
    """Known abstracts that are the chunk in small letters, that are something else, and that aren't known."""
    rows = paragraphs(spark, d).where("pos = 0").withColumn("category", F.lit("abstract"))
    known = rows.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lower("content")).otherwise("0 1 2 3 4 5 6 7 8 9").alias("abstract"))
    out, abstracts = sections.reconciled(rows, known)
    return out.join(abstracts, "doc_id").select("doc_id", F.md5("content").alias("chunk_md5"), F.md5("abstract").alias("abstract_md5"))


@query("main_letters", f"""WITH {SHAPED} SELECT doc_id, pos, CASE WHEN category <> 'undecided' THEN category WHEN contains(content, 'ing') THEN 'main_letter' ELSE 'other' END AS category FROM cat""")
def main_letters(spark, d):
    """Undecided blocks by a stand-in for a model."""
    rows = md.classify_blocks(shaped(spark, d))
    return sections.decided(rows, lambda prompts: [" Main_letter" if "ing" in p.split("\n", 1)[1] else "no" for p in prompts]).select("doc_id", "pos", "category")


@query("title_records", f"""WITH {BLOCKS}, b AS (SELECT doc_id, min(pos) AS pos FROM blocks WHERE pos % 3 = 2 GROUP BY doc_id), t AS (SELECT doc_id, content FROM blocks JOIN b USING (doc_id, pos)),
k AS (SELECT lower(trim(regexp_replace(regexp_replace(regexp_replace(content, '^#+\\s*', ''), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS f, min(doc_id) AS doi FROM t WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, md5(content) AS title_md5, doi FROM t LEFT JOIN k ON f <> '' AND f = lower(trim(regexp_replace(regexp_replace(regexp_replace(content, '^#+\\s*', ''), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')))""")  # fmt: skip
def title_records(spark, d):
    rows = paragraphs(spark, d).withColumn("category", F.when(F.col("pos") % 3 == 2, "title").otherwise("other"))
    records = rows.where("pos = 2 and doc_id % 2 = 0").select(F.concat(F.lit("## "), F.lower("content")).alias("title"), F.col("doc_id").alias("doi"))
    return sections.first_title(rows, records).select("doc_id", F.md5("title").alias("title_md5"), "doi")


@query("keyword_search", f"""WITH {BLOCKS}, c AS (SELECT doc_id, pos, CASE (doc_id + pos) % 7 WHEN 0 THEN 'keywords' WHEN 1 THEN 'abstract' WHEN 5 THEN 'main_letter' ELSE 'other' END AS category, CASE WHEN (doc_id + pos) % 7 = 3 THEN left(content, 8) ELSE content END AS content FROM blocks),
k AS (SELECT *, min(pos) FILTER (WHERE category = 'keywords') OVER (PARTITION BY doc_id) AS k FROM c), m AS (SELECT *, min(pos) FILTER (WHERE category = 'main_letter' AND pos > k) OVER (PARTITION BY doc_id) AS m FROM k)
SELECT doc_id, md5(string_agg(content, ', ' ORDER BY CASE category WHEN 'keywords' THEN 0 ELSE 1 END, pos)) AS keywords_md5 FROM m WHERE category = 'keywords' OR (category = 'other' AND pos > k AND (m IS NULL OR pos < m) AND len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda t: t <> '')) < 4 AND contains(content, 'e')) GROUP BY doc_id""")  # fmt: skip
def keyword_search(spark, d):
    k = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(7))
    rows = paragraphs(spark, d).withColumn("category", F.when(k == 0, "keywords").when(k == 1, "abstract").when(k == 5, "main_letter").otherwise("other"))
    rows = rows.withColumn("content", F.when(k == 3, F.substring("content", 1, 8)).otherwise(F.col("content")))
    return sections.keyword_text(rows, F.col("content").contains("e")).select("doc_id", F.md5("keywords").alias("keywords_md5"))


@query("heading_paths", """WITH h AS (SELECT p_size AS doc_id, p_partkey AS pos, 1 + (p_partkey * 7 + p_size) % 6 AS level, 'H' || p_partkey AS title FROM part), u AS (SELECT *, (SELECT max(p.pos) FROM h p WHERE p.doc_id = h.doc_id AND p.pos < h.pos AND p.level < h.level) AS up FROM h),
r AS (WITH RECURSIVE t(doc_id, pos, above, path) AS (SELECT doc_id, pos, up, title FROM u UNION ALL SELECT t.doc_id, t.pos, u.up, u.title || ' > ' || t.path FROM t JOIN u ON u.doc_id = t.doc_id AND u.pos = t.above) SELECT * FROM t WHERE above IS NULL) SELECT doc_id, pos, path FROM r""")  # fmt: skip
def heading_paths(spark, d):
    heads = part(spark, d).select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("pos"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 6 + 1).cast("int").alias("level"), F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("title"))
    return sections.heading_paths(heads).select("doc_id", "pos", "path")


@query("json_chunks", "SELECT doc_id, i AS pos, substring(text, i::INT * 900 + 1, 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(length(text) - 301, 0) // 900 + 1)) AS i FROM documents WHERE text <> '')")
def json_chunks(spark, d):
    rows = docs(spark, d).select("doc_id", F.to_json(F.struct(F.col("text").alias("content"), "lang")).alias("json"))
    return md.json_chunks(rows)


@query("reference_links", r"""WITH e AS (SELECT c_custkey, 1 AS k, 'Seen in ' || c_mktsegment || ' by ' || c_name || ', 2001' AS entry FROM customer UNION ALL SELECT c_custkey, 2, 'Nothing of what is known at all' FROM customer),
w AS (SELECT c_custkey, k, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(entry), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= 3))) AS w FROM e), t AS (SELECT c_custkey AS doi, unnest(['customer', lpad(c_custkey::VARCHAR, 9, '0')]) AS w FROM customer WHERE c_acctbal >= 0),
s AS (SELECT c_custkey, k, doi, count(*) AS shared FROM w JOIN t USING (w) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, k ORDER BY shared DESC, doi) AS r FROM s)
SELECT e.c_custkey || '-' || e.k AS ref_id, doi, shared FROM e LEFT JOIN b ON b.c_custkey = e.c_custkey AND b.k = e.k AND r = 1""")  # fmt: skip
def reference_links(spark, d):
    """Entries of reference sections, each with the record that shares most of its words; not all have one."""
    c = table(spark, d, "customer")
    text = F.concat(F.lit("# References\n[1] Seen in "), "c_mktsegment", F.lit(" by "), "c_name", F.lit(", 2001\n(2) Nothing of what is known at all\n3. short"))
    entries = c.select("c_custkey", F.posexplode(ct.split_references(text)).alias("pos", "text")).select(F.concat_ws("-", "c_custkey", F.col("pos") + 1).alias("ref_id"), "text")
    titles = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("doi"), F.col("c_name").alias("title"))
    return matching.best_record(entries, titles)


@query("mined_triplets", f"""WITH {BLOCKS}, c AS (SELECT doc_id, substring(content, i * 3000 + 1, 3000) AS chunk FROM (SELECT doc_id, content, unnest(range((length(content) + 2999) // 3000)) AS i FROM blocks)) SELECT doc_id, 'part' AS path, 'n' || length(chunk) AS source, 'block' AS target, 'is in' AS relation FROM c WHERE length(chunk) % 2 = 0""")
def mined_triplets(spark, d):
    """Triplets that a stand-in for a model names in blocks of even length."""

    def model(prompts):
        sizes = [len(p.split("\n", 2)[2]) for p in prompts]
        return [f'[{{"source": "n{n}", "target": "block", "relation": "is in"}}]' if n % 2 == 0 else "none" for n in sizes]

    chunks = paragraphs(spark, d).select("doc_id", F.lit("part").alias("path"), F.explode(md.windows_of(F.col("content"), 3000)).alias("chunk"))
    return knowledge.mined(chunks, model)


@query("citation_styles", f"WITH {CITED} SELECT style, forms AS form, count(*) AS citations FROM k GROUP BY ALL")
def citation_styles(spark, d):
    return ct.style_counts(cited(spark, d))


# Searches and stores --------------------------------------------------------------------------------------------


@query("web_messages", """WITH r AS (SELECT conv_id AS query_id, turn AS pos, role AS title, CASE WHEN (conv_id + turn) % 3 > 0 AND conv_id % 5 > 0 THEN 'http://x/' || conv_id || '/' || turn END AS href, left(coalesce(text, ''), 20) AS body FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, title, href, body) AS n FROM r WHERE href IS NOT NULL)
SELECT query_id, coalesce((SELECT string_agg('[' || n || '] ' || coalesce(title, '') || chr(10) || href || chr(10) || body, chr(10) || chr(10) ORDER BY n) FROM k WHERE k.query_id = r.query_id), 'Can''t find any result.') AS message FROM r GROUP BY query_id""")  # fmt: skip
def web_messages(spark, d):
    return rt.search_message(found_pages(spark, d))


def found_pages(spark, d):
    id_, turn = F.col("conv_id"), F.col("turn")
    href = F.when(((id_ + turn) % 3 > 0) & (id_ % 5 > 0), F.concat(F.lit("http://x/"), id_.cast("string"), F.lit("/"), turn.cast("string")))
    return table(spark, d, "conversations").select(id_.alias("query_id"), turn.alias("pos"), F.col("role").alias("title"), href.alias("href"), F.substring(F.coalesce("text", F.lit("")), 1, 20).alias("body"))


@query("web_fallback", "SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 = 0 THEN 'first' WHEN c_custkey % 4 < 3 THEN 'second' END AS method, CASE WHEN c_custkey % 4 = 0 THEN 'A ' || c_name WHEN c_custkey % 4 < 3 THEN 'B ' || c_name END AS message FROM customer")
def web_fallback(spark, d):
    k = F.col("c_custkey") % 4
    one = F.when(k == 0, F.concat(F.lit("A "), "c_name")).when(k == 1, "Can't find any result.").when(k == 2, "Error: down")
    two = F.when(k < 3, F.concat(F.lit("B "), "c_name")).otherwise("Error 500")
    cells = F.explode(F.array(F.struct(F.lit(1).alias("priority"), F.lit("first").alias("method"), one.alias("message")), F.struct(F.lit(2).alias("priority"), F.lit("second").alias("method"), two.alias("message")))).alias("x")
    return rt.first_answer(table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), cells).select("query_id", "x.*"))


@query("query_expansion", "SELECT p_partkey AS query_id, 0 AS pos, p_name AS query FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part UNION ALL SELECT p_partkey, 2, p_brand FROM part")
def query_expansion(spark, d):
    rows = part(spark, d).select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.concat(F.lit("\n "), "p_type", F.lit("\n\n"), "p_brand", F.lit(" \n")).alias("answer"))
    return rt.expand_queries(rows)


@query("web_prompts", "SELECT p_partkey, md5('Answer the question with these search results.' || chr(10) || chr(10) || 'Results:' || chr(10) || p_type || chr(10) || chr(10) || 'Question: ' || p_name) AS prompt_md5 FROM part")
def web_prompts(spark, d):
    return part(spark, d).select("p_partkey", F.md5(rt.web_prompt(F.col("p_name"), F.col("p_type"))).alias("prompt_md5"))


STORE = "store AS (SELECT source, doc_id FROM documents WHERE source <> 'src3' AND doc_id % 3 = 0)"


def store_of(spark, d):
    return docs(spark, d).where("source <> 'src3' and doc_id % 3 = 0").select("source", "doc_id")


@query("source_check", f"WITH {STORE} SELECT DISTINCT source, source IN (SELECT source FROM store) AS there FROM documents")
def source_check(spark, d):
    return rt.known_sources(store_of(spark, d), docs(spark, d))


@query("store_append", f"WITH {STORE} SELECT source, doc_id FROM store WHERE source <> 'src5' UNION ALL SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT source FROM store)")
def store_append(spark, d):
    return rt.delete_source(rt.append(store_of(spark, d), docs(spark, d).select("source", "doc_id")), "src5")


@query("indexed_chunks", f"WITH {STORE} SELECT doc_id, 64 AS dims FROM documents WHERE source NOT IN (SELECT source FROM store)")
def indexed_chunks(spark, d):
    chunks = docs(spark, d).select("doc_id", "source", F.col("text").alias("content"))
    return index(chunks, store_of(spark, d)).select("doc_id", F.size("embedding").alias("dims"))


@query("relation_strength", """WITH i AS (SELECT DISTINCT l_returnflag AS sample, l_partkey || '-' || l_suppkey AS item, l_suppkey % 11 AS s, l_partkey % 3 AS k FROM lineitem) SELECT sample, round(avg(CASE WHEN k > 0 THEN s ELSE 0 END), 4) AS rs FROM i GROUP BY sample""")
def relation_strength(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("item"), "l_partkey", "l_suppkey")
    scores = items.where("l_partkey % 3 > 0").select("sample", "item", (F.col("l_suppkey") % 11).cast("double").alias("score")).distinct()
    return ev.mean_score(items, scores, ["sample"], "rs")


@query("author_year_lookup", """WITH m AS (SELECT DISTINCT p_size AS doc_id, string_split(p_name, ' ')[1] AS surname, (1990 + p_partkey % 3)::VARCHAR AS year FROM part), r AS (SELECT p_size AS doc_id, p_partkey AS ref_pos, 'By ' || p_name AS text, 'Ann ' || p_brand AS author, (1990 + p_partkey % 3)::VARCHAR AS year FROM part)
SELECT m.doc_id, surname, m.year, min(ref_pos) AS ref_pos FROM m LEFT JOIN r ON r.doc_id = m.doc_id AND r.year = m.year AND (contains(lower(text), lower(surname)) OR contains(lower(author), lower(surname))) GROUP BY ALL""")  # fmt: skip
def author_year_lookup(spark, d):
    year = (F.col("p_partkey") % 3 + 1990).cast("string")
    p = part(spark, d)
    markers = p.select(F.col("p_size").alias("doc_id"), F.element_at(F.split("p_name", " "), 1).alias("surname"), year.alias("year"))
    refs = p.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("ref_pos"), F.concat(F.lit("By "), "p_name").alias("text"), F.array(F.concat(F.lit("Ann "), "p_brand")).alias("author"), year.alias("year"))
    return ct.find_author_year(markers, refs)


# Registry -------------------------------------------------------------------------------------------------------


@query("registry_hits", "SELECT file_name, file_size, CASE WHEN k THEN 'known' ELSE 'new' END AS state, CASE WHEN k THEN 'id' || least ELSE left(sha256(file_path || '|' || file_size), 26) END AS file_id FROM (SELECT source AS file_name, n_chars AS file_size, min(lang || '/' || lpad(doc_id::VARCHAR, 12, '0')) AS file_path, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS k, min(doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS least FROM documents GROUP BY ALL)")
def registry_hits(spark, d):
    rows = docs(spark, d).select("doc_id", F.col("source").alias("file_name"), F.col("n_chars").alias("file_size"), F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("file_path"))
    known = rows.join(table(spark, d, "labels"), "doc_id", "left_semi").groupBy("file_name", "file_size").agg(F.concat(F.lit("id"), F.min("doc_id").cast("string")).alias("file_id"))
    return ingest.registered(rows.drop("doc_id"), known).select("file_name", "file_size", "state", "file_id")


@query("doi_states", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'NOT_DOI' WHEN 1 THEN 'Doi_Getted' WHEN 2 THEN 'Doi_Info_Getted' ELSE 'Doi_Updated' END AS state, o_orderkey % 4 < 2 OR o_orderstatus = 'P' AS open, CASE WHEN o_custkey % 2 = 0 THEN 'cleared' ELSE o_orderstatus END AS parsing FROM orders""")
def doi_states(spark, d):
    k = F.col("o_orderkey") % 4
    rows = table(spark, d, "orders").withColumn("doi", F.when(k > 0, "10.1/x")).withColumn("info", F.when(k > 1, "{}")).withColumn("state", ingest.doi_state(F.col("doi"), F.col("info"), k == 3))
    rows = rows.withColumn("step", F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(k < 2, "Doing").otherwise("Done"))
    rows = ingest.reset_state(rows.withColumn("half", (F.col("o_custkey") % 2).cast("string")), "half", ["0"], "o_orderstatus", "cleared")
    open_ = ingest.pending(rows, "step").select("o_orderkey", F.lit(True).alias("open"))
    return rows.join(open_, "o_orderkey", "left").select("o_orderkey", "state", F.coalesce("open", F.lit(False)).alias("open"), F.col("o_orderstatus").alias("parsing"))


@query("title_duplicates", "SELECT p_partkey, p_name AS title, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) > 1 AS gone FROM part")
def title_duplicates(spark, d):
    return ingest.title_duplicates(part(spark, d).select("p_partkey", F.upper("p_name").alias("title"), "p_name"), ["p_partkey"]).select("p_partkey", F.col("p_name").alias("title"), "gone")


@query("cascade", "SELECT 'orders' AS stage, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey % 3 <> 0")
def cascade(spark, d):
    gone = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"))
    stages = {"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), "customer": table(spark, d, "customer").withColumnRenamed("c_custkey", "id")}
    left = ingest.delete_cascade(stages, gone, "id")
    out = [left[n].agg(F.lit(n).alias("stage"), F.count(F.lit(1)).alias("n")) for n in stages]
    return out[0].union(out[1])


@query("layout_paths", "SELECT p_partkey, 'users/u' || p_size || '/d/data_clean/' || p_partkey || '/doi.json' AS path, 'u' || p_size AS owner FROM part")
def layout_paths(spark, d):
    user = F.concat(F.lit("u"), F.col("p_size").cast("string"))
    rows = part(spark, d).select("p_partkey", layout.column(user, F.lit("d"), "data_clean", "doi.json", F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit("users/"), user, F.lit("/d/documents/a.pdf")).alias("file"))
    return rows.select("p_partkey", "path", layout.owner(F.col("file"))["user"].alias("owner"))
