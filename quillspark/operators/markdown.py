"""Markdown documents: blocks, sentences, chunks, block predicates, merging, sections, stitching."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIM = r"^\s+|\s+$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def numbered_parts(parts: Column) -> Column:
    """An array of texts, trimmed, without empty ones: to be exploded with positions."""
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def blocks(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, content): texts between lines of white space only."""
    return docs.select(key, F.posexplode(numbered_parts(F.split(text, r"\n\s*\n"))).alias("pos", "content"))


def sentences(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, sentence): cut after . ! ? and white space."""
    return docs.select(key, F.posexplode(numbered_parts(F.split(text, r"(?<=[.!?])\s+"))).alias("pos", "sentence"))


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["e.g.", "i.e.", "et al.", "etc.", "vs.", "cf.", "viz.", "approx.", "Fig.", "Figs.", "Eq.", "Eqs.", "Ref.", "Refs.", "No.", "Nos.", "Sec.", "Eqn.", "Tab.", "Dr.", "Prof.", "Mr.", "Ms."]
DOT = "\u0001"


def paragraph_sentences(c: Column) -> Column:
    """The sentences of a paragraph; abbreviations and decimal points don't end one."""
    for a in ABBREVIATIONS:
        c = F.replace(c, F.lit(a), F.lit(a.replace(".", DOT)))
    c = F.regexp_replace(c, r"(\d)\.(\d)", f"$1{DOT}$2")
    return F.transform(numbered_parts(F.split(c, r"(?<=[.!?])\s+")), lambda s: F.replace(s, F.lit(DOT), F.lit(".")))


def document_sentences(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, pos, sentence) over all lines with a letter that aren't headings, without equations and images."""
    x = F.regexp_replace(text, r"(?s)\$\$.*?\$\$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"!\[[^\]]*\]\([^)]*\)", ""), r"\$[^$\n]*\$", "")
    lines = F.filter(F.split(x, "\n"), lambda p: p.rlike(r"\p{L}") & ~trimmed(p).startswith("#"))
    return docs.select(key, F.posexplode(F.flatten(F.transform(lines, paragraph_sentences))).alias("pos", "sentence"))


def windows_of(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of `size` characters that share `overlap` with the one before; the last may be shorter."""
    step = size - overlap
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor(last / step).cast("int")), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def recursive_chunks(text: str | None, size: int = 1200, overlap: int = 300) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that gives such pieces."""
    separators = ["\n# ", "\n## ", "\n### ", "\n\n", "\n", ". ", " ", ""]

    def cut(t: str, level: int) -> list[str]:
        if len(t) <= size:
            return [t]
        sep = separators[level]
        if not sep:
            return [t[i : i + size] for i in range(0, len(t), size)]
        head, *rest = t.split(sep)
        parts = [head] + [sep + r for r in rest]
        return [x for p in parts if p for x in (cut(p, level + 1) if len(p) > size else [p])]

    out: list[str] = []
    held: list[str] = []
    length = 0
    for p in cut(text or "", 0):
        if held and length + len(p) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


#: Characters of chunks that leave a Python task at once.
AT_ONCE = 1 << 20


def rows_of_chunks(rows: DataFrame, key: str, text: str, chunks) -> DataFrame:
    """(key, pos, chunk) of what chunks(text) gives for each row: one text at a time is Python's, and chunks leave by AT_ONCE characters."""
    most, kind = AT_ONCE, rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            schema = pa.schema([pa.field(key, batch.schema.field(0).type), pa.field("pos", pa.int32()), pa.field("chunk", pa.string())])
            at, pos, out, held = [], [], [], 0
            for row in range(batch.num_rows):
                for i, c in enumerate(chunks(batch.column(1)[row].as_py())):
                    at.append(row)
                    pos.append(i)
                    out.append(c)
                    held += len(c)
                    if held >= most:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pos, pa.int32()), pa.array(out, pa.string())], schema=schema)
                        at, pos, out, held = [], [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pos, pa.int32()), pa.array(out, pa.string())], schema=schema)

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, pos int, chunk string")


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 300) -> DataFrame:
    """(key, pos, chunk) by recursive_chunks, row by row."""
    return rows_of_chunks(docs, key, text, lambda t: recursive_chunks(t, size, overlap))


def json_chunks(rows: DataFrame, key: str = "doc_id", json: str = "json", size: int = 1200, overlap: int = 300) -> DataFrame:
    """(key, pos, chunk): windows of the content that JSON documents have; what isn't such a document gives none."""
    text = F.get_json_object(json, "$.content")
    return rows.select(key, F.posexplode(F.coalesce(windows_of(text, size, overlap), F.array().cast("array<string>"))).alias("pos", "chunk"))


# Block predicates -----------------------------------------------------------------------------------------------

#: Where a word begins and ends: only ASCII letters, digits and _ belong to words, as in SQL. Java's own \b counts other letters too.
BEGIN, END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
#: The shapes of headings, entries, captions and markers.
REF_HEADER = r"(?i)^#\s*(?:references|bibliography)(?:\s+and\s+notes?)?\s*:?\s*$"
REF_ENTRY = r"^(?:\[\d+\]|\(\d+\)|\d+\.)\s+"
REF_LINE = r"(?m)^\s*[*†‡§¶#]*\s*\[\d+\]\s+"
IMAGE_ONLY, IMAGE = r"^\s*!\[\]\(images/[^)]+\)\s*$", "![](images/"
FIGURE, CAPTION, PANEL = r"(?i)(fig\.|figure)\s+\d+", r"(?i)^\s*(fig\.|figure)\s+\d+[.:]\s+", r"^\s*[(（][a-zA-Z][)）]\s*"
TABLE_CAPTION = r"(?i)^\s*table\s+\d+[\s.:]"
NUMBERED, WANTED = r"^\d+(\.\d+)*\..+", r"(?i)^(introduction|experimental|methods?|results?|discussion|conclusions?|summary)$"
UNWANTED, CONTACT, SUPPORT = r"^(ASSOCIATED CONTENT|AUTHOR INFORMATION|ACKNOWLEDGMENTS)$", r"(?i)^(corresponding authors?|author contributions)", r"(?i)supporting information"
METADATA = rf"(?i)({BEGIN}DOI{END}|doi\.org|email:|@)"
DISPLAY, INLINE = r"(?s)^\s*\$\$.*\$\$\s*$", r"^\s*\$[^$]{10,}\$\s*$"
CITED, SENTENCES = rf"\[\d+\]|\(\d{{4}}\)|{BEGIN}et al\.", r"[.!?]\s+[A-Z]"
LEGEND, SHOWN, SOURCED = r"(?i)^\s*(fig\.|figure|table)\s+\d+", rf"(?i){BEGIN}(fig\.|figure)\s*\d+", r"\[\d+[\d,\s\-–]+\]|\[\d+\]"


def is_reference(c: Column, least: int = 3) -> Column:
    many = (F.regexp_count(c, F.lit(REF_LINE)) >= least) & (F.regexp_count(c, F.lit("\n")) >= least - 1)
    return c.rlike(REF_HEADER) | c.rlike(REF_ENTRY) | many


def is_figure(c: Column, before: Column) -> Column:
    with_text = c.contains(IMAGE) & ((F.length(c) < 150) | c.rlike(FIGURE))
    caption = c.rlike(CAPTION) & ((F.length(c) < 1000) | (F.regexp_count(c, F.lit(r"\([a-hA-H]\)")) >= 2))
    return c.rlike(IMAGE_ONLY) | with_text | F.coalesce(before.contains(IMAGE), F.lit(False)) & (caption | c.rlike(PANEL))


def is_table(c: Column, after: Column) -> Column:
    return F.lower(c).contains("<table>") | F.coalesce(F.lower(after).contains("<table>"), F.lit(False)) & c.rlike(TABLE_CAPTION)


def is_equation(c: Column) -> Column:
    return c.rlike(DISPLAY) | c.rlike(INLINE)


def heading_state(c: Column) -> Column:
    """True for a heading of the main text, false for one of other matter, null else."""
    h = F.regexp_extract(trimmed(c), r"^#\s+(.+)$", 1)
    h = trimmed(h)
    state = F.when(h.rlike(NUMBERED) | h.rlike(WANTED), True).when(h.rlike(UNWANTED) | h.rlike(CONTACT) | h.rlike(SUPPORT), False)
    return F.when(h != "", state)


def skip_reason(c: Column) -> Column:
    return F.when(F.length(trimmed(c)) < 50, "too_short").when(c.rlike(METADATA), "metadata").when(F.regexp_count(c, F.lit(r"\$\$")) >= 2, "equation_only").otherwise("needs_check")


def is_likely_body(c: Column) -> Column:
    """Long text that cites, has sentences and is no legend."""
    return (F.length(c) >= 200) & c.rlike(CITED) & (F.regexp_count(c, F.lit(SENTENCES)) >= 2) & ~c.rlike(LEGEND)


def mentions_figure_or_source(c: Column) -> Column:
    """Long text that points to a figure or to a source."""
    return (F.length(c) >= 200) & (c.rlike(SHOWN) | c.rlike(SOURCED))


def classify_blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks() with category: the first rule that holds; `undecided` is left for a model."""
    w = Window.partitionBy(key).orderBy("pos")
    c, before, after = F.col("content"), F.lag("content").over(w), F.lead("content").over(w)
    rows = rows.withColumn("__before", before).withColumn("__after", after)
    state = heading_state(c)
    category = F.when(is_reference(c), "references").when(is_figure(c, F.col("__before")), "figure").when(is_table(c, F.col("__after")), "table").when(is_equation(c), "equation")
    category = category.when(state.isNotNull(), F.when(state, "main_letter").otherwise("other")).when(skip_reason(c) != "needs_check", "other")
    category = category.when(is_likely_body(c) | mentions_figure_or_source(c), "main_letter").otherwise("undecided")
    return rows.withColumn("category", category).drop("__before", "__after")


def merge_adjacent(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, category, content): without `other`; neighbours of one category figure or table as one block; references last, as one."""
    # references and the rest are told apart within one pass, so that what rows are made of is read once
    w = Window.partitionBy(key, "__refs").orderBy("pos")
    rows = rows.where((F.col("category") != "other") & (F.col("content") != "")).withColumn("__refs", F.col("category") == "references")
    new = F.when(F.col("category").isin("figure", "table") & (F.lag("category").over(w) == F.col("category")), 0).otherwise(1)
    rows = rows.withColumn("__new", new).withColumn("__g", F.when(F.col("__refs"), F.lit(2**40)).otherwise(F.sum("__new").over(w)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    both = rows.groupBy(key, "__refs", "__g").agg(F.first("category").alias("category"), parts.alias("parts"))
    both = both.select(key, "__g", F.when(F.col("__refs"), "reference").otherwise(F.col("category")).alias("category"), F.when(F.col("__refs"), F.array_join("parts", "\n")).otherwise(F.array_join("parts", "\n\n")).alias("content"))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("__g")) - 1).select(key, "pos", "category", "content")


def section_tree(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, level, title, parent_pos, content) of lines (key, pos, line): headings with their text.

    A heading's parent is the last one before it of a smaller level. Text before the first heading has none.
    """
    mark = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 1)
    lines = lines.withColumn("level", F.when(mark != "", F.length(mark))).withColumn("title", F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2))
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("owner", F.last(F.when(F.col("level").isNotNull(), F.col("pos")), ignorenulls=True).over(w))
    heads = lines.where("level is not null")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_of = [F.last(F.when(F.col("level") == n, F.col("pos")), ignorenulls=True).over(before) for n in range(1, 6)]
    parent = F.greatest(*[F.when(F.col("level") > n, last_of[n - 1]) for n in range(1, 6)])
    body = lines.where("level is null and owner is not null and trim(line) <> ''").groupBy(key, F.col("owner").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return heads.withColumn("parent_pos", parent).select(key, "pos", "level", "title", "parent_pos").join(body, [key, "pos"], "left").withColumn("content", F.coalesce("content", F.lit("")))


#: How a paragraph ends, with the numbers of what it cites behind its full stop.
ENDS_SENTENCE = r"\.(?:\d+(?:[,\-−–]\d+)*)?\s*$"


def stitch(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, category, content): main_letter blocks joined by spaces until one ends a sentence.

    Equations, tables and headings of the main text end a paragraph too. Other blocks between its parts follow it.
    Blocks up to such an end make a segment, which running counts tell apart: in each, what stands before its main
    text comes first, then the text, then what stood between, then what ended it.
    """
    w = Window.partitionBy(key).orderBy("pos")
    main, text = F.col("category") == "main_letter", F.col("content")
    heading = main & F.ltrim(text).startswith("#")
    stops = F.col("category").isin("equation", "table") | heading
    rows = rows.select(key, "pos", "category", "content").withColumn("__stop", stops).withColumn("__body", main & ~heading)
    ends = (F.col("__stop") | F.col("__body") & F.rtrim(text).rlike(ENDS_SENTENCE)).cast("int")
    rows = rows.withColumn("__g", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.min(F.when(F.col("__body"), F.col("pos"))).over(Window.partitionBy(key, "__g"))
    order = F.when(F.col("__stop"), 3).when(F.col("__body"), 1).when(first.isNull() | (F.col("pos") < first), 0).otherwise(2)
    # a segment's main text is one group, every other block its own, so that rows are made once
    rows = rows.withColumn("__o", order).withColumn("__own", F.when(F.col("__o") != 1, F.col("pos")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"])
    both = rows.groupBy(key, "__g", "__o", "__own").agg(F.min("pos").alias("__at"), F.first("category").alias("category"), F.first("content").alias("one"), parts.alias("parts"))
    text = F.when(F.col("__o") == 1, trimmed(F.array_join("parts", " "))).otherwise(F.col("one"))
    both = both.select(key, "__g", "__o", "__at", "category", text.alias("content")).where("__o <> 1 or content <> ''")
    return both.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("__g", "__o", "__at")) - 1).select(key, "pos", "category", "content")


def title_ratio(a: str, b: str) -> float:
    """Similarity of two texts by their matching blocks."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def _bounded(a: Column, b: Column, least: float) -> Column:
    """A struct (a, b, sure): whether two texts are more alike than `least` if bounds say so, else the texts.

    Matching blocks can't hold more than the shorter text has, nor more of a character than either has. Equal texts
    are as alike as can be.
    """
    none, both = F.lit(None).cast("string"), F.length(a) + F.length(b)
    count = lambda t, x: F.length(t) - F.length(F.replace(t, x, F.lit("")))
    letters = F.filter(F.array_distinct(F.split(a, "")), lambda x: x != "")
    common = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    enough = lambda n: F.lit(2.0) * n / both > F.lit(least)
    sure = F.when(a == b, F.lit(1.0 > least)).when(~enough(F.least(F.length(a), F.length(b))), F.lit(False)).when(~enough(common), F.lit(False))
    let = lambda value, of: F.element_at(F.transform(F.array(value), of), 1)
    open_ = lambda k, t: F.when(k.isNull() & a.isNotNull() & b.isNotNull(), t).otherwise(none)
    return let(sure, lambda k: F.struct(open_(k, a).alias("a"), open_(k, b).alias("b"), k.alias("sure")))


def with_alike(rows: DataFrame, name: str, a: Column, b: Column, least: float) -> DataFrame:
    """rows with a column that says whether title_ratio of two texts is above `least`; null where either is.

    Lengths and counts of characters decide nearly all rows as columns; only the texts of the others
    reach the matcher, in Arrow batches.
    """

    @F.pandas_udf("boolean")
    def settled(x: pd.DataFrame) -> pd.Series:
        out = zip(x["a"], x["b"], x["sure"], strict=True)
        return pd.Series([title_ratio(p, q) > least if isinstance(p, str) else None if k is None else bool(k) for p, q, k in out], dtype=object)

    # the texts are columns of their own, so that what is worked out for them is so once
    rows = rows.withColumn("__like_a", a).withColumn("__like_b", b)
    return rows.withColumn(name, settled(_bounded(F.col("__like_a"), F.col("__like_b"), least))).drop("__like_a", "__like_b")


def with_title(rows: DataFrame, name: str, chunk: Column, title: Column, least: float = 0.85, slack: int = 10) -> DataFrame:
    """rows with a column that says whether a chunk is about as long as a title and both, normalised, nearly agree."""
    from ..functions.text import title_form

    near = F.coalesce(F.abs(F.length(chunk) - F.length(title)) <= slack, F.lit(False))
    rows = with_alike(rows, name, F.when(near, title_form(title)), F.when(near, title_form(chunk)), least)
    return rows.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def equations(c: Column) -> Column:
    """Display equations, then inline ones; a display equation may also be found as inline, by design."""
    return F.concat(F.regexp_extract_all(c, F.lit(r"(?s)(\$\$.+?\$\$)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(\$[^$]+\$)"), F.lit(1)))


def equation_contexts(sents: DataFrame, key: str = "doc_id", around: int = 2) -> DataFrame:
    """(key, pos, sentence, context): the sentences up to `around` before and after."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(-around, around)
    return sents.withColumn("context", F.array_join(F.collect_list("sentence").over(w), " "))


def figure_groups(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, figure ARRAY, description) of lines (key, pos, line): images up to a caption belong to it."""
    w = Window.partitionBy(key).orderBy("pos")
    image = F.regexp_extract("line", r"!\[[^\]]*\]\(([^)]+)\)", 1)
    rows = rows.withColumn("image", F.when(image != "", image)).withColumn("caption", F.col("line").rlike(CAPTION) | F.col("line").rlike(r"(?i)^\s*(fig\.|figure)\s+\d+"))
    # an image after a caption begins a new group
    starts = F.when(F.col("image").isNotNull() & F.coalesce(F.lag("image").over(w).isNull(), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumn("__s", starts).withColumn("__g", F.sum("__s").over(w)).where("__g > 0")
    images = F.transform(F.sort_array(F.collect_list(F.when(F.col("image").isNotNull(), F.struct("pos", "image")))), lambda x: x["image"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("image").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), " ")
    return rows.groupBy(key, "__g").agg(images.alias("figure"), text.alias("description")).drop("__g")


def clean_document(rows: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, document): the title as a heading, then main text and equations, headings one level down."""
    body = rows.where(F.col("category").isin("main_letter", "equation")).withColumn("content", F.when(F.col("content").startswith("# "), F.concat(F.lit("#"), "content")).otherwise(F.col("content")))
    parts = body.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n").alias("body"))
    return titles.join(parts, key, "left").select(key, F.concat_ws("\n\n", F.concat(F.lit("## "), F.col("title")), "body").alias("document"))
