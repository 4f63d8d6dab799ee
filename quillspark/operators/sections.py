"""Parts of a paper's text: where its title, references, abstract and keywords stand, its headings' paths, its equations' contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .markdown import REF_HEADER, equations, is_equation, is_figure, is_reference, is_table, with_alike, with_title

#: A heading of any section, and a line that begins a numbered entry.
SECTION, ENTRY = r"^#\s+\w", r"^\s*(?:\[\d+\]|\(\d+\)|\d{1,3}\.)\s+.+$"
#: Entries that a block without a heading needs, and lines of prose in a row that end it.
LEAST_ENTRIES, PROSE = 3, 2
#: From this likeness on an abstract is the known one; words of a chunk that may be one more keyword, less one.
SAME_ABSTRACT, KEYWORD_WORDS = 0.7, 4


def reference_section(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, line) of the reference section of documents' lines (key, pos, line).

    It follows the first heading of references. Without one it is the last block of numbered entries, of three
    at least: from its first entry, before which two lines of prose stand without an entry between, to the end.
    """
    w = Window.partitionBy(key)
    entry, blank = F.col("line").rlike(ENTRY), F.trim("line") == ""
    rows = lines.withColumn("__head", F.min(F.when(F.col("line").rlike(REF_HEADER), F.col("pos"))).over(w))
    rows = rows.withColumn("__entry", entry).withColumn("__n", F.count_if(entry).over(w)).withColumn("__last", F.max(F.when(entry, F.col("pos"))).over(w))
    # an entry's number from the end, and so that of the lines before it up to the entry before: two lines of prose there end the block
    inside = rows.where("__head is null and __n >= " + str(LEAST_ENTRIES) + " and pos <= __last")
    # counted from the end: a frame that only grows is summed on, one that shrinks would be summed anew for every line
    after = Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__block", F.count_if("__entry").over(after))
    prose = F.count_if(~F.col("__entry") & ~blank)
    ends = inside.groupBy(key, "__block").agg(prose.alias("p")).groupBy(key).agg(F.min(F.when(F.col("p") >= PROSE, F.col("__block"))).alias("__stop"))
    starts = inside.where("__entry").select(key, "__block", "pos").join(ends, key).where("__block <= coalesce(__stop, __block)").groupBy(key).agg(F.min("pos").alias("__start"))
    rows = rows.join(starts, key, "left")
    return rows.where("pos > __head or __head is null and pos >= __start").select(key, "pos", "line")


def main_section(chunks: DataFrame, titles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, category, content) of chunks (key, pos, content) from the title to the end of the references.

    titles (key, title) says what to look for; where it isn't found all chunks stay. The first chunk that stays is the title; references
    begin with the first chunk of entries after it, and end before the next heading.
    """
    w = Window.partitionBy(key)
    rows = chunks.join(titles, key, "left")
    rows = with_title(rows, "__is", F.col("content"), F.col("title"))
    rows = rows.withColumn("__t", F.min(F.when(F.col("__is"), F.col("pos"))).over(w)).drop("__is")
    rows = rows.where("__t is null or pos >= __t")
    rows = rows.withColumn("__first", F.min("pos").over(w)).withColumn("__ref", F.min(F.when(is_reference(F.col("content")), F.col("pos"))).over(w))
    rows = rows.withColumn("__end", F.min(F.when((F.col("pos") > F.col("__ref")) & F.col("content").rlike(SECTION), F.col("pos"))).over(w))
    category = F.when(F.col("pos") == F.col("__first"), "title").when(F.col("pos") >= F.col("__ref"), "references").otherwise("other")
    return rows.where("__end is null or pos < __end").select(key, "pos", category.alias("category"), "content")


def is_abstract(content: Column, said: Column) -> Column:
    """Whether a model's word about a chunk makes it an abstract; chunks of fewer than 20 characters are none, unasked."""
    return (F.length(F.trim(content)) >= 20) & (F.lower(F.trim(said)) == "abstract")


def detail(rows: DataFrame, body: Column, key: str = "doc_id") -> DataFrame:
    """rows (key, pos, category, content, abstract) with the categories of what is `other`: the first that the column `abstract` marks is the abstract; then figure, table, equation, main text by `body`."""
    w = Window.partitionBy(key).orderBy("pos")
    c, other = F.col("content"), F.col("category") == "other"
    rows = rows.withColumn("__b", F.lag("content").over(w)).withColumn("__a", F.lead("content").over(w))
    rows = rows.withColumn("__f", F.min(F.when(other & F.col("abstract"), F.col("pos"))).over(Window.partitionBy(key)))
    found = F.when(F.col("pos") == F.col("__f"), "abstract").when(is_figure(c, F.col("__b")), "figure").when(is_table(c, F.col("__a")), "table").when(is_equation(c), "equation").when(body, "main_letter").otherwise("other")
    return rows.withColumn("category", F.when(other, found).otherwise(F.col("category"))).drop("__b", "__a", "__f", "abstract")


def decided(rows: DataFrame, provider, key: str = "doc_id") -> DataFrame:
    """rows (key, pos, category, content) in which a model has said of each undecided block whether it is main text; the others aren't asked about."""
    from ..providers import chat

    open_ = rows.where("category = 'undecided'").withColumn("__p", F.concat(F.lit("Is this main text of a paper? Answer main_letter or other.\n"), "content"))
    said = chat(open_, "__p", provider, "__said")
    answer = F.when(F.lower(F.trim("__said")) == "main_letter", "main_letter").otherwise("other")
    columns = [key, "pos", "category", "content"]
    return rows.where("category <> 'undecided'").select(columns).unionByName(said.withColumn("category", answer).select(columns))


def reconciled(rows: DataFrame, known: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """rows with the known abstract (key, abstract) in place of a chunk that is nearly it, and the abstracts (key, abstract) as they are then known."""
    from ..functions.text import title_form

    found = F.col("category") == "abstract"
    x = with_alike(rows.join(known, key, "left"), "__same", F.when(found, title_form(F.col("content"))), title_form(F.col("abstract")), SAME_ABSTRACT)
    out = x.select(key, "pos", "category", F.when(F.col("__same"), F.col("abstract")).otherwise(F.col("content")).alias("content"))
    mine = out.where("category = 'abstract'").groupBy(key).agg(F.min_by("content", "pos").alias("mine"))
    return out, known.join(mine, key, "full").select(key, F.coalesce("mine", "abstract").alias("abstract"))


def first_title(rows: DataFrame, records: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, doi): of each document the first chunk labelled title, and the record (title, doi) of that very title; the first by DOI."""
    from ..functions.text import title_form

    first = rows.where("category = 'title'").groupBy(key).agg(F.min_by("content", "pos").alias("title"))
    known = records.select(title_form(F.col("title")).alias("__f"), "doi").where("__f <> ''").groupBy("__f").agg(F.min("doi").alias("doi"))
    return first.join(known, title_form(F.col("title")) == F.col("__f"), "left").select(key, "title", "doi")


def keyword_text(rows: DataFrame, check: Column, key: str = "doc_id") -> DataFrame:
    """(key, keywords): chunks (key, pos, category, content) of keywords, then short ones after the first of these that `check` takes for such, up to the main text."""
    w = Window.partitionBy(key)
    named = F.col("category") == "keywords"
    x = rows.withColumn("__k", F.min(F.when(named, F.col("pos"))).over(w))
    x = x.withColumn("__m", F.min(F.when((F.col("category") == "main_letter") & (F.col("pos") > F.col("__k")), F.col("pos"))).over(w))
    words = F.size(F.filter(F.split(F.trim("content"), r"\s+"), lambda t: t != ""))
    more = ~F.col("category").isin("keywords", "abstract", "main_letter") & (F.col("pos") > F.col("__k")) & (F.col("__m").isNull() | (F.col("pos") < F.col("__m"))) & (words < KEYWORD_WORDS) & check
    x = x.where(named | more).withColumn("__o", F.when(named, 0).otherwise(1))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("__o", "pos", "content"))), lambda t: t["content"])
    return x.groupBy(key).agg(F.array_join(parts, ", ").alias("keywords"))


def heading_paths(heads: DataFrame, key: str = "doc_id", mark: str = " > ") -> DataFrame:
    """heads (key, pos, level, title), of levels 1 to 6, with path: the titles from the outermost heading that a heading stands under down to itself."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.last(F.when(F.col("level") == n, F.struct("pos", "title")), ignorenulls=True).over(before)
    x = heads.select("*", *[last(n).alias(f"__{n}") for n in range(1, 6)])
    # a heading counts if none of its own level or above it stands after it
    ends = lambda n: F.greatest(*[F.coalesce(F.col(f"__{m}")["pos"], F.lit(-1)) for m in range(1, n)], F.lit(-1), F.lit(-1))
    parts = [F.when((F.col("level") > n) & (F.col(f"__{n}")["pos"] > ends(n)), F.col(f"__{n}")["title"]) for n in range(1, 6)]
    return x.withColumn("path", F.concat_ws(mark, *parts, "title")).drop(*[f"__{n}" for n in range(1, 6)])


def equation_rows(sents: DataFrame, key: str = "doc_id", around: int = 2) -> DataFrame:
    """(key, pos, equation, context) of main text's sentences (key, block, pos, sentence): equations of ten characters at least that have an =.

    The context is the sentences up to `around` before and after, also those of the neighbouring blocks of main text.
    """
    w = Window.partitionBy(key).orderBy("block", "pos").rowsBetween(-around, around)
    x = sents.withColumn("context", F.array_join(F.collect_list("sentence").over(w), " ")).where(F.col("sentence").contains("$"))
    x = x.select(key, "block", "pos", "context", F.explode(equations(F.col("sentence"))).alias("equation"))
    return x.where(F.col("equation").contains("=") & (F.length("equation") >= 10))


def described(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """rows with description: a model's answer, or null if it says that nothing is clear or has fewer than five words."""
    a = F.trim(answer)
    return rows.withColumn("description", F.when(~a.contains("Not clear") & (F.size(F.split(a, r"\s+")) >= 5), a))
