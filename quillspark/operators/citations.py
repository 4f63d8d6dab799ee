"""In-text citations: markers of four styles, their numbers, contexts, resolution against references, counts by article."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words whose full stop and digits are no citation; words before and after a parenthesis that isn't one.
NOT_SUPERSCRIPT = "fig figs figure figures eq eqs eqn ref refs no nos sec section tab table tables al etc vs cf viz approx dr prof mr ms vol p pp ch chap chapter step".split()
BEFORE = r"(?i)\b(?:eqs?|eqn|figs?|figures?|tables?|refs?|sections?|sec|steps?|nos?|chapters?|parts?|panels?|columns?|rows?|lines?|items?)\.?\s*$"
AFTER = r"(?i)\b(?:lattice|planes?|directions?|facets?|orientations?|surfaces?|reflections?|miller|axes|axis|crystallographic)\b"
#: How numbers, superscripts, names with years and numbered entries are written.
NUMBERS = r"\d+(?:\s*[–—\-,]\s*\d+)*"
BRACKET, SUPER = rf"\[({NUMBERS})\]", r"⟦SUP:([\d,\-–—\s]+)⟧"
AUTHOR = r"[A-Z][A-Za-z'’\-]+"
NAMES = rf"{AUTHOR}(?:\s+(?:et\s+al\.?|and|&)\s+{AUTHOR})*(?:\s+et\s+al\.?)?"
NARRATIVE = rf"({NAMES})\s+\((\d{{4}})[a-z]?\)"
BLOCK = r"\(([^()]*\b\d{4}[a-z]?\b[^()]*)\)"
ENTRY = rf"({NAMES})\s*,?\s+(\d{{4}})[a-z]?"
#: What every citation has, of whatever style.
MAY_CITE = r"[\[(]\d|⟦SUP:|\d{4}"
ENTRY_LINE = r"^\s*(?:\[(\d+)\]|\((\d+)\)|(\d{1,3})\.)\s+(.+)$"


def mark_superscripts(c: Column) -> Column:
    """`word.8,20 Next` as `word ⟦SUP:8,20⟧. Next`, but for words that come before other numbers."""
    stop = "|".join(NOT_SUPERSCRIPT)
    whole = rf"(?<![A-Za-z])(?!(?i:{stop})\.)([A-Za-z]{{2,}})\.\s*(\d+(?:\s*[,\-–—]\s*\d+)*)(?=\s+[A-Z(]|\s*$)"
    return F.regexp_replace(c, whole, "$1 ⟦SUP:$2⟧.")


def render_markers(c: Column) -> Column:
    return F.regexp_replace(c, SUPER, r"^{$1}")


def expand_numbers(body: Column) -> Column:
    """`1-3,5` as [1, 2, 3, 5]: falling ranges, zero-padded and other tokens give nothing."""
    plain = F.regexp_replace(F.regexp_replace(body, "[–—]", "-"), r"\s+", "")
    token = r"^[1-9]\d{0,8}$"

    def one(p: Column) -> Column:
        ends = F.split(p, "-")
        lo, hi = F.element_at(ends, 1), F.try_element_at(ends, F.lit(2))
        good = (F.size(ends) == 2) & lo.rlike(token) & hi.rlike(token)
        a, b = lo.try_cast("int"), hi.try_cast("int")
        span = F.when(good & (a <= b), F.sequence(a, F.when(good & (a <= b), b).otherwise(a)))
        single = F.when((F.size(ends) == 1) & p.rlike(token), F.array(p.try_cast("int")))
        return F.coalesce(span, single, F.array().cast("array<int>"))

    return F.flatten(F.transform(F.split(plain, ","), one))


def in_range(numbers: Column, most: Column) -> Column:
    return F.filter(numbers, lambda n: most.isNull() | n.between(1, most))


def bracket_markers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(BRACKET), F.lit(1))


def superscript_markers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(SUPER), F.lit(1))


#: White space as regular expressions have it.
SPACES = " \t\n\r\x0b\x0c"


def _none() -> Column:
    return F.array().cast("array<string>")


def paren_markers(c: Column, most: Column) -> Column:
    """Bodies of numeric parentheses that cite a reference of 1 .. most (any, if null).

    None after Eq., Fig. and the like, none before crystal words within 40 characters, and no single number before a word.
    One pattern gives each parenthesis with the text since the one before and the 40 characters behind it, so a text is read in linear time.
    """
    found = lambda group: F.regexp_extract_all(c, F.lit(rf"(?s)\G(.*?)\(({NUMBERS})\)(?=(.{{0,40}}))"), F.lit(group))
    # what may stand before a parenthesis is one word with a full stop: its end and what keeps it apart
    placed = F.zip_with(found(1), found(2), lambda t, b: F.struct(F.right(F.rtrim(t, F.lit(SPACES)), F.lit(32)).alias("tail"), b.alias("body")))
    placed = F.zip_with(placed, found(3), lambda x, t: F.struct(x["tail"].alias("tail"), x["body"].alias("body"), t.alias("behind")))

    def cites(x: Column) -> Column:
        several = x["body"].rlike("[,–—-]")
        numbers = F.size(in_range(expand_numbers(x["body"]), most)) > 0
        return numbers & ~x["tail"].rlike(BEFORE) & ~x["behind"].rlike(AFTER) & (several | ~x["behind"].rlike(r"^\s+[A-Za-z]"))

    return F.when(c.rlike(r"\(\d"), F.transform(F.filter(placed, cites), lambda x: x["body"])).otherwise(_none())


def numeric_markers(c: Column, most: Column) -> Column:
    """[(marker, numbers, form)] of a sentence: brackets, then superscripts, then parentheses; only brackets may name any number."""

    def entries(bodies: Column, form: str, text, numbers) -> Column:
        return F.filter(F.transform(bodies, lambda b: F.struct(text(b).alias("marker"), numbers(b).alias("numbers"), F.lit(form).alias("form"))), lambda x: F.size(x["numbers"]) > 0)

    known = lambda b: in_range(expand_numbers(b), most)
    kind = "array<struct<marker:string,numbers:array<int>,form:string>>"
    # a look for what each form begins with spares most texts the rest
    some = lambda sign, found: F.when(c.rlike(sign), found).otherwise(F.array().cast(kind))
    return F.concat(
        some(r"\[\d", entries(bracket_markers(c), "bracket", lambda b: F.concat(F.lit("["), b, F.lit("]")), expand_numbers)),
        some("⟦SUP:", entries(superscript_markers(c), "superscript", lambda b: F.concat(F.lit("^{"), F.regexp_replace(b, r"\s+", ""), F.lit("}")), known)),
        some(r"\(\d", entries(paren_markers(c, most), "paren", lambda b: F.concat(F.lit("("), b, F.lit(")")), known)),
    )


def author_year_markers(c: Column) -> Column:
    """[(surname, year)] of narrative citations, then of those in parentheses."""
    surname = lambda n: F.regexp_extract(n, f"^{AUTHOR}", 0)
    pairs = lambda text, shape: F.zip_with(F.regexp_extract_all(text, F.lit(shape), F.lit(1)), F.regexp_extract_all(text, F.lit(shape), F.lit(2)), lambda n, y: F.struct(surname(n).alias("surname"), y.alias("year")))
    inner = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(BLOCK), F.lit(1)), lambda b: pairs(b, ENTRY)))
    found = F.array_distinct(F.concat(pairs(c, NARRATIVE), inner))
    return F.when(c.rlike(r"\d{4}"), found).otherwise(F.array().cast("array<struct<surname:string,year:string>>"))


def numeric_entry(markers: Column) -> Column:
    """Of numeric_markers() one entry: style, forms and markers in order, distinct numbers in rising order."""
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(markers, lambda x: x["numbers"]))))
    return F.struct(
        F.lit("numeric").alias("style"), F.array_distinct(F.transform(markers, lambda x: x["form"])).alias("forms"), F.transform(markers, lambda x: x["marker"]).alias("markers"),
        numbers.alias("refs"), F.array().cast("array<struct<surname:string,year:string>>").alias("names"),
    )


def author_year_entry(markers: Column) -> Column:
    """Of author_year_markers() one entry: each name and year once, as first met."""
    text = F.transform(markers, lambda x: F.concat(x["surname"], F.lit(" "), x["year"]))
    return F.struct(F.lit("author-year").alias("style"), F.array().cast("array<string>").alias("forms"), text.alias("markers"), F.array().cast("array<int>").alias("refs"), markers.alias("names"))


def citation_contexts(sents: DataFrame, key: str = "doc_id", most: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """Sentences (key, pos, sentence) that cite: style, forms, markers, sorted refs, names, neighbours, context and a running id.

    A sentence that cites by number and by author and year has two rows, numbers first. Superscripts and
    parentheses count where they name a reference of 1 .. most, a column of sents, if given. `order`: columns of sents that order a
    document's sentences as pos does; rows that are sorted by them already aren't sorted again.
    """
    w = Window.partitionBy(key).orderBy(*(order or ["pos"]))
    c = F.col("sentence")
    shown = lambda c: F.when(c.contains("⟦SUP:"), render_markers(c)).otherwise(c)
    rows = sents.withColumn("__before", F.lag("sentence").over(w)).withColumn("__after", F.lead("sentence").over(w)).where(c.rlike(MAY_CITE))
    rows = rows.withColumn("__shown", shown(c)).withColumn("prev_sentence", F.coalesce(shown(F.col("__before")), F.lit(""))).withColumn("next_sentence", F.coalesce(shown(F.col("__after")), F.lit("")))
    # markers are found once: what is made of them is exploded, and nothing filters by them below that
    rows = rows.withColumn("__n", numeric_markers(c, F.lit(None).cast("int") if most is None else most)).withColumn("__a", author_year_markers(c))
    both = F.array(F.when(F.size("__n") > 0, numeric_entry(F.col("__n"))), F.when(F.size("__a") > 0, author_year_entry(F.col("__a"))))
    rows = rows.withColumn("__es", F.filter(both, lambda x: x.isNotNull()))
    # ids go on from the citations of the sentences before, which stand in order: the entries aren't sorted once more
    before = F.coalesce(F.sum(F.size("__es")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ids")
    rows = rows.select(*sents.columns, "__shown", "prev_sentence", "next_sentence", "__es", before)
    rows = rows.select(*sents.columns, "__shown", "prev_sentence", "next_sentence", "__ids", F.posexplode("__es").alias("__k", "__e")).withColumn("sentence", F.col("__shown"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = rows.withColumn("context", F.concat_ws(" ", some("prev_sentence"), some("sentence"), some("next_sentence")))
    rows = rows.withColumn("citation_id", (F.col("__ids") + F.col("__k") + 1).cast("int"))
    return rows.select(*sents.columns, "prev_sentence", "next_sentence", "context", "citation_id", "__e.*")


def style_counts(citations: DataFrame) -> DataFrame:
    """(style, form, citations): how many citations there are of each style and form; a citation of several forms counts for each."""
    forms = F.explode(F.when(F.size("forms") > 0, F.col("forms")).otherwise(F.array(F.lit("")))).alias("form")
    return citations.select("style", forms).groupBy("style", "form").agg(F.count(F.lit(1)).alias("citations"))


def open_citations(registry: DataFrame, again: bool = False) -> DataFrame:
    """Rows of a registry whose citations are still to be found; all of them, if they are to be found again."""
    return registry if again else registry.where(F.col("citation_state").isNull() | ~F.col("citation_state").isin("done", "Not_Found"))


def with_citation_state(registry: DataFrame, done: DataFrame, citations: DataFrame, key: str = "doc_id") -> DataFrame:
    """registry with citation_state of the documents in done (key): done if any citation (key) was found, else Not_Found."""
    found = done.select(key).distinct().join(citations.select(key).distinct().withColumn("__c", F.lit("done")), key, "left").select(key, F.coalesce("__c", F.lit("Not_Found")).alias("__c"))
    return registry.join(found, key, "left").withColumn("citation_state", F.coalesce("__c", "citation_state")).drop("__c")


def by_article(citations: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, article, ref_keys, citation_count, first_ref) of citations (key, citation_id, refs) and references (key, num, doi, title, raw).

    Articles are told apart by DOI, else title, else raw text, else number.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    article = F.coalesce(F.concat(F.lit("doi::"), some("doi")), F.concat(F.lit("title::"), some("title")), F.concat(F.lit("raw::"), some("raw"))).alias("article")
    rows = citations.select(key, "citation_id", F.explode("refs").alias("num")).join(references.select(key, "num", article).hint("merge"), [key, "num"], "left")
    return rows.groupBy(key, F.coalesce("article", F.concat(F.lit("ref::"), F.col("num").cast("string"))).alias("article")).agg(F.array_sort(F.collect_set("num")).alias("ref_keys"), F.count_distinct("citation_id").alias("citation_count"), F.min("num").alias("first_ref"))


def ordered_articles(articles: DataFrame, key: str = "doc_id", name: str = "article") -> DataFrame:
    """by_article() with place: the order of a document's articles by their first reference, then by name."""
    return articles.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("first_ref").asc_nulls_last(), name)))


def reference_entries(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, num, raw) of reference lines (key, pos, line): an entry begins with its number; a later one of a number counts."""
    n = F.coalesce(*[F.nullif(F.regexp_extract("line", ENTRY_LINE, i), F.lit("")) for i in (1, 2, 3)]).try_cast("int")
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.where("trim(line) <> ''").withColumn("num", n).withColumn("g", F.sum(F.when(n.isNotNull(), 1).otherwise(0)).over(w)).where("g > 0")
    part = F.when(F.col("num").isNotNull(), F.regexp_extract("line", ENTRY_LINE, 4)).otherwise(F.trim("line"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos"), part.alias("t")))), lambda x: F.trim(x["t"])), " ")
    rows = lines.groupBy(key, "g").agg(F.max("num").alias("num"), texts.alias("raw"))
    return rows.groupBy(key, "num").agg(F.max_by("raw", "g").alias("raw"))


#: What an entry of running references begins with, and what may stand before the first.
MARK, SPACED_MARK = r"(?:\[\d+\]|\(\d+\)|\d{1,3}\.)", r"\s\d{1,3}\."
HEADING = r"(?i:\s*#?\s*references?(?:\s+and\s+notes)?)"


def split_references(c: Column, least: int = 20) -> Column:
    """The entries of a reference section in running text, without their numbers; shorter ones than `least` are none.

    An entry begins with [n], (n) or n. at the start of a line, or with n. after white space, and ends where the next
    one begins. Superscript numbers count as [n]; formulas go.
    """
    begin = rf"(?:\A{HEADING}?\s*|\n){MARK}|{SPACED_MARK}"
    entry = rf"(?s)(?:{begin})(.*?)(?=\n{MARK}|{SPACED_MARK}|\z)"
    plain = F.regexp_replace(F.regexp_replace(c, r"\$\^\{(\d+)\}\$", "[$1]"), r"\$.*?\$", "")
    found = F.transform(F.regexp_extract_all(plain, F.lit(entry), F.lit(1)), lambda x: F.regexp_extract(x, r"(?s)^\s*(.*?)\s*$", 1))
    return F.filter(found, lambda x: F.length(x) >= least)


def find_author_year(markers: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, surname, year, ref_pos) for refs (key, ref_pos, text, author ARRAY, year): the first of the year with the surname.

    Equal markers are asked once, and equal references once, by the first of them. Of these a name meets those of its document and year.
    """
    name = F.lower("surname")
    known = F.exists("author", lambda a: a.contains(name)) | F.col("text").contains(name)
    asked = markers.select(key, "surname", "year").distinct()
    first = refs.groupBy(key, "year", F.lower("text").alias("text"), F.transform("author", F.lower).alias("author")).agg(F.min("ref_pos").alias("ref_pos"))
    hit = asked.join(first, [key, "year"]).where(known).groupBy(key, "surname", "year").agg(F.min("ref_pos").alias("ref_pos"))
    return asked.join(hit, [key, "surname", "year"], "left")
