"""String functions over columns: identifiers, names, titles, markdown and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefixes that may stand before a DOI, and the shape of a DOI.
DOI_PREFIX = r"(?i)^\s*(?:https?://(?:dx\.)?doi\.org/|doi:)\s*"
DOI = r"10\.\d{4,9}/\S+"


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_doi(c: Column) -> Column:
    """The graph's form: one prefix off, trimmed, lower case; empty as null. Not validated."""
    return empty_to_null(F.lower(F.trim(F.regexp_replace(c, DOI_PREFIX, ""))))


def crawl_doi(c: Column) -> Column:
    """The crawler's form: as normalize_doi, but text that doesn't begin with 10. is searched for a DOI."""
    x = normalize_doi(c)
    return F.when(x.startswith("10."), x).otherwise(empty_to_null(F.regexp_extract(x, DOI, 0)))


def is_valid_doi(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike(f"^{DOI}$"), F.lit(False))


def doi_url(c: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), c)


def is_empty_doi(c: Column) -> Column:
    return c.isNull() | c.isin("", "null", "Null", "NULL")


def first_doi(c: Column) -> Column:
    """The first prefixed DOI in a text or JSON document."""
    return empty_to_null(F.regexp_extract(c, r"(?i)(?:doi:\s*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,9}/[^\s\])\"]+)", 1))


def short_id(c: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


def clean_markdown(c: Column) -> Column:
    """Without details and summary elements, at most one empty line in a row, trimmed."""
    x = F.regexp_replace(c, r"(?s)<details>.*?</details>", "")
    x = F.regexp_replace(x, r"(?s)<summary>.*?</summary>", "")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def title_form(c: Column) -> Column:
    """Without heading marks and punctuation of any script, white space squeezed, lower case."""
    x = F.regexp_replace(F.regexp_replace(c, r"^#+\s*", ""), r"[^\p{L}\p{N}_\s]", "")
    return F.lower(squeeze(x))


def match_form(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces."""
    return squeeze(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "))


def title_key(c: Column) -> Column:
    return F.concat(F.lit("title::"), empty_to_null(match_form(c)))


def name_key(c: Column) -> Column:
    """Last name and first initial: of "Given Family" and, by its comma, of "Family, Given"."""
    given_first = F.when(c.contains(","), F.concat_ws(" ", F.trim(F.substring_index(F.substring_index(c, ",", 2), ",", -1)), F.trim(F.substring_index(c, ",", 1)))).otherwise(c)
    x = squeeze(F.regexp_replace(F.lower(given_first), r"[^\p{L}\p{N}_\s-]", " "))
    parts = F.split(x, " ")
    first = F.regexp_extract(F.element_at(parts, 1), r"\p{L}", 0)
    return empty_to_null(F.when(F.size(parts) <= 1, x).otherwise(F.trim(F.concat(F.element_at(parts, -1), F.lit(" "), first))))


#: Qualifiers that are taken off an entity, in this order, and its known synonyms.
QUALIFIERS = ["high", "enhanced", "stable", "significant", "superior", "intrinsic", "extremely", "vanishing", "pure", r"triply\s+periodic"]
SYNONYMS = {
    "thermostability": "thermal stability", "curvature": "mean curvature", "sc": "schwarz crystal", "ctb": "coherent twin boundary", "ctbs": "coherent twin boundary",
    "gb": "grain boundary", "gbs": "grain boundary", "kc": "kelvin crystal", "tpms": "minimal surface",
}


def once(value: Column, *steps) -> Column:
    """value through steps, each computed once however often a step names what it is given."""
    for f in steps:
        value = F.element_at(F.transform(F.array(value), f), 1)
    return value


def clean_entity(c: Column) -> Column:
    """In lower case without qualifiers, by its full name, in the singular, with capitals."""
    x = F.lower(F.trim(c))
    for q in QUALIFIERS:
        x = F.regexp_replace(x, rf"^{q}\s+", "")
    known = F.create_map(*[F.lit(v) for kv in SYNONYMS.items() for v in kv])
    return F.initcap(once(x, lambda t: F.coalesce(F.try_element_at(known, t), t), lambda t: F.when(t.endswith("s") & ~t.endswith("ss"), F.left(t, F.length(t) - 1)).otherwise(t)))


def keywords(c: Column) -> Column:
    """The entries of a keyword line, without its label."""
    x = F.regexp_replace(c, r"(?i)^\s*#*\s*keywords?\s*:?\s*", "")
    return F.filter(F.transform(F.split(x, ","), lambda k: F.trim(k)), lambda k: k != "")


def citation_key(family: Column, year: Column, title: Column) -> Column:
    """First author's family name, year and first title word."""
    name = empty_to_null(F.regexp_replace(family, "[^A-Za-z0-9]", ""))
    word = empty_to_null(F.regexp_replace(F.element_at(F.split(F.trim(title), r"\s+"), 1), r"\W", ""))
    return F.concat(F.coalesce(name, F.lit("Unknown")), F.coalesce(year.cast("string"), F.lit("XXXX")), F.coalesce(word, F.lit("NoTitle")))


def authors_text(c: Column) -> Column:
    return F.coalesce(F.array_join(c, "; "), F.lit(""))


def file_name(c: Column) -> Column:
    """A title as a file name: forbidden characters as underscores, 200 characters at most."""
    return F.substring(squeeze(F.regexp_replace(c, r"[<>:\"/\\|?*]", "_")), 1, 200)


def strip_xml(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]+>", ""))


def abstract_of(c: Column, most: int = 2000) -> Column:
    """Paragraphs that aren't headings or equations, joined by spaces, cut at `most` characters."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith("#") & ~p.startswith("$$"))
    return F.substring(F.array_join(paragraphs, " "), 1, most)


def path_parts(c: Column) -> Column:
    """(user, dataset) of users/<user>/<dataset>/.../documents/<file>, null elsewhere."""
    shape = r"^users/([^/]+)/([^/]+)/(?:.*/)?documents/[^/]+$"
    x = F.regexp_replace(c, r"\\", "/")
    return F.when(x.rlike(shape), F.struct(F.regexp_extract(x, shape, 1).alias("user"), F.regexp_extract(x, shape, 2).alias("dataset")))


def as_double(c: Column) -> Column:
    """A number, or null for anything else and for NaN."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)
