"""Bibliographic records in JSON, as three kinds of services give them, read as columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import citation_key, empty_to_null, name_key, normalize_doi, short_id, strip_xml

#: The fields of the records.
DATE = "struct<`date-parts`:array<array<int>>>"
ARTICLE = f"""DOI string, URL string, title array<string>, author array<struct<given:string,family:string,name:string>>, `container-title` array<string>, `short-container-title` array<string>,
publisher string, `published-print` {DATE}, published {DATE}, issued {DATE}, `published-online` {DATE}, volume string, issue string, `journal-issue` struct<issue:string>, page string, `article-number` string,
eLocator string, abstract string, reference array<struct<key:string,DOI:string,unstructured:string,author:string,year:string,`volume-title`:string,`journal-title`:string,`first-page`:string,volume:string>>"""
WORK = "id string, doi string, title string, display_name string, publication_year int, authorships array<struct<author:struct<display_name:string>>>, referenced_works array<string>"
PAPER = "struct<externalIds:struct<DOI:string>,title:string>"
PAGE = f"data array<struct<citedPaper:{PAPER},citingPaper:{PAPER}>>, next int"
DATES = ("published-print", "published", "issued", "published-online")
NO_YEAR = "XXXX"


def article(c: Column) -> Column:
    """A JSON text as an article's record; null if it is none."""
    return F.from_json(c, ARTICLE)


def work(c: Column) -> Column:
    return F.from_json(c, WORK)


def some(c: Column) -> Column:
    return empty_to_null(F.trim(c))


def authors(r: Column) -> Column:
    """Names as "Given Family", or whichever of the two there is."""
    names = F.transform(r["author"], lambda a: F.concat_ws(" ", some(a["given"]), some(a["family"])))
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "")


def journal(r: Column) -> Column:
    head = lambda name: empty_to_null(F.get(r[name], F.lit(0)))
    return F.coalesce(head("container-title"), head("short-container-title"), r["publisher"])


def year(r: Column) -> Column:
    """The year of the first date that has one, as text; XXXX without any."""
    of = lambda name: F.nullif(F.get(F.get(r[name]["date-parts"], F.lit(0)), F.lit(0)), F.lit(0))
    return F.coalesce(*[of(n).cast("string") for n in DATES], F.lit(NO_YEAR))


def issue(r: Column) -> Column:
    return F.coalesce(empty_to_null(r["issue"]), r["journal-issue"]["issue"])


def pages(r: Column) -> Column:
    return F.coalesce(empty_to_null(r["page"]), empty_to_null(r["article-number"]), r["eLocator"])


def abstract(r: Column, other: Column) -> Column:
    """The record's abstract without markup, or another one where it has none."""
    return F.when(F.coalesce(r["abstract"], F.lit("")) != "", strip_xml(r["abstract"])).otherwise(other)


def bibkey(r: Column) -> Column:
    first = F.get(r["author"], F.lit(0))
    return citation_key(F.coalesce(first["family"], first["name"]), year(r), empty_to_null(F.trim(F.get(r["title"], F.lit(0)))))


def bibjson(r: Column, other_abstract: Column) -> Column:
    """A record in the engine's own form, of eleven fields."""
    parts = {
        "title": F.get(r["title"], F.lit(0)), "author": authors(r), "journal": journal(r), "doi": r["DOI"], "url": r["URL"], "year": year(r), "volume": r["volume"], "number": issue(r), "pages": pages(r),
        "bibkey": bibkey(r), "abstract": abstract(r, other_abstract),
    }
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def references(rows: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(key, pos, doi, entry) of each reference of articles: its normalised DOI and its fields as JSON, without those that are null."""
    x = rows.select(key, F.posexplode(F.col(record)["reference"]).alias("pos", "r"))
    fields = {"key": "key", "doi": "DOI", "unstructured": "unstructured", "author": "author", "year": "year", "volume_title": "volume-title", "journal_title": "journal-title", "first_page": "first-page", "volume": "volume"}
    return x.select(key, "pos", normalize_doi(F.col("r")["DOI"]).alias("doi"), F.to_json(F.struct(*[F.col("r")[c].alias(n) for n, c in fields.items()])).alias("entry"))


def work_meta(w: Column) -> Column:
    """(doi, title, work_id, year, authors) of a work."""
    names = F.filter(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    title = F.coalesce(empty_to_null(w["title"]), w["display_name"])
    return F.struct(F.coalesce(normalize_doi(w["doi"]), F.lit("")).alias("doi"), title.alias("title"), short_id(w["id"]).alias("work_id"), w["publication_year"].alias("year"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"))


def work_references(works: DataFrame, key: str, ids: DataFrame, record: str = "work") -> DataFrame:
    """(key, pos, work_id, doi) of what works refer to, in order, by ids (work_id, doi); a null doi is one that isn't known."""
    x = works.select(key, F.posexplode(F.col(record)["referenced_works"]).alias("pos", "w")).select(key, "pos", short_id(F.col("w")).alias("work_id")).where("work_id <> ''")
    known = ids.select(short_id(F.col("work_id")).alias("work_id"), normalize_doi(F.col("doi")).alias("doi")).where("doi is not null").dropDuplicates(["work_id"])
    return x.join(known, "work_id", "left").select(key, "pos", "work_id", "doi")


def page_edges(pages: DataFrame, key: str, cited: bool = True, page: str = "page") -> DataFrame:
    """(key, pos, doi) of pages (key, offset, page JSON) of what a paper cites, or of what cites it; a null doi is one that isn't known."""
    side = "citedPaper" if cited else "citingPaper"
    x = pages.select(key, "offset", F.posexplode(F.from_json(page, PAGE)["data"]).alias("p", "x"))
    return x.select(key, (F.col("offset") + F.col("p")).alias("pos"), normalize_doi(F.col("x")[side]["externalIds"]["DOI"]).alias("doi"))


def resolved(edges: DataFrame, key: str) -> DataFrame:
    """(key, resolved, dropped) of edges (key, doi): how many have a DOI, and how many were left out for want of one."""
    return edges.groupBy(key).agg(F.count("doi").alias("resolved"), F.count_if(F.col("doi").isNull()).alias("dropped"))


def author_ids(c: Column) -> Column:
    """The distinct identities of authors (orcid, openalex_id, id, name, display_name): by an id if there is one, else by name; null if none."""
    ident = lambda a: F.coalesce(*[empty_to_null(a[n]) for n in ("orcid", "openalex_id", "id")])
    name = lambda a: name_key(F.coalesce(empty_to_null(a["name"]), a["display_name"]))
    one = F.transform(c, lambda a: F.coalesce(F.concat(F.lit("id::"), F.lower(F.trim(ident(a)))), name(a)))
    kept = F.array_sort(F.array_distinct(F.filter(one, lambda x: x.isNotNull())))
    return F.when(F.size(kept) > 0, kept)


def lookup(dois: DataFrame, records: DataFrame) -> DataFrame:
    """dois (doi) with the record of each; null where there is none. Of records (doi, record) with one DOI the first by record counts."""
    known = records.select(normalize_doi(F.col("doi")).alias("__d"), "record").where("__d is not null").groupBy("__d").agg(F.min("record").alias("record"))
    return dois.join(known, normalize_doi(dois["doi"]) == known["__d"], "left").drop("__d")
