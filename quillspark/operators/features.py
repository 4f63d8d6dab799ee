"""Quantitative features of citation edges. Null says that data is missing, 0 that there was nothing in common."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions import vector
from ..sources.tables import written

PAIR = ["i", "j"]


def cited_local(papers: DataFrame, out: DataFrame) -> DataFrame:
    """Candidate edges (i, j): what local papers (doi) cite (i, doi) among local papers, without themselves."""
    return counted_local(papers, out).select(*PAIR)


def counted_local(papers: DataFrame, out: DataFrame) -> DataFrame:
    """cited_local() with how often i cites j as n. Papers are merged, as a broadcast would gather them at the driver."""
    here = papers.select("doi").distinct()
    found = out.where("i <> doi").groupBy("i", "doi").agg(F.count(F.lit(1)).alias("n"))
    found = found.join(here.hint("merge"), "doi", "left_semi").join(here.select(F.col("doi").alias("i")).hint("merge"), "i", "left_semi")
    return found.select("i", F.col("doi").alias("j"), "n")


#: Pairs from which on a set of candidates is called too large.
MOST_PAIRS = 5_000_000


def all_local(papers: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """All pairs i < j of local papers: a choice for small collections, an error if there are more than `most`."""
    n = papers.select("doi").distinct().count()
    if n * (n - 1) // 2 > most:
        raise ValueError(f"{n} papers have more than {most} pairs; use the pairs that cite each other")
    a, b = papers.select(F.col("doi").alias("i")).distinct(), papers.select(F.col("doi").alias("j")).distinct()
    return a.join(b, F.col("i") < F.col("j"))


def partners(papers: DataFrame) -> DataFrame:
    """(i, partners): of each local paper how many of all_local()'s pairs it leads, for collections of any size; no pair is made.

    They are the papers after it, so it is numbered in their order.
    """
    here = papers.select(F.col("doi").alias("i")).where("i is not null").distinct().withColumn("one", F.lit(1))
    placed = written(running(here, "i", "one", "before"), "partners")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    return placed.join(F.broadcast(n)).select("i", (F.col("n") - F.col("before") - 1).alias("partners")).where("partners > 0")


def local_references(papers: DataFrame, references: DataFrame, cited: DataFrame) -> DataFrame:
    """(i, doi): what local papers (doi) refer to by their references or by the articles that they cite (both i, doi), among local papers, without themselves."""
    return cited_local(papers, references.select("i", "doi").union(cited.select("i", "doi")).where("doi is not null")).withColumnRenamed("j", "doi")


def build_candidates(papers: DataFrame, out: DataFrame, scope: str = "cited_local", most: int = MOST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs (i, j) of a scope, sorted, and one row (papers, pairs, over) that says whether there are more than `most`."""
    if scope not in ("cited_local", "all_local"):
        raise ValueError(f"unknown scope {scope!r}")
    pairs = all_local(papers, most) if scope == "all_local" else cited_local(papers, out)
    n = papers.agg(F.count_distinct("doi").alias("papers"))
    said = n.join(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("pairs")))).withColumn("over", F.col("pairs") > most)
    return pairs.orderBy(*PAIR), said


def reference_summary(references: DataFrame) -> DataFrame:
    """(papers_with_references, reference_vocab_size) of references (owner, member)."""
    return references.agg(F.count_distinct("owner").alias("papers_with_references"), F.count_distinct("member").alias("reference_vocab_size"))


#: Sets up to this size meet as arrays.
SMALL = 256
#: Numbers of cited papers in a block, the pairs and about how many citing papers of a block meet in one task; members that are looked up at a time.
#: A paper goes to about as many tasks as there are blocks, and as a block has tasks: where papers cite at random, both should be few.
BLOCK, SHARE, HELD, LOOKED_UP = 1 << 17, 1 << 19, 1 << 18, 1 << 21


def numbered(pairs: DataFrame, *sets: DataFrame) -> bool:
    """Whether papers and what their sets hold go by whole numbers."""
    return all(isinstance(f.dataType, IntegralType) for rows in (pairs.select(*PAIR), *sets) for f in rows.schema.fields)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Begins and lengths (-1: null) of the lists of a column, and their values."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    at = lists.offsets.to_numpy()
    return at[:-1], np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, np.diff(at)), lists.values


def narrowed(c: str) -> list[Column]:
    """A list of whole numbers as two columns: <c> with half the bytes, if all its numbers fit, else __wide_<c>."""
    fits = F.coalesce((F.array_min(c) >= -(2**31)) & (F.array_max(c) < 2**31), F.lit(False))
    return [F.when(fits, F.col(c).cast("array<int>")).alias(c), F.when(~fits, F.col(c).cast("array<long>")).alias(f"__wide_{c}")]


def _widened(narrow: pa.ChunkedArray, wide: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, lengths (-1: null) and values of lists that were narrowed()."""
    begin, size, values = _flat(narrow)
    values = values.to_numpy(zero_copy_only=False).astype("int64")
    if wide.null_count < len(wide):
        at, n, more = _flat(wide)
        begin, size = np.where(n >= 0, at + len(values), begin), np.where(n >= 0, n, size)
        values = np.concatenate([values, more.to_numpy(zero_copy_only=False).astype("int64")])
    return begin, size, values


def _common(lists: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.Array:
    """How many members the sets in rows i and j of _widened() lists have in common; null if either is null."""
    begin, size, values = lists
    low = int(values.min(initial=2**63 - 1))
    width = int(values.max(initial=low)) - low + 1
    if width * max(1, len(size)) < 1 << 62:
        code = values - low
    else:
        _, code = np.unique(values, return_inverse=True)
        width = int(code.max(initial=0)) + 1
    held = np.maximum(size, 0)
    owner = np.repeat(np.arange(len(size)), held)
    order = np.repeat(begin - (np.cumsum(held) - held), held) + np.arange(len(owner))
    known = np.sort(owner * width + code[order])
    small, large = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
    n, out = held[small], np.zeros(len(i), "int64")
    ends, first = np.cumsum(n), 0
    while first < len(i) and len(known):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LOOKED_UP, "right")))
        m = n[first:last]
        row = np.repeat(np.arange(first, last), m)
        place = np.repeat(begin[small[first:last]] - (np.cumsum(m) - m), m) + np.arange(len(row))
        asked = large[row] * width + code[place]
        found = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        out[first:last] = np.bincount(row[found] - first, minlength=last - first)
        first = last
    return pa.array(out, mask=(size[i] < 0) | (size[j] < 0))


def _cosine(column: pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> pa.Array:
    """vector.cosine() of the vectors in rows i and j: 0 if either is zero; null if either is null or holds a null, or their lengths differ."""
    begin, size, values = _flat(column)
    gap = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = (size >= 0) & (gap[begin + np.maximum(size, 0)] == gap[begin])
    values = values.to_numpy(zero_copy_only=False).astype("float64")
    rows = {int(d): np.flatnonzero(whole & (size == d)) for d in np.unique(size[whole])}
    place, norm, vectors = np.zeros(len(size), "int64"), np.full(len(size), np.nan), {}
    for d, at in rows.items():
        vectors[d] = values[begin[at][:, None] + np.arange(d)]
        place[at], norm[at] = np.arange(len(at)), np.sqrt(np.einsum("ab,ab->a", vectors[d], vectors[d]))
    both, out, said = whole[i] & whole[j], np.zeros(len(i)), np.zeros(len(i), bool)
    for d, v in vectors.items():
        same = np.flatnonzero(both & (size[i] == d) & (size[j] == d))
        for k in range(0, len(same), 1 << 16):
            at = same[k : k + (1 << 16)]
            with np.errstate(all="ignore"):
                out[at] = np.einsum("ab,ab->a", v[place[i[at]]], v[place[j[at]]]) / (norm[i[at]] * norm[j[at]])
            said[at] = True
    zero = both & (norm[i] * norm[j] == 0)
    out[zero] = 0.0
    return pa.array(out, mask=~(said | zero))


def _held_vectors(keys: pa.ChunkedArray, known: pa.Table) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Vectors of known (__key, __v), with a null behind them, and the place in them of each of keys."""
    vectors = pa.chunked_array([*known["__v"].chunks, pa.array([None], known["__v"].type)])
    place = pc.index_in(keys, value_set=known["__key"].combine_chunks())
    return vectors, pc.fill_null(place, len(known)).to_numpy()


def meet(pairs: DataFrame, nodes: list[DataFrame], sets: tuple = (), vectors: tuple = (), values: tuple = (), held: DataFrame | None = None) -> DataFrame:
    """Pairs (i, j, more) of numbered papers, with what columns of nodes (doi, ...), tables with one row for a paper, say: for lists of numbers how many are common (common_<name>),
    for vectors their cosine (<name>), for other columns both values (<name>_i, <name>_j).

    Pairs are dealt to blocks by the cited paper's number, crowded blocks by the citing one's hash too. A paper's row goes once to each block where it is
    needed, never along with each pair, and meets the block's pairs there; what leaves is as small as the answer. Numbers should be dense, else blocks are many.
    The papers that are needed lead, so each table of nodes is dealt once to where they are. With held (key, v), the columns of vectors are keys in it:
    a vector that many papers share goes once to each block too.
    """
    block = F.floor(F.col("j") / BLOCK).alias("__b")
    crowd = pairs.groupBy(block).agg(F.ceil(F.greatest(F.count(F.lit(1)) / SHARE, F.approx_count_distinct("i") / HELD)).alias("__k")).where("__k > 1")
    dealt = pairs.withColumn("__b", block).join(F.broadcast(crowd), "__b", "left").withColumn("__p", F.pmod(F.xxhash64("i"), F.coalesce("__k", F.lit(1)))).drop("__k")
    needed = dealt.select(F.col("i").alias("doi"), "__b", "__p").union(dealt.select("j", "__b", "__p")).distinct()
    needed = needed.groupBy("doi").agg(F.collect_list(F.struct("__b", "__p")).alias("__at"))
    rows = reduce(lambda a, b: a.join(b.select("doi", *[c for c in (*sets, *vectors, *values) if c in b.columns]), "doi", "left"), nodes, needed)
    lists = [c for name in sets for c in (name, f"__wide_{name}")]
    rows = rows.select("__at", "doi", *[c for name in sets for c in narrowed(name)], *vectors, *values)
    rows = rows.select(F.explode("__at").alias("__at"), "doi", *lists, *vectors, *values)
    rows = rows.select("__at.__b", "__at.__p", "doi", *lists, *vectors, *values)
    if held is not None:
        keyed = [t.select("doi", *[c for c in vectors if c in t.columns]) for t in nodes if any(c in t.columns for c in vectors)]
        asked = reduce(lambda a, b: a.join(b, "doi", "left"), keyed, needed).select("__at", F.explode(F.array_distinct(F.array(*vectors))).alias("key"))
        asked = asked.where("key is not null").select("key", F.explode("__at").alias("__at")).distinct().join(held.select("key", "v"), "key")
        rows = rows.unionByName(asked.select("__at.__b", "__at.__p", F.col("key").alias("__key"), F.col("v").alias("__v")), allowMissingColumns=True)
    kept, types = [c for c in pairs.columns], {f.name: f.dataType.simpleString() for t in (*nodes, pairs) for f in t.schema.fields}
    schema = [f"`{c}` {types[c]}" for c in kept] + [f"`common_{c}` long" for c in sets] + [f"`{c}` double" for c in vectors] + [f"`{c}_{e}` {types[c]}" for c in values for e in PAIR]

    keyed_vectors = held is not None

    def met(these: pa.Table, there: pa.Table) -> pa.Table:
        if keyed_vectors:
            of_paper = pc.is_null(there["__key"])
            known, there = there.filter(pc.invert(of_paper)), there.filter(of_paper)
        ids = there["doi"].to_numpy()
        order = np.argsort(ids)
        i, j = (order[np.searchsorted(ids, these[c].to_numpy(), sorter=order)] if len(these) else np.zeros(0, "int64") for c in PAIR)
        out = {c: these[c] for c in kept}
        out |= {f"common_{c}": _common(_widened(there[c], there[f"__wide_{c}"]), i, j) for c in sets}
        for c in vectors:
            column, place = _held_vectors(there[c], known) if keyed_vectors else (there[c], np.arange(len(there)))
            out[c] = _cosine(column, place[i], place[j])
        return pa.table(out | {f"{c}_{e}": there[c].take(pa.array(at)) for c in values for e, at in zip(PAIR, (i, j), strict=True)})

    return dealt.groupBy("__b", "__p").cogroup(rows.groupBy("__b", "__p")).applyInArrow(met, ", ".join(schema))


def as_lists(sets: DataFrame, name: str) -> DataFrame:
    """Set members (owner, member), distinct, as (doi, n_<name>, <name>): a list for each owner, null for those of more than SMALL."""
    n, most = F.count(F.lit(1)), SMALL
    # a list that has grown too long is dropped where it is made; none is longer than its owner's rows
    return sets.groupBy(F.col("owner").alias("doi")).agg(n.alias(f"n_{name}"), F.collect_list("member").alias("m")).select("doi", f"n_{name}", F.when(F.size("m") <= most, F.col("m")).alias(name))


def overlap_in_blocks(pairs: DataFrame, sets: dict[str, DataFrame], nodes: tuple[DataFrame, ...] = (), vectors: tuple = (), values: tuple = (), held: DataFrame | None = None) -> DataFrame:
    """meet() for several kinds of sets (owner, member) of numbered papers, with the sizes n_<name>_i and n_<name>_j, and for columns of nodes (doi, ...)."""
    out = meet(pairs, [*(as_lists(rows, name) for name, rows in sets.items()), *nodes], tuple(sets), vectors, (*[f"n_{name}" for name in sets], *values), held)
    large = {name: rows.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL) for name, rows in sets.items()}
    large = {name: rows for name, rows in large.items() if rows.limit(1).count()}
    if large:
        out = written(out, "met")
    for name in large:
        ni, nj = F.col(f"n_{name}_i"), F.col(f"n_{name}_j")
        asked = out.where(ni.isNotNull() & nj.isNotNull() & F.col(f"common_{name}").isNull())
        found = looked_up(asked.select("i", "j", ni.alias("ni"), nj.alias("nj")), sets[name]).withColumnRenamed("common", "__c")
        out = out.join(found, PAIR, "left").withColumn(f"common_{name}", F.when(ni.isNotNull() & nj.isNotNull(), F.coalesce(f"common_{name}", "__c", F.lit(0).cast("long")))).drop("__c")
    return out


def looked_up(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """(i, j, common) of asked pairs (i, j, ni, nj), if anything is: the smaller set is multiplied out, its members are looked up in the other."""
    first = F.col("ni") <= F.col("nj")
    asked = asked.select("i", "j", F.when(first, F.col("i")).otherwise(F.col("j")).alias("small"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("large"))
    members = asked.join(sets.select(F.col("owner").alias("small"), "member"), "small")
    return members.join(sets.select(F.col("owner").alias("large"), "member"), ["large", "member"]).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("common"))


def overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (i, j) and set members (owner, member), distinct: sizes ni, nj (null if none) and common.

    Candidates lead: only their sets meet, never all sets with each other. Numbered papers' sets meet in blocks; other small sets go with the pairs as
    arrays. Of a pair with a larger one only the smaller set is multiplied out, whose members are looked up in the other.
    """
    if numbered(pairs, sets):
        o = overlap_in_blocks(pairs.select(*PAIR), {"set": sets.where("owner is not null and member is not null")})
        return o.select("i", "j", F.col("n_set_i").alias("ni"), F.col("n_set_j").alias("nj"), F.col("common_set").alias("common"))
    sizes = sets.groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    few = sets.join(sizes.where(F.col("n") <= SMALL).select("owner"), "owner").groupBy("owner").agg(F.collect_list("member").alias("m"))
    owners = sizes.join(few, "owner", "left")
    out = pairs.select("i", "j")
    for end in PAIR:
        out = out.join(owners.select(F.col("owner").alias(end), F.col("n").alias(f"n{end}"), F.col("m").alias(f"m{end}")), end, "left")
    both = F.col("ni").isNotNull() & F.col("nj").isNotNull()
    met = out.select("i", "j", "ni", "nj", F.when(both & F.col("mi").isNotNull() & F.col("mj").isNotNull(), F.size(F.array_intersect("mi", "mj"))).alias("met"))
    common = looked_up(out.where(both & (F.col("mi").isNull() | F.col("mj").isNull())), sets)
    out = met.join(common, PAIR, "left")
    return out.select("i", "j", "ni", "nj", F.when(both, F.coalesce(F.col("met").cast("long"), "common", F.lit(0).cast("long"))).alias("common"))


def jaccard(common: Column, ni: Column, nj: Column) -> Column:
    return F.when(common.isNotNull(), F.coalesce(F.try_divide(common, ni + nj - common), F.lit(0.0)))


def bibcoupling(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """(i, j, bibcoupling_raw, bibcoupling_jaccard) by references (owner, member), distinct."""
    o = overlap(pairs, references)
    return o.select("i", "j", F.col("common").alias("bibcoupling_raw"), jaccard(F.col("common"), F.col("ni"), F.col("nj")).alias("bibcoupling_jaccard"))


def cocitation(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, cocitation_raw, cocitation_salton) by the citers of both; null if either isn't in the graph."""
    citers, inside = cited_by(edges), nodes.select("doi", F.lit(True).alias("there"))
    if numbered(pairs, citers):
        o = overlap_in_blocks(pairs.select(*PAIR), {"set": citers}, (inside,), values=("there",))
        return o.select("i", "j", *salton(F.when(F.col("there_i") & F.col("there_j"), F.coalesce("common_set", F.lit(0))), F.col("n_set_i"), F.col("n_set_j")))
    o = overlap(pairs, citers)
    o = o.join(inside.select(F.col("doi").alias("i"), F.col("there").alias("ti")), "i", "left").join(inside.select(F.col("doi").alias("j"), F.col("there").alias("tj")), "j", "left")
    return o.select("i", "j", *salton(F.when(F.col("ti") & F.col("tj"), F.coalesce("common", F.lit(0))), F.col("ni"), F.col("nj")))


def cited_by(edges: DataFrame) -> DataFrame:
    """(owner, member): the citers of what edges lead to."""
    return edges.select(F.col("target_doi").alias("owner"), F.col("source_doi").alias("member"))


def salton(raw: Column, ni: Column, nj: Column) -> tuple[Column, Column]:
    """cocitation_raw and cocitation_salton."""
    shared = F.coalesce(F.try_divide(raw, F.sqrt(ni.cast("double") * nj)), F.lit(0.0))
    return raw.alias("cocitation_raw"), F.when(raw.isNotNull(), shared).alias("cocitation_salton")


def author_jaccard(pairs: DataFrame, authors: DataFrame) -> DataFrame:
    o = overlap(pairs, authors)
    return o.select("i", "j", jaccard(F.col("common"), F.col("ni"), F.col("nj")).alias("author_jaccard"))


def pagerank_features(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    a, b = ranks.select(F.col("doi").alias("i"), F.col("pagerank").alias("pi")), ranks.select(F.col("doi").alias("j"), F.col("pagerank").alias("pj"))
    rows = pairs.join(a, "i", "left").join(b, "j", "left")
    both = F.col("pi").isNotNull() & F.col("pj").isNotNull()
    return rows.select("i", "j", F.when(both, F.col("pj")).alias("pagerank_target"), F.when(both, F.least("pi", "pj")).alias("pagerank_min"), F.when(both, F.col("pi") * F.col("pj")).alias("pagerank_product"))


def citation_frequency(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(i, j, citation_count, citation_total, citation_freq) of mentions (i, j, n): how often i cites j, and anything.

    The total counts mentions without a DOI as well. No total, or one of 0, leaves the frequency null.
    """
    total = mentions.groupBy("i").agg(F.sum("n").alias("citation_total"))
    per = mentions.where("j is not null").groupBy("i", "j").agg(F.sum("n").alias("n"))
    rows = pairs.join(total, "i", "left").join(per, PAIR, "left")
    count = F.when(F.col("citation_total").isNotNull(), F.coalesce("n", F.lit(0)))
    return rows.select("i", "j", count.alias("citation_count"), "citation_total", F.try_divide(count, F.col("citation_total")).alias("citation_freq"))


def semantic(pairs: DataFrame, vectors: DataFrame, name: str, held: DataFrame | None = None) -> DataFrame:
    """(i, j, name): cosine of vectors (doi, v); null if either is missing. With held (key, v), those of numbered papers are keys in it."""
    if numbered(pairs, vectors.select("doi")):
        return meet(pairs.select(*PAIR), [vectors.select("doi", F.col("v").alias(name))], vectors=(name,), held=held)
    vectors = vectors if held is None else vectors.withColumnRenamed("v", "key").join(held, "key").select("doi", "v")
    a, b = vectors.select(F.col("doi").alias("i"), F.col("v").alias("vi")), vectors.select(F.col("doi").alias("j"), F.col("v").alias("vj"))
    return pairs.join(a, "i", "left").join(b, "j", "left").select("i", "j", vector.cosine(F.col("vi"), F.col("vj")).alias(name))


def of_met(met: DataFrame) -> list[Column]:
    """The features of pairs whose sets refs, citers and authors, vectors, ranks and places in the graph have met; other columns stay."""
    n = lambda name: (F.col(f"common_{name}"), F.col(f"n_{name}_i"), F.col(f"n_{name}_j"))
    both = lambda name: F.when(n(name)[1].isNotNull() & n(name)[2].isNotNull(), n(name)[0])
    pi, pj = F.col("pagerank_i"), F.col("pagerank_j")
    ranked = pi.isNotNull() & pj.isNotNull()
    inside = F.when(F.col("there_i") & F.col("there_j"), F.coalesce(both("citers"), F.lit(0)))
    out = [both("refs").alias("bibcoupling_raw"), jaccard(both("refs"), *n("refs")[1:]).alias("bibcoupling_jaccard"), *salton(inside, *n("citers")[1:])]
    out += [F.when(ranked, pj).alias("pagerank_target"), F.when(ranked, F.least(pi, pj)).alias("pagerank_min"), F.when(ranked, pi * pj).alias("pagerank_product")]
    out += [jaccard(both("authors"), *n("authors")[1:]).alias("author_jaccard"), F.col("title_sim"), F.col("abstract_sim")]
    return out + [F.col(c) for c in ("citation_count", "citation_total", "citation_freq")]


def assemble(pairs: DataFrame, *features: DataFrame) -> DataFrame:
    """Candidate edges with all features, by left joins on the pair."""
    for f in features:
        pairs = pairs.join(f, PAIR, "left")
    return pairs


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, non_null, rate) of each column: one pass."""
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("non_null")) for c in columns])
    return one.select("rows", F.explode(cells).alias("x")).select("x.feature", "x.non_null", F.coalesce(F.try_divide("x.non_null", "rows"), F.lit(0.0)).alias("rate"))


def coverage_tier(degrees: DataFrame, high: float = 50, medium: float = 10) -> DataFrame:
    """(papers, mean_in_degree, tier) of the local papers' in-degrees."""
    one = degrees.agg(F.count(F.lit(1)).alias("papers"), F.avg("in_degree").alias("mean_in_degree"))
    m = F.col("mean_in_degree")
    return one.withColumn("tier", F.when(m >= high, "high").when(m >= medium, "medium").otherwise("low"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's coefficient from moments: null for fewer than 2 rows or a constant column, without an ANSI error."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(x)
    cov = F.covar_pop(x, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((n >= 2) & (spread > 1e-300), F.try_divide(cov, spread))


def running(values: DataFrame, c: str, n: str, name: str) -> DataFrame:
    """values (c, n), one row for each c, with the sum of n over all smaller c as `name`.

    Values are dealt to ranges; a range is summed up by itself and shifted by the totals of the ranges before it,
    a table of as many rows as there are ranges. No task sees all values.
    """
    from pyspark.sql import Window

    values = written(values.repartitionByRange(c).withColumn("__p", F.spark_partition_id()), "ranges")
    totals = values.groupBy("__p").agg(F.sum(n).alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy("__p").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = values.withColumn("__i", inside).join(totals.select(F.col("__p").alias("__q"), before.alias("__b")), F.col("__p") == F.col("__q"))
    return shifted.select(c, n, (F.col("__i") + F.col("__b")).alias(name))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman): Pearson's coefficient of average ranks of the rows that have both columns, null as pearson() is.

    Ranks come from running counts of distinct values, and what they meet is the distinct pairs of values with their numbers, not the rows.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)

    def ranks(c: str, name: str) -> DataFrame:
        values = running(both.groupBy(c).agg(F.count(F.lit(1)).alias("__n")), c, "__n", "__before")
        return values.select(c, (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))

    met = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("__m")).join(ranks(x, "rx"), x).join(ranks(y, "ry"), y)
    met = met.join(F.broadcast(both.agg(F.count(F.lit(1)).alias("__all"))))
    # average ranks have this mean, so those of a constant column are 0 from it
    dx, dy = (F.col(c) - (F.col("__all") + 1) / 2 for c in ("rx", "ry"))
    one = met.agg(F.sum("__m").alias("n"), *[F.sum(F.col("__m") * d).alias(c) for c, d in (("xy", dx * dy), ("xx", dx * dx), ("yy", dy * dy))])
    spread = F.sqrt("xx") * F.sqrt("yy")
    return one.select(F.when((F.col("n") >= 2) & (spread > 0), F.try_divide("xy", spread)).alias("spearman"))
