"""References against records: the record that shares most words, and texts that contain one another, without hot words."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_form
from ..sources.tables import written

#: Records of a word up to which the rounds of best_overlap() read its list; the last round reads what is still needed.
ROUNDS = (32, 1024, 32768, None)
#: References of a block, records of one that meet it in a task, and counts of both that are held at a time.
BLOCK, PART, CELLS = 2048, 1 << 14, 1 << 22
#: Characters of the pieces that texts are looked up by, and those of a text that are cut at a time.
GRAM, CUT = 8, 256
#: Characters and pairs of texts of a key up to which they meet in one task, and about how many characters of such keys a task has.
CHARS, TRIED, BUNDLE = 1 << 19, 1 << 21, 1 << 22


def words_of(c: Column, letters: int) -> Column:
    return F.array_distinct(F.filter(F.split(match_form(c), " "), lambda w: F.length(w) >= letters))


def best_overlap(asked: DataFrame, held: DataFrame, rounds: tuple = ROUNDS) -> DataFrame:
    """(key, doi, shared) of asked (key, words) and held (doi, words), arrays of words: the doi that shares most with each, ties to the smaller.

    Words that nothing asks for are left out where they are read; the others are numbers. Of a doi with several rows the words count together.
    Words count from the rarest on. If a record with b words in common is known, only records with one of a
    reference's n - b + 1 rarest words can be better or as good, so common words are seldom looked up: they only count. A
    single word's answer stands in the dictionary. References with the same words are asked once. Those that share no
    word with anything have no row. What references and records have in common is counted in blocks of references, to each of which a record goes once.
    """
    words = written(asked.select(F.explode("words").alias("w")).distinct().withColumn("id", F.monotonically_increasing_id()), "overlap-words")
    numbers = lambda rows, key: rows.select(key, F.explode("words").alias("w")).join(words, "w").groupBy(key).agg(F.collect_set("id").alias("ids"))
    records = written(numbers(held, "doi"), "overlap-records")
    postings = records.select("doi", F.explode("ids").alias("id"))
    counts = written(postings.groupBy("id").agg(F.count(F.lit(1)).alias("df"), F.min("doi").alias("first")), "overlap-counts")
    mine = numbers(asked, "key").select("key", F.explode("ids").alias("id")).join(counts, "id").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "id"))).alias("ws"), F.min("first").alias("first"))
    mine = written(mine, "overlap-asked")
    ids = F.transform("ws", lambda w: w["id"])
    sets = written(mine.groupBy("ws").agg(F.min("first").alias("first")).select(F.monotonically_increasing_id().alias("set"), ids.alias("ids"), F.transform("ws", lambda w: w["df"]).alias("dfs"), F.size("ws").alias("n"), "first"), "overlap-sets")
    # one word is shared with the least record that has any; shared counts down, so that the least is best
    state = sets.select("set", F.struct(F.lit(-1).alias("less"), F.col("first").alias("doi")).alias("best"), F.lit(0).alias("read"))
    for most in rounds:
        need = lambda: F.when(F.col("best.less") == -1, F.col("n") - 1).otherwise(F.col("n") + F.col("best.less") + 1)
        open_ = written(sets.join(state, "set").where(F.col("read") < need()).select("set", "ids", "dfs", "n", "best", "read"), "overlap-open")
        if not open_.limit(1).count():
            break
        rare = F.lit(2**31 - 1) if most is None else F.size(F.filter("dfs", lambda x: x <= most))
        todo = open_.withColumn("upto", F.least(rare, need()))
        look = todo.select("set", F.explode(F.slice("ids", F.col("read") + 1, F.greatest(F.col("upto") - F.col("read"), F.lit(0)))).alias("id"))
        found = _shared(open_.select("set", "ids"), look, records, postings).groupBy("set").agg(F.min(F.struct("less", "doi")).alias("now"))
        new = todo.join(found, "set", "left").select("set", F.least("best", F.coalesce("now", "best")).alias("best"), F.greatest("upto", "read").alias("read"))
        state = written(state.join(new.select("set"), "set", "left_anti").unionByName(new), "overlap-state")
    found = sets.join(state, "set").select(F.struct("ids", "dfs").alias("s"), "best.doi", (-F.col("best.less")).cast("long").alias("shared"))
    named = mine.select("key", F.struct(ids.alias("ids"), F.transform("ws", lambda w: w["df"]).alias("dfs")).alias("s"))
    return named.join(found, "s").select("key", "doi", "shared")


def _shared(sets: DataFrame, look: DataFrame, records: DataFrame, postings: DataFrame) -> DataFrame:
    """(set, less, doi): of each block of sets (set, ids) and each part of the records (doi, ids) that one of them looks up, by look (set, id) and
    postings (doi, id), the record that shares most with each set, ties to the smaller doi; less is the negative count."""
    n = sets.count()
    block = F.pmod(F.xxhash64("set"), F.lit(-(-n // BLOCK) or 1)).alias("__x")
    met = look.select("id", block).distinct().join(postings, "id").select("__x", "doi").distinct()
    rows = records.join(met, "doi").select("__x", "doi", "ids")
    sizes = met.groupBy("__x").agg(F.ceil(F.count(F.lit(1)) / PART).alias("__n"))
    rows = rows.join(sizes, "__x").select("__x", F.pmod(F.xxhash64("doi"), F.col("__n")).alias("__y"), "doi", "ids")
    asked = sets.withColumn("__x", block).join(sizes, "__x").select("__x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__y"), "set", "ids")
    kind = f"set bigint, less int, doi {records.schema['doi'].dataType.simpleString()}"

    def most(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), b["doi"].slice(0, 0)], names=["set", "less", "doi"])
        b = b.take(pc.sort_indices(b["doi"]))  # of equal counts the first is the smallest
        mine, theirs = a["ids"].combine_chunks(), b["ids"].combine_chunks()
        word, owner = mine.flatten().to_numpy(), np.repeat(np.arange(len(mine)), np.diff(mine.offsets.to_numpy()))
        order = np.argsort(word, kind="stable")
        owner = owner[order]
        known, first, many = np.unique(word[order], return_index=True, return_counts=True)
        begin, values = theirs.offsets.to_numpy() - theirs.offsets[0].as_py(), theirs.flatten().to_numpy()
        best, where, step = np.zeros(len(mine), "int64"), np.zeros(len(mine), "int64"), max(1, CELLS // len(mine))
        for k in range(0, len(theirs), step):
            upto = min(k + step, len(theirs))
            v, row = values[begin[k] : begin[upto]], np.repeat(np.arange(upto - k), np.diff(begin[k : upto + 1]))
            at = np.minimum(np.searchsorted(known, v), len(known) - 1)
            row, at = row[known[at] == v], at[known[at] == v]
            cells, ends, f = np.zeros((upto - k) * len(mine), "int64"), np.cumsum(many[at]), 0
            while f < len(at):
                g = max(f + 1, int(np.searchsorted(ends, (ends[f - 1] if f else 0) + CELLS, "right")))
                m = many[at[f:g]]
                hit = owner[np.repeat(first[at[f:g]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                cells += np.bincount(np.repeat(row[f:g], m) * len(mine) + hit, minlength=len(cells))
                f = g
            cells = cells.reshape(upto - k, len(mine))
            now = cells.argmax(0)
            more = cells[now, np.arange(len(mine))]
            where, best = np.where(more > best, now + k, where), np.maximum(best, more)
        some = best > 0
        return pa.table([a["set"].filter(pa.array(some)), pa.array(-best[some].astype("int32")), b["doi"].take(pa.array(where[some]))], names=["set", "less", "doi"])

    return asked.groupBy("__x", "__y").cogroup(rows.groupBy("__x", "__y")).applyInArrow(most, kind)


def best_record(references: DataFrame, titles: DataFrame, key: str = "ref_id", letters: int = 3) -> DataFrame:
    """(key, doi, shared) of free-text references (key, text): the title (doi, title) that shares most words with each, ties to the smaller DOI.

    Words of fewer than `letters` letters don't count. A reference that shares none has a null doi. Of several texts with one key the words count together.
    """
    asked = references.select(F.col(key).alias("key"), words_of(F.col("text"), letters).alias("words"))
    held = titles.where("doi is not null").select("doi", words_of(F.col("title"), letters).alias("words"))
    best = best_overlap(asked, held).withColumnRenamed("key", key)
    return references.select(key).distinct().join(best, key, "left").select(key, "doi", "shared")


def grams(c: Column, q: int) -> Column:
    """The distinct pieces of q characters of a text. Where a text is cut is counted from its begin, so it is first cut into parts."""
    n, most = F.length(c), CUT
    upto = lambda k: F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(upto(F.ceil((n - q + 1) / most).cast("int")), lambda k: F.substring(c, (k - 1) * most + 1, F.lit(most + q - 1)))
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.transform(upto(F.length(x) - q + 1), lambda i: F.substring(x, i, F.lit(q))))))


def contained(texts: DataFrame, inside: DataFrame, keys: list[str], q: int = GRAM) -> DataFrame:
    """(keys, outer, inner) of texts (keys, outer) and inside (keys, inner), distinct and not empty: where outer contains inner.

    An inner text is looked up by the rarest of its pieces of q characters; a shorter one is itself a piece, of its own length. Only texts
    that have the piece are compared, so what many texts have in common is no reason to compare them. Pieces go with the number of their text and as
    hashes, which may only lead to more comparisons.
    """
    known = lambda rows, c, name: written(rows.select(*keys, c).where(F.col(c) != "").distinct().withColumn(f"__{c}", F.monotonically_increasing_id()), name)
    outer, inner = known(texts, "outer", "outer"), known(inside, "inner", "inner")
    inner = inner.withColumn("__q", F.least(F.length("inner"), F.lit(q)))
    lengths = inner.select(*keys, "__q").distinct()
    # for each length that is asked for under a key, its pieces
    pieces = lambda rows, c: reduce(DataFrame.union, [rows.where(F.col("__q") == n).select(*keys, f"__{c}", F.explode(F.transform(grams(F.col(c), n), lambda g: F.xxhash64(g))).alias("__g")) for n in range(1, q + 1)])
    index, wanted = written(pieces(outer.join(lengths, keys), "outer"), "grams"), pieces(inner, "inner")
    counts = index.groupBy(*keys, "__g").agg(F.count(F.lit(1)).alias("__n"))
    # a piece that nothing has rules its text out
    rarest = wanted.join(counts, [*keys, "__g"], "left").groupBy(*keys, "__inner").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__g").alias("g"))).alias("m"))
    look = rarest.where("m.n > 0").select(*keys, "__inner", F.col("m.g").alias("__g"))
    met = look.join(index, [*keys, "__g"]).select("__inner", "__outer").distinct()
    met = met.join(inner.select(*keys, "inner", "__inner"), "__inner").join(outer.select("outer", "__outer"), "__outer")
    return met.where(F.col("outer").contains(F.col("inner"))).select(*keys, "outer", "inner")


def within(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, norm, ref_pos) of asked (key, norm) and known (key, rnorm, ref_pos), distinct and not empty: the least ref_pos whose text contains norm or is inside it.

    Texts of a small key meet in a task together with other small keys, so that texts are shuffled once and never cut into pieces; those of a
    key with more than CHARS characters or TRIED pairs are looked up by their pieces.
    """
    count = lambda rows, c, n: rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"__{n}"), F.sum(F.length(c)).alias(f"__c{n}"))
    sizes = count(asked, "norm", "a").join(count(known, "rnorm", "k").hint("merge"), key)
    sizes = written(sizes.select(key, ((F.col("__ca") + F.col("__ck") > CHARS) | (F.col("__a") * F.col("__k") > TRIED)).alias("__large"), (F.col("__ca") + F.col("__ck")).alias("__c")), "within-keys")
    told = sizes.agg(F.sum(F.when(~F.col("__large"), F.col("__c"))).alias("c"), F.count_if("__large").alias("large")).first()
    bundle = F.pmod(F.xxhash64(key), F.lit(1 + (told["c"] or 0) // BUNDLE)).alias("__b")
    of = lambda rows, large: rows.join(sizes.where(F.col("__large") == large).select(key).hint("merge"), key, "left_semi")
    kinds = {c: rows.schema[c].dataType.simpleString() for rows, c in ((asked, key), (asked, "norm"), (known, "ref_pos"))}

    def met(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        texts: dict = {}
        theirs = theirs.sort_by("ref_pos")
        for at, (k, text) in enumerate(zip(theirs[key].to_pylist(), theirs["rnorm"].to_pylist(), strict=True)):
            texts.setdefault(k, []).append((at, text))
        rows, found = [], []
        for row, (k, norm) in enumerate(zip(mine[key].to_pylist(), mine["norm"].to_pylist(), strict=True)):
            at = next((at for at, text in texts.get(k, ()) if text in norm or norm in text), None)
            if at is not None:
                rows.append(row)
                found.append(at)
        rows, found = pa.array(rows, pa.int64()), pa.array(found, pa.int64())
        return pa.table({key: mine[key].take(rows), "norm": mine["norm"].take(rows), "ref_pos": theirs["ref_pos"].take(found)})

    schema = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
    small = of(asked, False).select(bundle, key, "norm").groupBy("__b").cogroup(of(known, False).select(bundle, key, "rnorm", "ref_pos").groupBy("__b")).applyInArrow(met, schema)
    if not told["large"]:
        return small
    more, held = of(asked, True), of(known, True)
    longer = contained(more.select(key, F.col("norm").alias("outer")), held.select(key, F.col("rnorm").alias("inner")), [key]).select(key, F.col("outer").alias("norm"), F.col("inner").alias("rnorm"))
    shorter = contained(held.select(key, F.col("rnorm").alias("outer")), more.select(key, F.col("norm").alias("inner")), [key]).select(key, F.col("inner").alias("norm"), F.col("outer").alias("rnorm"))
    return small.union(longer.union(shorter).join(held, [key, "rnorm"]).groupBy(key, "norm").agg(F.min("ref_pos").alias("ref_pos")))


def resolve_references(raws: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, raw, ref_pos, tier) for raws (key, raw) and refs (key, ref_pos, text): the first match.

    Tiers: 1 equal, 2 equal when normalised, 3 one normalised text inside the other. Only texts of one document are compared.
    """
    a = written(raws.select(key, "raw").distinct().withColumn("norm", match_form(F.col("raw"))), "raws")
    b = refs.select(key, "ref_pos", "text").withColumn("rnorm", match_form(F.col("text")))
    equal = a.join(b.select(F.col(key).alias("__k"), F.col("rnorm"), "ref_pos", "text"), (F.col(key) == F.col("__k")) & (F.col("norm") == F.col("rnorm")))
    equal = written(equal.select(key, "raw", F.when(F.col("raw") == F.col("text"), 1).otherwise(2).alias("tier"), "ref_pos"), "equal")
    # equal texts are equal when normalised; only what has none of these is looked for inside the others
    left = a.where("norm <> ''").join(equal.select(key, "raw").distinct(), [key, "raw"], "left_anti")
    left = written(left, "unequal")
    known = written(b.where("rnorm <> ''").groupBy(key, "rnorm").agg(F.min("ref_pos").alias("ref_pos")), "references")
    asked = left.select(key, "norm").distinct()
    part = left.join(within(asked, known, key), [key, "norm"]).select(key, "raw", F.lit(3).alias("tier"), "ref_pos")
    best = equal.union(part).groupBy(key, "raw").agg(F.min(F.struct("tier", "ref_pos")).alias("m"))
    return raws.select(key, "raw").distinct().join(best, [key, "raw"], "left").select(key, "raw", "m.ref_pos", "m.tier")


def match_titles(raws: DataFrame, refs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, raw, title) for raws (key, raw) and refs (key, ref_pos, text, title): the title of the reference that each resolves to.

    Null where none is found, or where the reference that is found has no title.
    """
    found = resolve_references(raws, refs, key)
    return found.join(refs.select(key, "ref_pos", "title"), [key, "ref_pos"], "left").select(key, "raw", "title")
