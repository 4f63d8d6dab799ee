"""Vector retrieval: the nearest of stored chunks, contexts, prompts and conversations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of a block: so many of either side meet in a task, as one matrix product.
BLOCK = 2048
#: Cosines are compared by six decimals; what is nearer to the k-th best than this may still be among them.
PLACES, SLACK, SPARE = 6, 2e-6, 4


def candidates(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, block: int = BLOCK, largest: bool = False) -> DataFrame:
    """(keys, query_id, id, score): of queries (keys, query_id, q) the rows (keys, id, v) that may be among the k of highest cosine.

    Of a block at most SPARE times k go on for each query: of ties those with the smallest ids, or with the largest.

    Both sides are dealt to blocks within their keys, and each block of queries meets each block of rows in a task of its
    own, so a common key is many tasks. A zero vector has the cosine 0 with everything; vectors that are null or hold
    nulls take no part, nor do pairs of different lengths. Equal ids aren't compared if both are of one type.
    """
    same = queries.schema["query_id"].dataType == rows.schema["id"].dataType
    good = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    left = queries.where(good("q")).select(*keys, "query_id", F.col("q").cast("array<double>").alias("q"), F.size("q").alias("__d"))
    right = rows.where(good("v")).select(*keys, "id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("__d"))
    by = [*keys, "__d"]
    lefts = left.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("__qs"))
    rights = right.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("__rs"))
    sizes = lefts.join(rights, by)
    series = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = left.join(sizes, by).select(*by, "query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("__qs")).alias("__x"), series("__rs").alias("__y"))
    right = right.join(sizes, by).select(*by, "id", "v", F.pmod(F.xxhash64("id"), F.col("__rs")).alias("__y"), series("__qs").alias("__x"))
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))
    out = T.StructType([*[rows.schema[c] for c in keys], T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def unit(table: pa.Table, c: str) -> np.ndarray:
        x = table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = [*keys, "query_id", "id", "score"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([held.column(c).slice(0, 0) for c in keys] + [asked.column("query_id").slice(0, 0), held.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
        q, v = unit(asked, "q"), unit(held, "v")
        qs, ids = asked.column("query_id"), held.column("id")
        qn, vn = (np.array(c.to_pylist(), object) for c in (qs, ids)) if same else (None, None)
        order = pc.rank(ids, sort_keys="ascending").to_numpy().astype(np.int64) * (-1 if largest else 1)
        hits_q, hits_v, scores = [], [], []
        for at in range(0, len(q), 256):
            found = q[at : at + 256] @ v.T
            if same:
                found[qn[at : at + 256, None] == vn[None]] = -np.inf
            bar = np.partition(found, -k, axis=1)[:, -k] if k < len(v) else np.full(len(found), -2.0)
            i, j = np.nonzero(found >= np.maximum(bar, -2.0)[:, None] - SLACK)
            by_score = np.lexsort((order[j], -np.round(found[i, j], PLACES), i))
            i, j = i[by_score], j[by_score]
            first = np.searchsorted(i, i)  # where a query's rows begin
            few = np.arange(len(i)) - first < SPARE * k
            i, j = i[few], j[few]
            hits_q.append(i + at)
            hits_v.append(j)
            scores.append(found[i, j])
        i, j = np.concatenate(hits_q), np.concatenate(hits_v)
        return pa.table([held.column(c).take(pa.array(j)) for c in keys] + [qs.take(pa.array(i)), ids.take(pa.array(j)), pa.array(np.concatenate(scores))], names=names)

    tile = [*by, "__x", "__y"]
    return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(meet, out)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score) of queries (query_id, q) and rows (id, v): the k highest cosines, ties to the smaller id.

    A query isn't compared with the row of its own id.
    """
    found = candidates(queries, rows, [], k, block).withColumn("score", F.round("score", PLACES))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def context_of(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, context) of ranked rows and chunks (id, source, content)."""
    rows = found.join(chunks, "id")
    part = F.concat(F.lit("Source: "), F.col("source"), F.lit("\nContent: "), F.col("content"))
    parts = F.sort_array(F.collect_list(F.struct(F.col("rank"), part.alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n").alias("context"))


def rag_prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question with the context.\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query)


def web_prompt(query: Column, message: Column) -> Column:
    return F.concat(F.lit("Answer the question with these search results.\n\nResults:\n"), message, F.lit("\n\nQuestion: "), query)


def expand_queries(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """(query_id, pos, query): the query itself and each line of a model's rewriting of it."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("query_id", F.posexplode(F.array_prepend(lines, F.col("query"))).alias("pos", "query"))


def messages(turns: DataFrame, system: str | None = None) -> DataFrame:
    """(conv_id, n_turns, transcript) of turns (conv_id, turn, role, text), in order; a system text leads if given."""
    line = F.concat(F.coalesce(F.col("role"), F.lit("")), F.lit(": "), F.coalesce(F.col("text"), F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct(F.col("turn"), line.alias("t"))))
    body = F.array_join(F.transform(rows, lambda x: x["t"]), "\n")
    head = F.concat(F.lit(f"system: {system}\n"), body) if system else body
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), head.alias("transcript"))


def to_embed(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks of sources that the store doesn't have yet."""
    return chunks.join(store.select("source").distinct(), "source", "left_anti")


def append(store: DataFrame, more: DataFrame) -> DataFrame:
    """The store with the rows of sources that it doesn't have yet."""
    return store.unionByName(to_embed(more, store))


def known_sources(store: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (source) with boolean there: whether the store has anything of it."""
    return asked.select("source").distinct().join(store.select("source", F.lit(True).alias("there")).distinct(), "source", "left").withColumn("there", F.coalesce("there", F.lit(False)))


#: What a search that failed says.
NOTHING, FAILED = "Can't find", "Error"


def search_message(results: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, message) of search results (key, pos, title, href, body): numbered in order, those without href left out.

    Queries whose results are all left out say that nothing was found.
    """
    kept = F.collect_list(F.when(F.col("href").isNotNull() & (F.col("href") != ""), F.struct("pos", "title", "href", "body")))
    line = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["title"], F.lit("")), F.lit("\n"), x["href"], F.lit("\n"), F.coalesce(x["body"], F.lit("")))
    text = F.array_join(F.transform(F.sort_array(kept), line), "\n\n")
    return results.groupBy(key).agg(text.alias("message")).withColumn("message", F.when(F.col("message") == "", f"{NOTHING} any result.").otherwise(F.col("message")))


def first_answer(answers: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, method, message) of answers (key, priority, method, message): the first that didn't fail, null if all did."""
    failed = F.col("message").isNull() | F.col("message").contains(NOTHING) | F.col("message").contains(FAILED)
    best = answers.groupBy(key).agg(F.min(F.when(~failed, F.struct("priority", "method", "message"))).alias("m"))
    return best.select(key, "m.method", "m.message")


def delete_source(store: DataFrame, source: str) -> DataFrame:
    return store.where(F.coalesce(F.col("source") != source, F.lit(True)))
