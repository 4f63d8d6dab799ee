"""Operator 6, exact top-k search: an impact-ordered index of integer vectors, read score at a time.

Candidates come in blocks, queries are sent past each block in a stream. In a block each component's values are
quantised to levels, and a (component, level) segment lists who has it. A query takes the segments by falling impact, adds impacts to accumulators,
and stops only when bounds prove who may still be among its k best; these are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

#: Candidates of a block, width of a quantised level, share of postings read between two proofs.
BLOCK, WIDTH, SHARE = 4096, 16, 16
#: Tasks at most; a task takes its blocks one after the other.
TASKS = 20_000


def usable(v: Column) -> Column:
    """Whether a vector isn't null and holds neither nulls nor non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Index:
    """The segments of a block of integer vectors (rows of `values`)."""

    def __init__(self, values: np.ndarray, width: int = WIDTH):
        self.values, self.width = values, width
        self.most = int(np.abs(values.astype(float)).max()) if values.size else 0
        n, d = values.shape
        level = values // width
        ids, dims, levels, starts = [], [], [], [0]
        for j in range(d):
            order = np.argsort(level[:, j], kind="stable").astype(np.int64)
            cut = np.flatnonzero(np.diff(level[order, j], prepend=level[order[0], j] - 1)) if n else np.zeros(0, np.int64)
            ids.append(order)
            dims += [j] * len(cut)
            levels.append(level[order[cut], j])
            starts += [j * n + int(x) for x in [*cut[1:], n]]
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.dims, self.levels = np.array(dims, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.int64)
        self.starts, self.sizes = np.array(starts[:-1], np.int64), np.diff(starts)

    def best(self, query: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best for query, all that are included; `own` rows don't count."""
        n, d = self.values.shape
        # few candidates, or sums that doubles don't hold to the last unit: all are scored
        if n <= 4 * k or (self.most + self.width) * int(np.abs(query.astype(float)).max(initial=0)) * 4 * d >= 1 << 52:
            return np.flatnonzero(~own)
        q = query[self.dims]
        high = np.maximum(q * self.levels * self.width, q * (self.levels * self.width + self.width - 1))
        least = np.full(d, np.iinfo(np.int64).max)
        np.minimum.at(least, self.dims, np.minimum(q * self.levels * self.width, q * (self.levels * self.width + self.width - 1)))
        impact = high - least[self.dims]  # 0 at least, and no less than what a member adds above the component's least
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(self.sizes[order])
        slack = int((self.width - 1) * np.abs(query).sum())
        # what a member adds may be less than its segment's impact by this much over all components
        total, seen, at = np.zeros(n), np.zeros(n, np.int64), 0
        while at < len(order):
            end = int(np.searchsorted(done, (done[at - 1] if at else 0) + max(1, n * d // SHARE))) + 1
            part = order[at:end]
            at = min(end, len(order))
            sizes = self.sizes[part]
            rows = self.ids[np.repeat(self.starts[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            total += np.bincount(rows, np.repeat(impact[part], sizes), n)
            seen += np.bincount(rows, minlength=n)
            rest = impact[order[at]] if at < len(order) else 0
            low = np.where(own, -np.inf, total - slack)
            bar = np.partition(low, n - k)[n - k]
            may = (total + (d - seen) * rest >= bar) & ~own
            if rest == 0 or may.sum() <= max(4 * k, n // 64):
                return np.flatnonzero(may)
        return np.flatnonzero(may)


def scores(values: np.ndarray, query: np.ndarray, most: int) -> np.ndarray:
    """Inner products, to the last unit; such as 64 bits don't hold are an error."""
    if most * int(np.abs(query.astype(float)).max(initial=0)) * max(1, len(query)) < 1 << 62:
        return values @ query
    exact = values.astype(object) @ query.astype(object)
    if any(abs(x) >= 1 << 63 for x in exact):
        raise OverflowError("an inner product is beyond 64 bits")
    return exact.astype(np.int64)


def top_k(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "ints", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, key, score): of each query row the k rows of other keys with the highest inner product.

    vector is an array of integers; ties go to the smaller key, then a repeated key appears as often as it has rows.
    Rows with null keys or null vectors take no part, and only vectors of a query's length are its candidates.
    A task holds a block of candidates, whose index is made once, and a batch of the queries that stream past it.
    Inner products beyond 64 bits are an error. Fewer candidates than k give as many rows; an empty table none.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"), is_query.alias("q"))
    rows = written(rows.withColumn("d", F.size("v")), "topk-rows")
    n = rows.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / block).alias("cs"), F.count_if("q").alias("qs")).where("qs > 0")
    blocks = n.agg(F.sum("cs").alias("b")).first()["b"] or 1
    dealt = rows.join(n, "d")
    held = dealt.select("d", F.pmod(F.xxhash64("id"), F.col("cs")).alias("c"), F.lit(0).alias("kind"), "id", "v")
    asked = dealt.where("q").select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cs") - 1)).alias("c"), F.lit(1).alias("kind"), "id", "v")
    schema = f"query_id bigint, {key} bigint, score bigint"
    names = ["query_id", key, "score"]

    def search(batches):
        at, ids, parts, index = None, [], [], None
        for b in batches:
            d, c, kind, id_ = (b.column(i).to_numpy() for i in range(4))
            v = b.column(4)
            # runs of rows of one block and kind
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (kind[1:] != kind[:-1])))) if len(d) else ()
            for x, y in zip(new, [*new[1:], len(d)], strict=True):
                if at != (d[x], c[x]):
                    at, ids, parts, index = (d[x], c[x]), [], [], None
                values = v.slice(x, y - x).flatten().to_numpy().reshape(y - x, -1) if d[x] else np.zeros((y - x, 0), np.int64)
                if kind[x] == 0:
                    ids.append(id_[x:y].copy())
                    parts.append(values.copy())
                    continue
                if not parts:
                    continue
                if index is None:
                    index, ids, parts = Index(np.concatenate(parts)), np.concatenate(ids), [True]
                out = ([], [], [])
                for qid, q in zip(id_[x:y], values, strict=True):
                    may = index.best(q, k, ids == qid)
                    score = scores(index.values[may], q, index.most)
                    best = np.lexsort((ids[may], -score))[:k]
                    out[0].append(np.full(len(best), qid))
                    out[1].append(ids[may[best]])
                    out[2].append(score[best])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], names=names)

    both = held.union(asked).repartition(max(1, min(TASKS, blocks)), "d", "c").sortWithinPartitions("d", "c", "kind")
    found = both.mapInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def op6(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("ints"))
    return top_k(rows, F.col("vec_id") % 100 == 0)
