"""Operator 9, embedding near-dedup: product quantisation.

Vectors go to the inverted list of their nearest coarse centroid, coded by subspaces of what the centroid
leaves. A vector probes every list that can hold one within the threshold of it, estimates by table look-ups,
and what the codes' known errors don't rule out is compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, done, matched, written
from .topk import usable

#: Vectors from which the codebooks are fitted at most, by their hash; subspaces, codes of each, rounds.
SAMPLE, SUBSPACES, CODES, ROUNDS = 20_000, 8, 32, 8
#: Vectors of the sample for each list; lengths of vectors, the most frequent ones, that have codebooks of their own.
FOR_LIST, LENGTHS = 8, 64
#: Vectors of a list's block, and probing vectors that meet it at a time.
BLOCK, PROBES = 1024, 2048
LAST = 2**63 - 1


def kmeans(x: np.ndarray, k: int, unit: bool, seed: int = 7) -> np.ndarray:
    """k centroids, on the unit sphere if asked for; rows that attract none are drawn anew."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T - (0 if unit else 0.5 * (c * c).sum(1)), axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Quantiser:
    """Coarse centroids and codebooks of the residuals, for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.coarse = kmeans(sample, lists, True)
        d = sample.shape[1]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        rest = sample - self.coarse[np.argmax(sample @ self.coarse.T, axis=1)]
        self.books = [kmeans(rest[:, a:b], CODES, False) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.squares = (self.coarse * self.coarse).sum(1)

    def place(self, x: np.ndarray):
        """List, codes and coding error of each vector, and the lists that it has to probe."""
        dots = x @ self.coarse.T
        own = np.argmax(dots, axis=1)
        rest = x - self.coarse[own]
        codes = np.stack([np.argmax(rest[:, a:b] @ c.T - 0.5 * (c * c).sum(1), axis=1) for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:], strict=True), self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([c[codes[:, m]] for m, c in enumerate(self.books)], axis=1)
        error = np.linalg.norm(rest - back, axis=1)
        # If y is nearest to c' and x to c then (x - y)(c - c') >= x (c - c'): beyond reach * |c - c'| nothing
        # in the list of c' is within reach of x.
        gaps = np.sqrt(np.maximum(self.squares[own][:, None] + self.squares - 2 * (self.coarse @ self.coarse.T)[own], 0.0)) if len(self.coarse) <= len(x) else np.linalg.norm(self.coarse[own][:, None] - self.coarse, axis=2)
        # rounding of a gap between centroids that are all but equal can only add a probe
        probes = dots[np.arange(len(x)), own][:, None] - dots <= self.reach * (gaps + 1e-7) + 1e-9
        return own, codes, error, probes

    def estimate(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of rows of x with the coded vectors of a list, from tables of each subspace."""
        out = np.repeat((x @ self.coarse[cell])[:, None], len(codes), axis=1)
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            out += (x[:, a:b] @ self.books[m].T)[:, codes[:, m]]
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", sample: int = SAMPLE, block: int = BLOCK, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) of each row: links join vectors of one label with cosine >= threshold.

    Equal vectors of a label are compared once and counted by their number. Null labels and vectors that
    are null, empty, zero, of another length, or hold nulls or non-finite components link with nothing. The index is fitted on
    a sample of at most `sample` vectors and holds all; its probes reach every vector within the threshold,
    so no link is missed. A null key counts as the largest. An empty table gives no rows.
    """
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    good = usable(F.col("v")) & F.col("l").isNotNull() & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("h", F.xxhash64("v"))
    # each distinct vector of a label gets a number of its own, as keys may repeat or be null
    distinct = rows.where("good").groupBy("l", "h", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("d", F.size("v"))
    distinct = written(distinct.withColumn("s", F.monotonically_increasing_id()), "vectors")
    lengths = {r["d"]: r["c"] for r in distinct.groupBy("d").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "d").limit(LENGTHS).collect()}
    labels = max(1, distinct.select("l").distinct().count())
    books = {}
    for d, c in lengths.items():
        take = distinct.where(F.col("d") == d).orderBy("h", "l").limit(sample).select("v").toPandas()["v"]
        x = np.array([list(v) for v in take])
        x = unit(x / np.abs(x).max(axis=1, keepdims=True))
        books[d] = Quantiser(x, max(1, min(len(x) // FOR_LIST, int(math.sqrt(c / labels) / 2))), threshold)

    def stacked(column) -> np.ndarray:
        # by the largest component first, so that no square overflows or vanishes
        x = np.array(column.to_pylist())
        return unit(x / np.abs(x).max(axis=1, keepdims=True))

    def place(batches):
        for b in batches:
            ds = b.column("d").to_numpy()
            for d in np.unique(ds):
                part = b.filter(pa.array(ds == d))
                if d in books:
                    x = stacked(part.column("v"))
                    own, codes, error, probe = books[d].place(x)
                    to = [np.flatnonzero(p) for p in probe]
                else:  # beyond the most frequent lengths: one list for each, without codes, all compared exactly
                    own, codes, error, to = np.zeros(part.num_rows, int), np.zeros((part.num_rows, 0), np.uint8), np.full(part.num_rows, 2.0), [[0]] * part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("l", "d", "s", "n", "v")] + [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64()), pa.array([list(map(int, t)) for t in to], pa.list_(pa.int32()))],
                    names=["l", "d", "s", "n", "v", "cell", "codes", "error", "to"],
                )

    placed = distinct.select("l", "d", "s", "n", "v").mapInArrow(place, "l string, d int, s bigint, n bigint, v array<double>, cell int, codes binary, error double, to array<int>")
    placed = written(placed, "vectors-placed")
    series = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    cell = ["l", "d", "cell"]
    asks = placed.select("l", "d", "s", F.explode("to").alias("cell"))
    size = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    asked = asks.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / probes).alias("turns"))
    size = written(matched(size, asked, cell), "vectors-sizes")
    left = matched(placed.select("l", "d", "s", "v", F.explode("to").alias("cell")), size, cell)
    left = left.select(*[F.col(c).alias(c) for c in cell], F.col("s").alias("s"), F.col("v").alias("v"), F.pmod(F.xxhash64("s"), F.col("turns")).alias("turn"), series("blocks").alias("block"))
    right = matched(placed.select(*cell, "s", "n", "v", "codes", "error"), size, cell)
    right = right.select(*cell, "s", "n", "v", "codes", "error", series("turns").alias("turn"), F.pmod(F.xxhash64("s"), F.col("blocks")).alias("block"))

    def tile(asking: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[int, int] = {}
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = p = parent.setdefault(p, p)
                x = p
            return x

        if asking.num_rows and held.num_rows:
            d, at = held.column("d")[0].as_py(), held.column("cell")[0].as_py()
            x, y = stacked(asking.column("v")), stacked(held.column("v"))
            xs, ys, n = (t.column(c).to_numpy() for t, c in ((asking, "s"), (held, "s"), (held, "n")))
            if d in books:
                codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
                error = held.column("error").to_numpy()
            for a in range(0, len(x), 256):
                part = x[a : a + 256]
                may = books[d].estimate(part, at, codes) + error >= threshold - 1e-6 if d in books else np.ones((len(part), len(y)), bool)
                i, j = np.nonzero(may)
                fit = (np.einsum("ij,ij->i", part[i], y[j]) >= threshold) & (xs[a + i] != ys[j])
                for p, q, c in zip(xs[a + i[fit]].tolist(), ys[j[fit]].tolist(), n[j[fit]].tolist(), strict=True):
                    out[p] = out.get(p, 0) + c
                    p, q = root(p), root(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        names = list(parent)
        return pa.table({"a": pa.array(names, pa.int64()), "b": pa.array([root(x) for x in names], pa.int64()), "n": pa.array([out.get(x, 0) for x in names], pa.int64())})

    keys = [*cell, "turn", "block"]
    found = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "a bigint, b bigint, n bigint"), "vectors-links")
    comp = components(found.select("a", "b")).select(F.col("node").alias("s"), F.col("component").alias("c"))
    links = written(found.groupBy(F.col("a").alias("s")).agg(F.sum("n").alias("links")), "vectors-counts")
    done(placed, size, found)
    # only here the smallest key names a component
    narrow = written(distinct.select("s", "id").join(comp, "s"), "vectors-named")
    least = narrow.groupBy("c").agg(F.min("id").alias("component"))
    comp = narrow.select("s", "c").join(least, "c").drop("c")
    per = distinct.select("l", "h", "v", "id", "n", "s").join(links, "s", "left").join(comp, "s", "left")
    per = per.select("l", "h", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    per = per.select(*[F.col(c).alias(f"p_{c}") for c in per.columns])
    out = rows.join(per, rows["good"] & (F.col("l") == F.col("p_l")) & (F.col("h") == F.col("p_h")) & (F.col("v") == F.col("p_v")), "left")
    null = lambda c: F.when(c < LAST, c)
    component = F.coalesce("p_component", "id")
    return out.select(null(F.col("id")).alias(key), F.coalesce("p_links", F.lit(0)).cast("long").alias("n_links"), null(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
