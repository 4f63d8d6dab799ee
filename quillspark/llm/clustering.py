"""Operator 12, centroid clustering: k-means over integer vectors by partial-distance search.

A vector meets the centroids in the order of their distance over the dimensions of highest variance. Squared
differences are added up in runs of dimensions, a centroid is given up once its sum is strictly above the best
so far, and what is left finishes all dimensions. Sums are exact integers at any size, so neither the order of rows nor
the number of tasks changes a result. Each round sends a row for every task and cluster to the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .topk import usable

#: Dimensions of a vector, clusters, rounds, integer steps of a unit.
DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Dimensions that are added up between two looks at the best.
RUN = 8
#: Components from here on are added up as Python's integers, as squares of their differences could pass a long.
WIDE = 1 << 27
#: Bits of a limb, in which sums pass from tasks to Spark; 2**23 tasks fit in a long.
LIMB = 40


def integers(column, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as doubles, which hold them exactly, and which rows have wide ones."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) * scale)
    return x, (np.abs(x) >= WIDE).any(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of each row of integers, the smaller of equally near ones, its squared distance, and how many differences were taken."""
    x, c = x[:, order], centroids[:, order]
    n, d = x.shape
    y = x[:, None, :run] - c[None, :, :run]
    first, work = (y * y).sum(axis=2), y.size
    turns = np.argsort(first, axis=1, kind="stable")
    near, best = turns[:, 0].copy(), np.zeros(n, x.dtype)
    for turn in range(len(c)):
        to = turns[:, turn]
        part = first[np.arange(n), to]
        live = np.flatnonzero(part <= best) if turn else np.arange(n)
        part = part[live]
        for a in range(run, d, run):
            if not len(live):
                break
            y = x[live, a : a + run] - c[to[live], a : a + run]
            part, work = part + (y * y).sum(axis=1), work + y.size
            if turn:
                keep = part <= best[live]
                live, part = live[keep], part[keep]
        if turn:
            won = (part < best[live]) | (to[live] < near[live])
            live, part = live[won], part[won]
        near[live], best[live] = to[live], part
    return near, best, work


def assigned(x: np.ndarray, wide: np.ndarray, centroids: list[list[int]], order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their integers, clusters, distances), first of the rows that fit in longs, then of the others."""
    far = any(abs(v) >= WIDE for c in centroids for v in c)
    for rows, kind in ((np.flatnonzero(~wide & (not far)), np.int64), (np.flatnonzero(wide | far), object)):
        if len(rows):
            part = x[rows].astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in r] for r in x[rows]], object)
            near, best, _ = nearest(part, np.array(centroids, kind), order)
            yield rows, part, near, best


def limbs(sums: list[int]) -> list[list[int]]:
    """Numbers as lists of signed digits of LIMB bits, from the lowest on."""
    out = []
    while any(sums):
        out.append([s % (1 << LIMB) if abs(s) >= 1 << LIMB else s for s in sums])
        sums = [s >> LIMB if abs(s) >= 1 << LIMB else 0 for s in sums]
    return out or [sums]


def spread_order(rows: DataFrame, d: int, scale: int) -> np.ndarray:
    """The dimensions by falling variance; rough sums will do, as the order decides speed alone."""

    def part(batches):
        n, total, squares = 0, np.zeros(d), np.zeros(d)
        for b in batches:
            if b.num_rows:
                x = np.clip(integers(b.column("v"), scale)[0], -1e100, 1e100)
                n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.record_batch({"n": pa.array([n], pa.int64()), "t": pa.array([total.tolist()]), "q": pa.array([squares.tolist()])})

    found = rows.select("v").mapInArrow(part, "n bigint, t array<double>, q array<double>")
    found = found.agg(F.sum("n").alias("n"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "tq" for i in range(d)]).first()
    n = found["n"] or 1
    return np.argsort([-(found[f"q{i}"] or 0) / n + ((found[f"t{i}"] or 0) / n) ** 2 for i in range(d)], kind="stable")


def updated(rows: DataFrame, centroids: list[list[int]], order: np.ndarray, scale: int) -> list[list[int]]:
    """The centroids after one round: each non-empty cluster's floor(sum / count), by component."""
    k, d = len(centroids), len(centroids[0])

    def part(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        large: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for _, x, near, _ in assigned(*integers(b.column("v"), scale), centroids, order):
                    count += np.bincount(near, minlength=k)
                    if x.dtype == np.int64:
                        np.add.at(sums, near, x)
                    else:
                        for c, v in zip(near.tolist(), x, strict=True):
                            large[c] = large.get(c, 0) + v
        out = []
        for c in np.flatnonzero(count).tolist():
            digits = limbs([int(v) + (int(large[c][i]) if c in large else 0) for i, v in enumerate(sums[c])])
            out += [(c, i, int(count[c]) if i == 0 else 0, s) for i, s in enumerate(digits)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["c", "i", "n", "s"])

    found = rows.select("v").mapInArrow(part, "c int, i int, n bigint, s array<bigint>").groupBy("c", "i")
    found = found.agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(d)]).collect()
    n, sums = {}, {}
    for r in found:
        n[r["c"]] = n.get(r["c"], 0) + r["n"]
        sums[r["c"]] = [was + (r[f"s{j}"] << LIMB * r["i"]) for j, was in enumerate(sums.get(r["c"], [0] * d))]
    return [[s // n[c] for s in sums[c]] if c in n else was for c, was in enumerate(centroids)]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", d: int = DIMENSIONS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """A table (key, cluster, distance) of the vectors that take part, and the last centroids.

    Vectors with exactly d components, none null or non-finite, take part, each as the integers floor(scale * x).
    The first centroids are the k vectors of the smallest sha256 of `seed:key`, or all if there are fewer; those of one
    key go by their components, and null keys come after all others. Repeated rows are vectors of their own. Of equally
    near centroids a vector takes the first; an empty cluster keeps its centroid. A squared distance beyond a long
    is null. No vectors give no rows and no centroids. The k centroids go through the driver; the vectors are read
    again in each round, so a costly plan is best written before. 2**1017 and more, which a double can't hold
    times the scale, are non-finite too.
    """
    v = F.col(vector)
    small = ~F.exists(v, lambda x: F.abs(x.cast("double") * scale) == float("inf"))
    rows = vectors.where(v.isNotNull() & (F.size(v) == d)).where(usable(v)).where(small).select(F.col(key).cast("long").alias("key"), v.alias("v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.orderBy(name.asc_nulls_last(), F.col("v")).limit(k).select(F.col("v").cast("array<double>").alias("v")).collect()
    centroids = [[int(c) for c in np.floor(np.array(r["v"]) * scale)] for r in first]
    if centroids:
        order = spread_order(rows, d, scale)
        for _ in range(rounds):
            centroids = updated(rows, centroids, order, scale)

    def part(batches):
        for b in batches:
            near, best = np.zeros(b.num_rows, np.int32), [0] * b.num_rows
            if b.num_rows:
                for at, _, c, distance in assigned(*integers(b.column("v"), scale), centroids, order):
                    near[at] = c
                    for i, x in zip(at.tolist(), distance.tolist(), strict=True):
                        best[i] = x if x < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(near, pa.int32()), pa.array(best, pa.int64())], names=[key, "cluster", "distance"])

    kind = f"`{key}` bigint, cluster int, distance bigint"
    out = rows.mapInArrow(part, kind) if centroids else vectors.sparkSession.createDataFrame([], kind)
    return written(out, "clusters"), centroids


def op12(spark, sf_dir: str) -> DataFrame:
    """An inertia with a distance beyond a long in it, or beyond one itself, is null."""
    rows, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in rows.groupBy("cluster").agg(total.alias("total")).collect()}  # a row for each of k clusters
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    one = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    inertia = fits(sum(sums.values())) if None not in sums.values() else None
    return rows.select(
        "vec_id", "cluster", "distance", one([fits(sums.get(c)) for c in range(len(names))], "bigint").alias("cluster_inertia"),
        F.lit(inertia).cast("long").alias("inertia"), one(names, "string").alias("centroid_sha256"),
    )
