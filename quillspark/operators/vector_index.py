"""A vector store with an inverted-list index in files: exact nearest neighbours by bounds of cells, appends and deletions.

About sqrt(n) of the vectors are centroids. A vector goes to the cell of its nearest centroid and there to the ring of its
angle to it. By the triangle inequality of angles no vector of a ring is nearer to a query than the angle between
query and centroid less that of the ring's far edge (or that of its near edge less the former). So a query looks into
its nearest cells first, and then only into the rings that can beat what it has found. What it meets there is compared exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshots import VERSION, Snapshots
from ..sources.tables import written
from .retrieval import PLACES, SLACK, candidates

#: Radians of a ring, cells that a query looks into first, rows of either side that meet in a task.
RING, FIRST, BLOCK = 0.05, 4, 2048
#: Rows of a part, which queries that look into many rings meet as a whole.
PART = 1 << 14
#: How far an angle may be off by rounding.
EDGE = 1e-6


def dealt(left: DataFrame, right: DataFrame, by: list[str], keys: tuple[str, str], block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in blocks of their `by`, each block of one for each block of the other, and the columns to meet by."""
    sizes = left.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("__ls")).join(right.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).alias("__rs")), by)
    series = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = left.join(sizes, by).select(*left.columns, F.pmod(F.xxhash64(keys[0]), F.col("__ls")).alias("__x"), series("__rs").alias("__y"))
    right = right.join(sizes, by).select(*right.columns, F.pmod(F.xxhash64(keys[1]), F.col("__rs")).alias("__y"), series("__ls").alias("__x"))
    fresh = lambda t: t.select(*[F.col(c).alias(c) for c in t.columns])
    return fresh(left), fresh(right), [*by, "__x", "__y"]


def units(table: pa.Table, c: str) -> np.ndarray:
    """The vectors of a column, all of one length, as rows of length 1; zero ones stay."""
    x = table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


class VectorIndex:
    """The index in a folder: Snapshots of kinds rows (id, source, v, cell, ring), stats (cell, ring, d, n, near, far), centroids and gone (id).

    Cells are numbered over all lengths d of vectors. What no centroid is near to (zero vectors, lengths that came later)
    is in cell -d, which every query of that length looks into. Vectors that are null, empty or hold nulls aren't kept. Ids
    that come again in a later append stand beside the earlier ones unless these are deleted before.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Snapshots(spark, path)

    @staticmethod
    def create(rows: DataFrame, path: str, cells: int | None = None, **kw) -> VectorIndex:
        """An index of rows (id, source, v) at a path. cells: for each length of vectors about how many, the square root of their number if not given."""
        index = VectorIndex(rows.sparkSession, path)
        rows = index._kept(rows)
        some = rows.where(F.exists("v", lambda x: x != 0))
        n = F.count(F.lit(1))
        share = some.groupBy("d").agg(((F.sqrt(n) if cells is None else F.lit(cells)) / n).alias("share"))
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 11) * F.lit(2.0**-53)  # the ids alone decide
        centroids = some.join(share, "d").where(chance < F.col("share")).select("v", "d", F.monotonically_increasing_id().alias("cell"))
        centroids = written(centroids, "centroids")
        index._append(rows, {"centroids": centroids}, **kw)
        return index

    @staticmethod
    def _kept(rows: DataFrame) -> DataFrame:
        good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
        return rows.where(F.coalesce(good, F.lit(False))).select("id", F.col("source").cast("string").alias("source"), F.col("v").cast("array<double>").alias("v"), F.size("v").alias("d"))

    def _append(self, rows: DataFrame, more: dict[str, DataFrame], **kw) -> int:
        """Rows go to cells and rings, as a part that is sorted by them, with statistics of its own."""
        centroids = more["centroids"] if more else self.log.read("centroids").drop(VERSION)
        asked = written(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
        schema = "key bigint, cell bigint, angle double"

        def near(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"key": pa.array([], pa.int64()), "cell": pa.array([], pa.int64()), "angle": pa.array([], pa.float64())})
            x, c = units(a, "v"), units(b, "v")
            to = [np.argmin(w, axis=1) for w in (angles(x[i : i + 512], c) for i in range(0, len(x), 512))]
            to = np.concatenate(to)
            angle = np.arccos(np.clip((x * c[to]).sum(1), -1.0, 1.0))
            cell = b.column("cell").to_numpy()[to]
            some = (x != 0).any(axis=1)
            return pa.table({"key": a.column("key").to_numpy()[some], "cell": cell[some], "angle": angle[some]})

        left, right, tile = dealt(asked.select("key", "v", "d"), centroids, ["d"], ("key", "cell"))
        best = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(near, schema).groupBy("key").agg(F.min(F.struct("angle", "cell")).alias("m"))
        placed = asked.join(best, "key", "left").withColumn("cell", F.coalesce("m.cell", -F.col("d")).cast("long")).withColumn("angle", F.col("m.angle")).withColumn("ring", F.coalesce(F.floor(F.col("angle") / RING), F.lit(-1)).cast("int"))
        placed = written(placed.select("id", "source", "v", "d", "cell", "ring", "angle"), "vectors-placed")
        stats = placed.groupBy("d", "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
        sorted_rows = placed.drop("d", "angle").repartitionByRange("cell", "ring", "id").sortWithinPartitions("cell", "ring")
        return self.log.add({"rows": sorted_rows, "stats": stats} | more, **kw)

    def append(self, rows: DataFrame, **kw) -> int:
        """Adds rows (id, source, v); kw: writer and epoch of a stream's batch."""
        if not self.log.parts("centroids"):
            raise ValueError("an index is created before it is appended to")
        return self._append(self._kept(rows), {}, **kw)

    def delete(self, gone: DataFrame, **kw) -> int:
        """Leaves out the rows with the ids of gone (id) from now on, as a table beside them."""
        return self.log.add({"gone": gone.select("id").distinct()}, **kw)

    def delete_source(self, source: str) -> int:
        return self.delete(self.rows().where(F.col("source") == source))

    def rows(self, version: int | None = None) -> DataFrame:
        """(id, source, v, cell, ring) of what is there."""
        rows, gone = self.log.read("rows", version), self.log.read("gone", version)
        if gone is None:
            return rows.drop(VERSION)
        last = gone.groupBy("id").agg(F.max(VERSION).alias("__gone"))
        return rows.join(last, "id", "left").where(F.col("__gone").isNull() | (F.col(VERSION) > F.col("__gone"))).select("id", "source", "v", "cell", "ring")

    def compact(self) -> int:
        """Parts and deletions become one part, with bounds that are tight again; cells stay as they are."""
        version = self.log.manifest()["version"]
        rows = self.rows(version).join(self.log.read("centroids", version).select("cell", F.col("v").alias("c")), "cell", "left")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        norm = lambda a: F.sqrt(dot(F.col(a), F.col(a)))
        angle = F.when(F.col("c").isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("c")) / norm("v") / norm("c")))))
        rows = written(rows.select("id", "source", "v", "cell", "ring", angle.alias("angle")), "vectors-compact")
        stats = rows.groupBy(F.size("v").alias("d"), "cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
        tables = {"rows": rows.drop("angle").repartitionByRange("cell", "ring", "id").sortWithinPartitions("cell", "ring"), "stats": stats, "centroids": self.log.read("centroids", version).drop(VERSION)}
        return self.log.replace(tables, version)

    def probes(self, asked: DataFrame, version: int | None = None) -> DataFrame:
        """(query_id, cell, ring) of what queries (query_id, q, d, least) must look into: rings that may hold a cosine of `least` or more."""
        stats = self.log.read("stats", version).groupBy("d", "cell", "ring").agg(F.min("near").alias("near"), F.max("far").alias("far"))
        rings = stats.groupBy("d", "cell").agg(F.collect_list(F.struct("ring", F.coalesce("near", F.lit(0.0)).alias("near"), F.coalesce("far", F.lit(np.pi)).alias("far"))).alias("rings"))
        cells = rings.where("cell >= 0").join(self.log.read("centroids", version).select("cell", "v"), "cell").select("d", "cell", "v", "rings")
        kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, cell bigint, ring int"

        def may(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": a.column("query_id").slice(0, 0), "cell": pa.array([], pa.int64()), "ring": pa.array([], pa.int32())})
            q, c, least = units(a, "q"), units(b, "v"), a.column("least").to_numpy()
            lists = b.column("rings").combine_chunks()
            owner = np.repeat(np.arange(len(c)), np.diff(lists.offsets.to_numpy()))
            ring, near, far = (lists.flatten().field(n).to_numpy() for n in ("ring", "near", "far"))
            cell, hits = b.column("cell").to_numpy()[owner], ([], [])
            for i in range(0, len(q), 256):
                w = angles(q[i : i + 256], c)[:, owner]
                best = np.cos(np.maximum(np.maximum(w - far, near - w) - EDGE, 0.0))
                best[~(q[i : i + 256] != 0).any(axis=1)] = 0.0  # a zero vector has the cosine 0 with everything
                x, y = np.nonzero(best >= least[i : i + 256, None] - 2 * SLACK)
                hits[0].append(x + i)
                hits[1].append(y)
            x, y = np.concatenate(hits[0]), np.concatenate(hits[1])
            return pa.table([a.column("query_id").take(pa.array(x)), pa.array(cell[y]), pa.array(ring[y])], names=["query_id", "cell", "ring"])

        left, right, tile = dealt(asked, cells, ["d"], ("query_id", "cell"))
        found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(may, kind)
        return found.union(asked.join(rings.where("cell < 0"), "d").select("query_id", "cell", F.lit(-1)))

    def _scores(self, probes: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        rows = rows.join(probes.select("cell", "ring").distinct(), ["cell", "ring"], "left_semi")
        return candidates(probes.join(asked.select("query_id", "q"), "query_id"), rows.select("cell", "ring", "id", "v"), ["cell", "ring"], k).select("query_id", "id", "score")

    def _all_scores(self, probes: DataFrame, asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """As _scores(), but cells go together in parts of about PART rows, to each of which a query goes once, not once to every ring; a part is compared as a whole."""
        n = rows.count()
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(-(-n // PART) or 1)).alias("part")
        there = written(probes.select("query_id", part("cell")).distinct(), "probes")
        return candidates(there.join(asked.select("query_id", "q"), "query_id"), rows.select(part("cell"), "id", "v"), ["part"], k).select("query_id", "id", "score")

    def search(self, queries: DataFrame, k: int, version: int | None = None, first: int = FIRST) -> DataFrame:
        """(query_id, rank, id, score) of queries (query_id, q): the k highest cosines, by six decimals, ties to the smaller id.

        Nothing is missed. A query isn't compared with a row of its own id. A null query, or one of a length that nothing
        has, finds nothing.
        """
        version = self.log.manifest()["version"] if version is None else version
        good = F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull())
        asked = written(queries.where(good).select("query_id", F.col("q").cast("array<double>").alias("q"), F.size("q").alias("d")), "asked")
        rows, stats = self.rows(version), self.log.read("stats", version).select("cell", "ring").distinct()
        near = candidates(asked.select("d", F.struct("query_id").alias("query_id"), "q"), self.log.read("centroids", version).select("d", F.col("cell").alias("id"), "v"), ["d"], first)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        near = near.select("query_id.query_id", "id", "score").withColumn("i", place).where(F.col("i") <= first).select("query_id", F.col("id").alias("cell"))
        begun = written(near.join(stats, "cell").select("query_id", "cell", "ring"), "probes")
        got = written(self._scores(begun, asked, rows, k), "found")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        least = got.withColumn("i", place).where(F.col("i") == k).select("query_id", F.col("score").alias("least"))
        more = self.probes(asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), version)
        # what was found first is in these rings too, and is found again with the rest
        found = self._all_scores(more, asked, rows, k).withColumn("score", F.round("score", PLACES))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
