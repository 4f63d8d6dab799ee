"""Operator 11, Merkle dataset manifest: levels built bottom-up, proofs pushed top-down.

Each group of rows (a source) is a tree over its leaves in the order of their keys, and the trees' last nodes,
the subroots, are the leaves of one tree above them all. Every level is a table, and a node's row there holds
the digests of its children. A proof goes the other way: each child joins its parent and puts its own siblings
before what the parent has inherited, so long proofs are held once for each run of leaves until the last join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import done, scratch, written

#: Children of a node at most.
FAN = 16
#: The low bits of monotonically_increasing_id, which number the rows of a partition.
LOW = 33
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """sha256 of the values' texts, each after its UTF-8 byte count and a colon, or - where it is null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def placed(rows: DataFrame, order: list[str], name: str, path: str | None = None) -> DataFrame:
    """rows, a written table with a text `tree`, with long `pos` (gapless from 0 in its tree, by `order`) and `n`, the rows of its tree.

    Rows are dealt by ranges of (tree, order), equal ones too, and numbered where they are; a table of ranges and trees
    shifts the numbers. No step sees a whole tree in one task.
    """
    keys = ["tree", *order, "__salt"]
    dealt = rows.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("__salt").withColumn("__id", F.monotonically_increasing_id()), f"{name}-ranges")
    dealt_by = dealt.withColumn("__range", F.shiftright("__id", LOW)).withColumn("__i", F.col("__id").bitwiseAND(F.lit((1 << LOW) - 1)))
    counts = dealt_by.groupBy("tree", "__range").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__c"))
    tree = Window.partitionBy("tree")
    before = F.sum("__c").over(tree.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "__range", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__c").over(tree).alias("n"))
    out = dealt_by.join(counts, ["tree", "__range"]).select(*rows.columns, (F.col("__i") + F.col("__shift")).alias("pos"), "n")
    out = written(out, name, path)
    done(dealt)
    return out


def levels_of(most: int, fan: int) -> int:
    """Levels of the tree with so many leaves, the leaves' one among them."""
    k = 1
    while most > 1:
        most, k = -(-most // fan), k + 1
    return k


def built(leaves: DataFrame, fan: int, name: str, path: str) -> list[DataFrame]:
    """The levels over leaves (tree, pos, n, digest): tables (tree, pos, n, digest, kids), the leaves first."""
    size = leaves.agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("pos") == 0, 1)).alias("trees")).first()
    levels = [leaves]
    for k in range(1, levels_of(size["most"] or 0, fan)):
        up = levels[-1].where("n > 1").groupBy("tree", F.floor(F.col("pos") / fan).alias("up"), F.ceil(F.col("n") / fan).alias("n"))
        up = up.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("kids"))
        up = up.select("tree", F.col("up").alias("pos"), "n", F.sha2(F.array_join("kids", ""), 256).alias("digest"), "kids")
        levels.append(written(up, name, f"{path}/{name}-{k}", rows=size["all"] // fan**k + size["trees"]))
    return levels


def pushed(levels: list[DataFrame], lone: DataFrame, fan: int) -> DataFrame:
    """The leaves with `steps`, the siblings on the way up, from the leaf's own: an array of what stands left and right of the node.

    lone has a row for each tree: its last node's steps, which are those above the tree, and columns that all
    leaves of the tree get.
    """
    more, parents = [c for c in lone.columns if c not in ("tree", "steps")], None
    for k in range(len(levels) - 1, -1, -1):
        own = [c for c in levels[k].columns if c != "tree"]
        out = levels[k].where("n = 1").join(lone, "tree").select("tree", *own, "steps", *more)
        if parents is not None:
            above = parents.select("tree", F.col("pos").alias("__up"), F.col("kids").alias("__all"), F.col("steps").alias("__above"), *more)
            kids = levels[k].where("n > 1").withColumn("__up", F.floor(F.col("pos") / fan)).join(above, ["tree", "__up"])
            i = F.pmod("pos", F.lit(fan)).cast("int")
            left, right = F.array_join(F.slice("__all", F.lit(1), i), ""), F.array_join(F.slice("__all", i + 2, F.lit(fan)), "")
            steps = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("__above"))
            out = out.unionByName(kids.select("tree", *own, steps.alias("steps"), *more))
        if k:
            was, parents = parents, written(out.select("tree", "pos", "kids", "steps", *more), "merkle-proofs")
            if was is not None:
                done(was)
    out.quill_parents = parents
    return out


def proof_digest(steps: Column) -> Column:
    """sha256 of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


@dataclass
class Manifest:
    """levels: of the groups' trees, leaves (tree, key, digest, pos, n and more columns) first; top: of the tree above them."""

    levels: list[DataFrame]
    top: list[DataFrame]
    key: str
    fan: int

    @property
    def root(self) -> str | None:
        """The digest of everything; None of an empty table."""
        found = self.top[-1].where("n = 1").first()
        return found and found["digest"]

    def proofs(self) -> DataFrame:
        """(tree, key, digest, more columns, subroot, root, steps) of each leaf."""
        last = self.top[-1].where("n = 1").select("tree", F.array().cast("array<struct<left string, right string>>").alias("steps"), F.col("digest").alias("root"))
        subroots = pushed(self.top, last, self.fan)
        lone = written(subroots.select(F.col("name").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"), "merkle-subroots")
        if subroots.quill_parents is not None:
            done(subroots.quill_parents)
        return pushed(self.levels, lone, self.fan).drop("pos", "n")


def manifest(docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "source", more: dict[str, Column] | None = None, fan: int = FAN, path: str | None = None) -> Manifest:
    """The manifest of docs, its levels as tables under `path`, or in the shared folder: opened() gives it to a later job.

    A leaf is leaf_digest of the fields. Leaves of a group stand in the order of the key, null first; those of one
    key by digest, and equal ones are leaves of their own, whichever comes first. A null group comes before all others,
    which are ordered by bytes. `more` columns stay with the leaves; other columns of docs don't matter. An empty
    table has no leaves and no root.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "merkle")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(key).alias(key), leaf_digest(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in (more or {}).items()])
    rows = written(rows, "merkle-rows")
    levels = built(placed(rows, [key, "digest"], "leaves", f"{path}/leaves"), fan, "level", path)
    done(rows)
    lone = levels[0].where("n = 1").select("tree", "digest")
    for level in levels[1:]:
        lone = lone.unionByName(level.where("n = 1").select("tree", "digest"))
    lone = written(lone.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-subroots")
    top = built(placed(lone, ["name"], "subroots", f"{path}/subroots"), fan, "top", path)
    done(lone)
    return Manifest(levels, top, key, fan)


def opened(spark: SparkSession, path: str, key: str = "doc_id", fan: int = FAN) -> Manifest:
    """The manifest that manifest() wrote under path, with its key and fan."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    leaves, subroots = read("leaves"), read("subroots")
    count = lambda t: levels_of(t.agg(F.max("n").alias("most")).first()["most"] or 0, fan)
    return Manifest([leaves, *[read(f"level-{k}") for k in range(1, count(leaves))]], [subroots, *[read(f"top-{k}") for k in range(1, count(subroots))]], key, fan)


def op11(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    claim = leaf_digest(*[F.col(f) for f in fields[:-1]], F.translate("text", UPPER, LOWER))
    out = manifest(docs, fields, more={"claim": F.when(hit, claim)}).proofs()
    out = out.withColumn("folded_root", folded(F.coalesce("claim", "digest"), F.col("steps")))
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
