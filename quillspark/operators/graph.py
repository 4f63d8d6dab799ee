"""Citation networks as edge tables: loading, degrees, expansion, ranks, link prediction, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.text import normalize_doi
from ..sources.tables import delete, shared_dir, written
from .features import running


def load_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (doi, title, ord) and edges (source_doi, target_doi) as (nodes, edges, counts).

    Of nodes with one DOI the first by ord stays. Edges stay if both ends are nodes, without loops and
    repeats; counts says how many rows were read, kept and left out, targets outside the graph by row.
    """
    first = F.row_number().over(Window.partitionBy("doi").orderBy("ord"))
    kept = nodes.where(F.col("doi").isNotNull()).withColumn("__r", first).where("__r = 1").drop("__r")
    ids = kept.select("doi")
    # nodes are small in files, but not where a broadcast would gather them at the driver
    known = edges.join(ids.withColumnRenamed("doi", "source_doi").hint("merge"), "source_doi", "left_semi")
    known = known.join(ids.select(F.col("doi").alias("target_doi"), F.lit(True).alias("__in")).hint("merge"), "target_doi", "left")
    graph = known.where("__in and source_doi <> target_doi").select("source_doi", "target_doi").distinct()
    counts = known.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__in").isNull()).alias("outside"), F.count_if(F.col("source_doi") == F.col("target_doi")).alias("loops")
    )
    return kept, graph, counts


def local_papers(registry: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """(doi, file_id, title) of registry rows (file_id, doi, file_name) that have a record (file_id, title): the first by order of each DOI.

    A record without a title leaves the file's name.
    """
    rows = registry.select("file_id", normalize_doi(F.col("doi")).alias("doi"), "file_name", *[c for c in order if c != "file_id"]).where("doi is not null")
    rows = rows.join(known.select("file_id", "title"), "file_id")
    first = F.row_number().over(Window.partitionBy("doi").orderBy(*order))
    return rows.withColumn("__r", first).where("__r = 1").select("doi", "file_id", F.coalesce(F.nullif("title", F.lit("")), "file_name", F.lit("")).alias("title"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doi, in_degree, out_degree) of every node: one aggregation over both directions."""
    both = edges.select(F.col("source_doi").alias("doi"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("target_doi", F.lit(0), F.lit(1)))
    sums = both.groupBy("doi").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("doi").join(sums, "doi", "left").select("doi", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def bfs(seeds: DataFrame, edges: DataFrame, backward: int, forward: int, most: int | None = None) -> DataFrame:
    """(doi, depth) by hops from seeds (doi): along references up to `backward`, along citations up to `forward`.

    Level by level: the frontier meets the edges, and what was reached before is left out. With `most`, no more nodes
    are admitted, those of a level in the order of their DOI.
    """
    seen = written(seeds.select("doi").where("doi is not null").distinct().withColumn("depth", F.lit(0)), "bfs")
    count = seen.count()
    for depth in range(max(backward, forward)):
        front = seen.where(F.col("depth") == depth).select("doi")
        steps = []
        if depth < backward:
            steps.append(edges.join(front, edges.source_doi == front.doi, "left_semi").select(F.col("target_doi").alias("doi")))
        if depth < forward:
            steps.append(edges.join(front, edges.target_doi == front.doi, "left_semi").select(F.col("source_doi").alias("doi")))
        new = steps[0] if len(steps) == 1 else steps[0].union(steps[1])
        new = new.distinct().join(seen.select("doi"), "doi", "left_anti")
        if most is not None:
            new = new.orderBy("doi").limit(max(0, most - count))
        new = written(new.select("doi", F.lit(depth + 1).alias("depth")), "bfs")
        got = new.count()
        if not got:
            break
        count += got
        seen = seen.union(new)
    return seen


def fetch_first(by_source: DataFrame, keys: list[str], rank: str = "priority") -> DataFrame:
    """Rows of the first source, by rank, that has any for a key."""
    w = Window.partitionBy(*keys)
    return by_source.withColumn("__m", F.min(rank).over(w)).where(F.col(rank) == F.col("__m")).drop("__m")


class Bucketed:
    """A table in buckets by columns, sorted in them, which joins by those columns don't shuffle; gone when it is closed."""

    def __init__(self, df: DataFrame, by: str | list[str], buckets: int | None = None):
        by = [by] if isinstance(by, str) else by
        self.spark, self.name = df.sparkSession, f"quill_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 10, tolerance: float | None = None, buckets: int | None = None) -> DataFrame:
    """(doi, pagerank): uniform teleport and dangling mass, a fixed number of rounds or until the L1 change is small.

    Links with their out-degrees are a table in buckets of the citing paper, made once; what a round shuffles is
    the ranks that meet them and the sums that leave them, never the links. `buckets` are as many as the session's
    shuffle partitions if not given. Every round is a table, so lineage stays short, a lost executor
    costs one round, and the mass of dangling nodes is summed up while the round is written. Dense numbers are ranked in blocks.
    """
    n = nodes.count()
    if not n:
        return nodes.select("doi", F.lit(None).cast("double").alias("pagerank"))
    if all(isinstance(f.dataType, IntegralType) for rows in (nodes.select("doi"), edges.select("source_doi", "target_doi")) for f in rows.schema.fields):
        first, last = nodes.agg(F.min("doi"), F.max("doi")).first()
        if last - first < SPARSE * n:
            return _pagerank_in_blocks(nodes, edges, n, damping, rounds, tolerance, buckets)
    out = edges.groupBy("source_doi").agg(F.count(F.lit(1)).alias("deg"))
    links = Bucketed(edges.select("source_doi", "target_doi").join(out, "source_doi"), "source_doi", buckets)
    dangling = nodes.select("doi").join(out, F.col("doi") == F.col("source_doi"), "left_anti").withColumn("dangling", F.lit(True))
    base = written(nodes.select("doi").join(dangling, "doi", "left"), "pagerank-nodes")
    ranks, whole = base.withColumn("rank", F.lit(1.0 / n)), 1.0
    lost = base.agg(F.count_if("dangling").alias("c")).first()["c"] / n
    for _ in range(rounds):
        new, seen = _round(base, links.rows, ranks, n, damping, lost)
        new = written(new, "pagerank")
        lost, whole = seen.get["lost"], seen.get["whole"]
        if tolerance is not None:
            change = new.join(ranks.select("doi", F.col("rank").alias("was")), "doi").agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("c")).first()["c"]
            if change < tolerance:
                ranks = new
                break
        ranks = new
    links.close()
    return ranks.select("doi", (F.col("rank") / whole).alias("pagerank"))


def _round(base: DataFrame, links: DataFrame, ranks: DataFrame, n: int, damping: float, lost: float) -> tuple[DataFrame, Observation]:
    """The next ranks, and what is summed up while they are written."""
    given = links.join(ranks.select(F.col("doi").alias("source_doi"), "rank"), "source_doi").groupBy(F.col("target_doi").alias("doi")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
    new = base.join(given, "doi", "left").withColumn("rank", (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).drop("got")
    seen = Observation()
    return new.observe(seen, F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"), F.sum("rank").alias("whole")), seen


#: Bits of a number within a block of ranks, links of a block that meet its ranks in one task, and numbers for each node up to which they are dense.
BITS, LINKED, SPARSE = 16, 1 << 20, 8


def _pagerank_in_blocks(nodes: DataFrame, edges: DataFrame, n: int, damping: float, rounds: int, tolerance: float | None, buckets: int | None) -> DataFrame:
    """pagerank() of numbered nodes. Links are dealt to blocks of the citing paper's number, those of crowded blocks by the cited one's hash too.

    A task sums up all that its links give a paper, and the sums for a block of papers leave it as one row: many fewer and narrower than a row for each link.
    """
    block, place = lambda c: F.shiftright(F.col(c).cast("long"), BITS), lambda c: F.col(c).cast("long").bitwiseAND((1 << BITS) - 1).cast("int")
    crowd = written(edges.groupBy(block("source_doi").alias("b")).agg(F.ceil(F.count(F.lit(1)) / LINKED).cast("int").alias("k")), "pagerank-crowds")
    size = buckets or min(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * max(1, crowd.agg(F.sum("k")).first()[0] or 0))
    many = F.broadcast(crowd.where("k > 1"))
    links = edges.withColumn("b", block("source_doi")).join(many, "b", "left").select("b", F.pmod(F.xxhash64("target_doi"), F.coalesce("k", F.lit(1))).cast("int").alias("p"), place("source_doi").alias("s"), F.col("target_doi").cast("long").alias("t"))
    out = edges.groupBy(F.col("source_doi").alias("doi")).agg(F.count(F.lit(1)).alias("deg"))
    links, base = Bucketed(links, ["b", "p"], size), Bucketed(nodes.select("doi").join(out, "doi", "left").select(block("doi").alias("b"), place("doi").alias("s"), "deg"), "b", size)
    ranks, whole = base.rows.withColumn("rank", F.lit(1.0 / n)), 1.0
    lost = base.rows.agg(F.count_if(F.col("deg").isNull()).alias("c")).first()["c"] / n
    for _ in range(rounds):
        new, seen = _round_in_blocks(base.rows, links.rows, many, ranks, n, damping, lost)
        new = written(new, "pagerank")
        lost, whole = seen.get["lost"], seen.get["whole"]
        change = None
        if tolerance is not None:
            change = new.join(ranks.select("b", "s", F.col("rank").alias("was")), ["b", "s"]).agg(F.sum(F.abs(F.col("rank") - F.col("was"))).alias("c")).first()["c"]
        ranks = new
        if change is not None and change < tolerance:
            break
    if not rounds:
        ranks = written(ranks, "pagerank")
    links.close()
    base.close()
    return ranks.select((F.shiftleft("b", BITS) + F.col("s")).cast(nodes.schema["doi"].dataType).alias("doi"), (F.col("rank") / whole).alias("pagerank"))


def _round_in_blocks(base: DataFrame, links: DataFrame, many: DataFrame, ranks: DataFrame, n: int, damping: float, lost: float) -> tuple[DataFrame, Observation]:
    """The next ranks (b, s, deg, rank) of base (b, s, deg), of links (b, p, s, t), and what is summed up while they are written."""
    bits, wide, floor = BITS, 1 << BITS, (1 - damping) / n + damping * lost / n
    share = ranks.where("deg is not null").select("b", "s", (F.col("rank") / F.col("deg")).alias("share"))
    share = share.join(many, "b", "left").select("b", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)).alias("p"), "s", "share")

    def give(own: pa.Table, held: pa.Table) -> pa.Table:
        shares = np.zeros(wide)
        shares[held["s"].to_numpy()] = held["share"].to_numpy()
        ids, at = np.unique(own["t"].to_numpy(), return_inverse=True)
        got = np.bincount(at, shares[own["s"].to_numpy()], len(ids))
        to, first = np.unique(ids >> bits, return_index=True)
        ends = pa.array(np.append(first, len(ids)), pa.int32())
        return pa.table({"b": to, "at": pa.ListArray.from_arrays(ends, pa.array((ids & (wide - 1)).astype("uint16").view("int16"))), "got": pa.ListArray.from_arrays(ends, pa.array(got))})

    def take(own: pa.Table, given: pa.Table) -> pa.Table:
        flat = lambda c: given[c].combine_chunks().flatten().to_numpy()
        got = np.bincount(flat("at").view("uint16"), flat("got"), wide)[own["s"].to_numpy()] if len(given) else np.zeros(len(own))
        return own.append_column("rank", pa.array(floor + damping * got))

    given = links.groupBy("b", "p").cogroup(share.groupBy("b", "p")).applyInArrow(give, "b long, at array<smallint>, got array<double>")
    new = base.groupBy("b").cogroup(given.groupBy("b")).applyInArrow(take, "b long, s int, deg long, rank double")
    seen = Observation()
    return new.observe(seen, F.coalesce(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"), F.sum("rank").alias("whole")), seen


#: Numbers of nodes in a block, those in a part of a node's neighbours, and ways over a common node from which on a block is dealt to several tasks.
BLOCK, ARMS, SHARE = 4096, 1 << 16, 1 << 25
#: Ways that are summed up at a time; nodes whose pairs are scored first, to find out what others must reach.
AT_ONCE, PROBED = 1 << 22, 512


def _scores(arms: DataFrame, top: int | None = None) -> DataFrame:
    """(i, j, score) of arms (z, n, w, d), n a neighbour of z, which has d of them: pairs i < j of neighbours of a common node that aren't neighbours themselves.

    Nodes are dealt to blocks of their numbers, crowded ones by their hash too. The list of a node's neighbours goes once to each block that
    has one of them, and pairs are summed up there: none is shuffled. So a hub's pairs are many tasks' work. With `top`, a task's best leave it.
    """
    block = F.floor(F.col("n") / BLOCK).alias("b")
    crowd = arms.groupBy(block).agg(F.ceil(F.sum("d") / SHARE).alias("k"))
    mine = arms.withColumn("b", block).join(crowd, "b").select("b", F.pmod(F.xxhash64("n"), F.col("k")).alias("p"), F.col("n").alias("i"), "z", "w")
    needed = mine.select("z", "b", "p").distinct().groupBy("z").agg(F.collect_list(F.struct("b", "p")).alias("at"))
    lists = arms.groupBy("z", F.floor(F.col("n") / ARMS).alias("q")).agg(F.collect_list("n").alias("js"))
    theirs = lists.join(needed, "z").select("z", "q", "js", F.explode("at").alias("at")).where((F.col("q") + 1) * ARMS > F.col("at.b") * BLOCK).select("at.b", "at.p", "z", "js")

    def score(own: pa.Table, held: pa.Table) -> pa.Table:
        i, z, w = (own[c].to_numpy() for c in ("i", "z", "w"))
        order = np.argsort(i, kind="stable")
        i, z, w = i[order], z[order], w[order]
        js, at = held["js"].combine_chunks(), np.argsort(held["z"].to_numpy(), kind="stable")
        js = js.take(pa.array(at))
        values, size = js.flatten().to_numpy(), np.diff(js.offsets.to_numpy())
        zs, first = np.unique(held["z"].to_numpy()[at], return_index=True)
        begin, many = (np.concatenate([[0], np.cumsum(size)])[first], np.add.reduceat(size, first)) if len(zs) else (first, first)
        place = np.minimum(np.searchsorted(zs, z), max(0, len(zs) - 1))
        here = zs[place] == z if len(zs) else np.zeros(len(z), bool)
        n = np.where(here, many[place], 0) if len(zs) else np.zeros(len(z), "int64")
        nodes, starts = np.unique(i, return_index=True)
        ends, out, k = np.append(starts[1:], len(i)), [], 0
        total = np.concatenate([[0], np.cumsum(n)])
        width = max(values.max(initial=0), z.max(initial=0)) + 1
        while k < len(nodes):
            last = max(k + 1, int(np.searchsorted(total[ends], total[starts[k]] + AT_ONCE, "right")))
            x = slice(starts[k], ends[last - 1])
            m, row = n[x], np.repeat(np.arange(x.start, x.stop), n[x])
            j = values[np.repeat(begin[place[x]] - (np.cumsum(m) - m), m) + np.arange(len(row))] if len(row) else row
            row, j = row[j > i[row]], j[j > i[row]]
            pair, which = np.unique((i[row] - nodes[k]) * width + j, return_inverse=True)
            said = np.bincount(which, w[row], len(pair))
            new = ~np.isin(pair, (i[x] - nodes[k]) * width + z[x])
            out.append((pair[new] // width + nodes[k], pair[new] % width, said[new]))
            if top is not None:
                both = [np.concatenate(c) for c in zip(*out, strict=True)]
                best = np.lexsort((both[1], both[0], -np.floor(both[2] * 1e8 + 0.5)))[:top]
                out = [tuple(c[best] for c in both)]
            k = last
        return pa.table([pa.array(np.concatenate(c) if out else [], t) for c, t in zip(zip(*out, strict=True) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["i", "j", "score"])

    mine, theirs = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (mine, theirs))
    return mine.groupBy("b", "p").cogroup(theirs.groupBy("b", "p")).applyInArrow(score, "i bigint, j bigint, score double")


def adamic_adar(edges: DataFrame, top: int | None = 15, name=None) -> DataFrame:
    """(i, j, score) of pairs without an edge, i < j: the sum of 1 / ln(degree) over common neighbours; best first.

    Nodes are said, and told apart in order, by `name`, a function of their column, if given. No pair scores more than either of its nodes with all its
    neighbours in common. So pairs of the PROBED nodes with the highest such bounds are scored first, and nodes whose bound is under the last of their best are left out.
    """
    both = edges.select(F.least("source_doi", "target_doi").alias("a"), F.greatest("source_doi", "target_doi").alias("b")).where("a <> b").distinct()
    # numbers in the order of the DOIs: what is grouped by the million is pairs of numbers
    nodes = both.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = nodes.select(F.struct((F.col("id") if name is None else name("id")).alias("doi"), "id").alias("s"), F.lit(1).alias("one"))
    nodes = written(running(nodes, "s", "one", "k").select("s.doi", "s.id", "k"), "adamic-nodes")
    number = lambda c, n: nodes.select(F.col("id").alias(c), F.col("k").cast("long").alias(n)).hint("merge")
    both = written(both.join(number("a", "i"), "a").join(number("b", "j"), "b").select("i", "j"), "adamic-edges")
    either = both.select("i", "j").union(both.select("j", "i"))
    degree = either.groupBy("i").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    arms = written(either.join(degree, "i").select(F.col("i").alias("z"), F.col("j").alias("n"), (1 / F.log("d")).alias("w"), "d"), "adamic-arms")
    order = [F.round("score", 8).desc(), "i", "j"]
    if top is not None:
        bound = written(arms.groupBy("n").agg(F.sum("w").alias("most")), "adamic-bounds")
        probed = bound.orderBy(F.desc("most"), "n").limit(PROBED).select("n")
        first = _scores(arms.join(probed, "n", "left_semi"), top).orderBy(*order).limit(top).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).first()
        if first["c"] == top:
            arms = arms.join(bound.where(F.col("most") >= first["s"] - 1e-6).select("n").hint("merge"), "n", "left_semi")
    found = _scores(arms, top)
    if top is not None:
        found = found.orderBy(*order).limit(top)
    said = lambda c, n: nodes.select(F.col("k").alias(f"__{c}"), F.col("doi").alias(n))
    found = found.join(said("i", "di"), F.col("i") == F.col("__i")).join(said("j", "dj"), F.col("j") == F.col("__j")).select(F.col("di").alias("i"), F.col("dj").alias("j"), "score")
    return found if top is None else found.orderBy(*order)


def reachable(edges: DataFrame, keys: list[str], rounds: int = 100) -> DataFrame:
    """Components of undirected edges (keys, a, b): (keys, node, component) by repeated minimum and short-cut.

    Rounds grow with the logarithm of the longest path; components that aren't whole after `rounds` are an error.
    All joins are merged: nodes and their components are small in files, but not where a broadcast would gather them.
    """
    either = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b"), F.col("a")))
    state = written(either.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "reach")
    either = written(either.distinct(), "reach-edges")
    for _ in range(rounds):
        near = either.join(state.select(*keys, F.col("node").alias("b"), "component").hint("merge"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("m"))
        new = state.join(near.hint("merge"), [*keys, "node"]).select(*keys, "node", F.least("component", "m").alias("component"), F.col("component").alias("was"))
        jump = new.select(*keys, F.col("node").alias("component"), F.col("component").alias("j"))
        seen = Observation()
        new = new.join(jump.hint("merge"), [*keys, "component"]).select(*keys, "node", F.col("j").alias("component"), (F.col("j") != F.col("was")).alias("moved"))
        state = written(new.observe(seen, F.count_if("moved").alias("moved")), "reach").drop("moved")
        if not seen.get["moved"]:
            return state
    raise RuntimeError(f"components: no end after {rounds} rounds")


def crawl_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of nodes (doi, depth, is_seed) and edges: one row for each depth, with totals and the seeds' mean in-degree."""
    inside = edges.join(nodes.select(F.col("doi").alias("source_doi")), "source_doi", "left_semi").join(nodes.select(F.col("doi").alias("target_doi"), "is_seed"), "target_doi")
    seeds = nodes.where("is_seed").count()
    sums = inside.agg(F.count(F.lit(1)).alias("total_edges"), F.round(F.try_divide(F.count_if("is_seed"), F.lit(seeds)), 3).alias("seed_in_degree"))
    per = nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))
    return per.join(F.broadcast(sums))
