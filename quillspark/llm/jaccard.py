"""Operator 8, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Chunks of documents send their distinct shingle hashes to buckets, which answer how frequent each is in
the corpus. By the prefix principle two sets can only link if their rarest shingles, a quarter of each, share
one; sets that share none are settled at once, which most documents are. The others fall into candidate
clusters, and these into tiles of sets of like size. In a tile bit counts of the sets' bitmaps bound an overlap from
above, and what may link is intersected exactly. Pairs that are linked already through others are passed over:
only components are asked for. So every set meets two pivots first, which settles groups of copies; what shares a
rare shingle with another component after that makes up the clusters that are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bounded_batches, components, done, fresh, matched, written
from .fingerprints import SECOND, WORD, U, Words, bits_for, bucket_edges, mix, pack, slices, unpack, window_hashes
from .substring import REPLY, _rows, _texts

SHINGLE, LEAST, OF = 5, 75, 100
CHUNK_BYTES, BUCKET_SHINGLES = 4 << 20, 1 << 20
#: Sets of a tile's side, and bits of a set's bitmap.
SIDE, BITS = 256, 2048
LAST = 2**63 - 1


class Sets:
    """The shingle sets of a chunk of texts: hashes sorted in each text, without repeats."""

    def __init__(self, texts: list[bytes], k: int):
        hashes, counts = [], []
        for group in slices(texts):
            w = Words(group, lower=True)
            h, n = window_hashes(w, k)
            firsts, ends = np.cumsum(n) - n, np.cumsum(n)
            for a, b in zip(firsts[n > 1], ends[n > 1], strict=True):
                h[a:b].sort()
            short = np.flatnonzero((w.counts > 0) & (n == 0))
            if len(short):  # fewer than k words: the whole sequence is the one shingle
                extra = []
                for i in short:
                    own = w.hashes[w.last[i] - w.counts[i] : w.last[i]]
                    extra.append(sum(int(x) * pow(int(WORD), j, 1 << 64) for j, x in enumerate(own)) + len(own) * int(SECOND) & (1 << 64) - 1)
                h = np.insert(h, firsts[short], mix(np.array(extra, np.uint64)))
                n = n.copy()
                n[short] = 1
            text = np.repeat(np.arange(len(n)), n)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            hashes.append(h[new])
            counts.append(np.bincount(text[new], minlength=len(n)))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.ends = np.cumsum(self.counts)
        self.firsts = self.ends - self.counts
        # 128 bits name a set
        some = self.counts > 0
        names = np.zeros((len(self.counts), 2), np.uint64)
        if some.any():
            at = self.firsts[some]
            names[some, 0] = mix(np.add.reduceat(mix(self.hashes ^ SECOND), at) + self.counts[some].astype(np.uint64))
            names[some, 1] = mix(np.add.reduceat(mix(self.hashes + WORD), at))
        self.names = [x.tobytes() if n else None for x, n in zip(names, self.counts, strict=True)]
        seen: dict[bytes, int] = {}
        self.first = [None if x is None else seen.setdefault(x, i) for i, x in enumerate(self.names)]
        self.distinct = np.array([i for i, f in enumerate(self.first) if f == i], np.int64)

    def run(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct upper bits of the distinct sets' hashes, sorted, and how often each stands in them (up to 255)."""
        keep = np.zeros(len(self.counts), bool)
        keep[self.distinct] = True
        h, n = np.unique(self.hashes[np.repeat(keep, self.counts)] >> U(shift), return_counts=True)
        return h, np.minimum(n, 255).astype(np.uint8)


def need(n, least: int = LEAST, of: int = OF):
    """Of a set of n, how many members a set that it links with has in common with it at least."""
    return -(-n * least // of)


def bitmap(a: np.ndarray) -> np.ndarray:
    """The parity of a set's members in each of BITS places."""
    odd = np.bincount((a % U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def links(left: list, right: list, least: int = LEAST, of: int = OF) -> list[tuple[int, int]]:
    """Links between sets (id, component, members) of two sides; only such as join different components.

    Of each set of the left the sets of the right are bounded at once: two sets differ in at least as
    many members as their bitmaps in bits. What may still link is intersected exactly.
    """
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = p = parent.setdefault(p, p)
            x = p
        return x

    out, n = [], len(right)
    if not left or not n:
        return out
    for s in (*left, *right):
        if (a := root(s[0])) != (b := root(s[1])):
            parent[max(a, b)] = min(a, b)
    sizes = np.array([len(s[2]) for s in right])
    maps = np.stack([bitmap(s[2]) for s in right])
    for name, _, members in left:
        both = len(members) + sizes
        differ = np.bitwise_count(maps ^ bitmap(members)).sum(axis=1, dtype=np.int64)
        most = np.minimum((both - differ) // 2, np.minimum(sizes, len(members)))
        for i in np.flatnonzero(of * most >= least * (both - most)):
            a, b = root(name), root(right[i][0])
            if a == b:
                continue
            common = len(np.intersect1d(members, right[i][2], assume_unique=True))
            if of * common >= least * (both[i] - common):
                parent[max(a, b)] = min(a, b)
                out.append((name, right[i][0]))
    return out


EDGES = "a bigint, b bigint"


def _edges(pairs) -> pa.Table:
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _sets(table: pa.Table) -> list:
    """(id, component, members) of each row (sid, comp, body)."""
    return [(s, c, np.frombuffer(b.as_py(), np.uint64)) for s, c, b in zip(table.column("sid").to_pylist(), table.column("comp").to_pylist(), table.column("body"), strict=True)]


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, least: int = LEAST, of: int = OF, chunk_bytes: int = CHUNK_BYTES, side: int = SIDE) -> DataFrame:
    """(key, n_shingles, component_id) of each document of docs.

    Words are lower-cased in A-Z; the set has the distinct k-word shingles, of a text of fewer words
    the whole sequence, and is empty without words or text. Two documents link if of * common >= least * union.
    component_id is the smallest key reachable by links. Shingles count as equal if their 64-bit
    hashes are. Empty sets link with nothing; a null key counts as the largest, and a component of
    null keys only has a null id. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__key"), F.col(text).alias("__text"))
    total = rows.agg(F.sum(F.octet_length("__text")).alias("t")).first()["t"] or 0
    chunks, bits = max(1, -(-total // chunk_bytes)), bits_for(total, BUCKET_SHINGLES)
    # Frequencies are kept of the upper bits of a hash, 64 values for each shingle of the corpus. Where two shingles
    # share them, both count as more frequent than they are: the order of shingles stays one and the same
    # for all sets, which is all that the prefix principle needs, and no shingle passes for unique that isn't.
    shift = max(0, 64 - (total // 6 + 1).bit_length() - 6)
    # by the text as well, so that the rows of one key, or without any, aren't one chunk
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64("__key", "__text"), F.lit(chunks)).cast("long"))

    def send(table: pa.Table) -> pa.Table:
        h, n = Sets(_texts(table, "__text"), k).run(shift)
        edges = bucket_edges(h << U(shift), bits)
        chunk = table.column("__chunk")[0].as_py()
        return _rows([(chunk, b, pack(h[x:y], n[x:y])) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x])

    def count(table: pa.Table) -> pa.Table:
        runs = [unpack(x.as_py(), np.uint8) for x in table.column("__data")]
        h, n = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        sums = np.add.reduceat(n[order], np.flatnonzero(new))
        # 0: in one set; else by the logarithm of its count, the same wherever the shingle stands
        codes = np.where(sums == 1, 0, np.clip(np.rint(8 * np.log2(sums)), 1, 255)).astype(np.uint8)
        back = np.empty(len(h), np.uint8)
        back[order] = codes[np.cumsum(new) - 1]
        bucket, out, at = table.column("__bucket")[0].as_py(), [], 0
        for chunk, (x, _) in zip(table.column("__chunk").to_pylist(), runs, strict=True):
            out.append((chunk, bucket, back[at : at + len(x)].tobytes()))
            at += len(x)
        return _rows(out)

    found = "kind int, doc bigint, own bigint, n bigint, name binary, prefix array<bigint>, body binary"
    kinds = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("name", pa.binary()), ("prefix", pa.list_(pa.int64())), ("body", pa.binary())])

    def settle(table: pa.Table, replies: pa.Table) -> pa.Table:
        keys = table.column("__key").to_pylist()
        sets = Sets(_texts(table, "__text"), k)
        h, _ = sets.run(shift)
        edges = bucket_edges(h << U(shift), bits)
        codes = np.zeros(len(h), np.uint8)
        for b, data in zip(replies.column("__bucket").to_pylist(), replies.column("__data"), strict=True):
            codes[edges[b] : edges[b + 1]] = np.frombuffer(data.as_py(), np.uint8)
        smallest: dict[int, int] = {}
        for i, f in enumerate(sets.first):
            if f is not None:
                smallest[f] = min(smallest.get(f, LAST), keys[i])
        out, alive = [], set()
        for i in sets.distinct:
            own = sets.hashes[sets.firsts[i] : sets.ends[i]]
            code = codes[np.searchsorted(h, own >> U(shift))]
            n, alone = len(own), int((code == 0).sum())
            if n - alone < need(n, least, of):
                continue  # too few of its shingles are in any other set
            order = np.lexsort((own, code))[alone : n - need(n, least, of) + 1]
            alive.add(int(i))
            out.append((1, None, smallest[int(i)], n, sets.names[i], own[order].view(np.int64).tolist(), own.tobytes()))
        for i, f in enumerate(sets.first):
            own = keys[i] if f is None else smallest[f]
            out.append((0, keys[i], own, int(sets.counts[i]), sets.names[i] if f in alive else None, None, None))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    replies = rows.groupBy("__chunk").applyInArrow(send, REPLY).groupBy("__bucket").applyInArrow(count, REPLY)
    both = written(rows.groupBy("__chunk").cogroup(replies.groupBy("__chunk")).applyInArrow(settle, found), "jaccard-sets")

    used = []

    def keep(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """written(df), to be deleted at the end."""
        used.append(written(df, name, rows=rows))
        return used[-1]

    # sets that chunks have in common become one; each gets a number of its own, as keys may repeat or be null
    sets = both.where("kind = 1").groupBy("name").agg(F.min("own").alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("body").alias("body"))
    seen = Observation()
    sets = written(sets.withColumn("sid", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("n")), "jaccard-distinct")
    n = seen.get["n"]
    posts = sets.select("sid", F.explode("prefix").alias("token"))
    least_of = posts.groupBy("token").agg(F.min("sid").alias("b"), F.max("sid").alias("c")).where("b < c").drop("c")
    stars = posts.join(least_of, "token").where("sid <> b").select(F.col("sid").alias("a"), "b")
    cluster = components(stars).select(F.col("node").alias("sid"), F.col("component").alias("cl"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(of / least)) - F.lit(1e-9)).cast("int")
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias("band")
    series = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def tiles(cluster: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Clusters (sid, cl) by size band, as sets of sizes that can link are in one band or in neighbours: (sid, cl, band, sub), the subs of each band, and the sets' bodies."""
        own = sets.select("sid", band.alias("band")).join(cluster, "sid")
        # a table of its own, so that the join with it can split the rows of a large cluster
        per = keep(own.groupBy("cl", "band").agg(F.ceil(F.count(F.lit(1)) / side).alias("subs")), "jaccard-bands", n)
        own = matched(own, per, ["cl", "band"]).withColumn("sub", F.pmod(F.xxhash64("sid"), F.col("subs"))).drop("subs")
        placed = keep(sets.select("sid", "body").join(own, "sid"), "jaccard-placed")
        return placed.select("sid", "cl", "band", "sub"), per, placed

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        return _edges(links(_sets(left), _sets(right), least, of))

    # first each set against two pivots of its band and of the two beside it: those of the least and the largest hash
    own, per, placed = tiles(cluster)
    hashed = F.struct(F.xxhash64("sid").alias("h"), "sid")
    ends = own.groupBy("cl", "band").agg(F.min(hashed)["sid"].alias("a"), F.max(hashed)["sid"].alias("b"))
    pivots = ends.select("cl", "band", F.explode(F.array_distinct(F.array("a", "b"))).alias("sid"))
    spread = pivots.select("sid", "cl", around("band")).join(per, ["cl", "band"]).select("sid", "cl", "band", series("subs").alias("sub"))
    spread = spread.join(placed.select("sid", "body"), "sid").withColumn("comp", F.col("sid"))
    keys = ["cl", "band", "sub"]
    first = spread.groupBy(*keys).cogroup(fresh(placed.withColumn("comp", F.col("sid"))).groupBy(*keys)).applyInArrow(tile, EDGES)
    edges = keep(first, "jaccard-links")

    # what may still link is what shares a rare shingle across components: of these smaller clusters are made anew
    comp = components(edges).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    state = keep(cluster.select("sid").join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid")), "jaccard-state", n)
    seen = posts.join(state, "sid")
    still = seen.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("sid").alias("b")).where("lo < hi").select("token", "b")
    stars = keep(seen.join(still, "token").where("sid <> b").select(F.col("sid").alias("a"), "b"), "jaccard-open")
    if stars.limit(1).count():
        done(placed)
        own, per, placed = tiles(components(stars).select(F.col("node").alias("sid"), F.col("component").alias("cl")))
        # whatever isn't in its cluster's largest component against all other components of the cluster
        state = keep(own.join(state, "sid"), "jaccard-state", n)
        main = state.groupBy("cl", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("cl").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
        main = keep(main, "jaccard-main", n)
        rest = keep(state.join(main, "cl").where("comp <> main").drop("main", "sub").withColumnRenamed("band", "rband"), "jaccard-rest", n)
        rper = keep(rest.groupBy("cl", "rband").agg(F.ceil(F.count(F.lit(1)) / side).alias("rsubs")), "jaccard-bands", n)
        rest = matched(rest, rper, ["cl", "rband"]).withColumn("rsub", F.pmod(F.xxhash64("sid"), F.col("rsubs"))).drop("rsubs")
        lefts = rest.select("sid", "cl", "comp", "rband", "rsub", around("rband")).join(per, ["cl", "band"]).select("sid", "cl", "comp", "rband", "rsub", "band", series("subs").alias("sub"))
        lefts = lefts.join(placed.select("sid", "body"), "sid")
        # by the part of a band as well: no key of this join has more than about `side` sets
        meet = rper.select("cl", "rband", "rsubs", around("rband")).join(per, ["cl", "band"]).select("cl", "rband", "rsubs", "band", series("subs").alias("sub"))
        rights = state.join(meet, ["cl", "band", "sub"]).select("sid", "cl", "comp", "rband", series("rsubs").alias("rsub"), "band", "sub")
        rights = rights.join(placed.select("sid", "body"), "sid")
        keys = ["cl", "rband", "rsub", "band", "sub"]
        more = lefts.groupBy(*keys).cogroup(fresh(rights).groupBy(*keys)).applyInArrow(tile, EDGES)
        edges = edges.union(keep(more, "jaccard-links"))

    comp = components(edges).select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    # only here the smallest document names a component
    linked = written(sets.select("name", "sid", "least").join(comp, "sid", "left"), "jaccard-named", rows=n)
    rows = written(both.where("kind = 0").select("doc", "own", "n", "name"), "jaccard-documents")
    done(both, sets, *used)
    best = linked.where("comp is not null").groupBy("comp").agg(F.min("least").alias("best"))
    names = linked.join(fresh(best), "comp", "left").select("name", F.coalesce("best", "least").alias("comp"))
    # most documents have no such set; they take no part in the join, where they would all be one key
    out = rows.where("name is not null").join(names, "name", "left").select("doc", "own", "n", "comp")
    out = out.union(rows.where("name is null").select("doc", "own", "n", F.lit(None).cast("long")))
    null = lambda c: F.when(c < LAST, c)
    return out.select(null(F.col("doc")).alias(key), F.col("n").alias("n_shingles"), null(F.coalesce("comp", "own")).alias("component_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
