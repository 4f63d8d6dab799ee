"""Operator 4, substring dedup: a log-structured fingerprint index of word windows.

Documents come in batches of rising doc_id, a batch in chunks of rising doc_id and of like size; the documents of one
doc_id may be several chunks, which are no earlier ones to each other. The index is dealt by ranges of window hashes to buckets. A chunk sends each bucket a sorted run of its distinct hashes; the
bucket merge-joins the run with the immutable runs of what came before, verifies a match by a second hash,
keeps what is new as a run, and compacts runs of like size. What it answers, one bit for each hash,
goes back to the chunk, which removes the words that repeated windows cover.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, shielded, written
from .fingerprints import Words, bits_for, bucket_edges, pack, slices, unpack, window_hashes

WINDOW = 13
#: Bytes of text of a chunk, and of a batch at most; a batch has MOST_CHUNKS chunks at most, so a chunk is four times as large at most.
CHUNK_BYTES, BATCH_BYTES, MOST_CHUNKS = 4 << 20, 64 << 30, 4096
#: Ranges of keys that are weighed for each chunk.
FINE = 4
BUCKET_WINDOWS = 1 << 20
#: Run tables of an index before they are compacted into one; runs in a bucket merge when within this ratio.
MOST_RUNS, RATIO = 8, 2
LAST = 2**63 - 1
#: What is kept of a window's second hash, by which a match of the first is verified.
CHECK = np.dtype(np.uint32)
REPLY = "__chunk bigint, __bucket bigint, __data binary"


class Chunk:
    """The windows of a chunk of documents, grouped by hash."""

    def __init__(self, texts: list[bytes], k: int):
        self.k, self.words, hashes, checks, counts = k, [], [], [], []
        for group in slices(texts):
            w = Words(group)
            h, n, c = window_hashes(w, k, second=True)
            w.hashes = None
            self.words.append(w)
            hashes.append(h)
            checks.append((c >> np.uint64(64 - 8 * CHECK.itemsize)).astype(CHECK))
            counts.append(n)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        checks = np.concatenate(checks) if checks else np.zeros(0, CHECK)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.order = np.argsort(self.hashes, kind="stable")
        h, c = self.hashes[self.order], checks[self.order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        self.firsts = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.run = h[new], c[new]

    def repeated(self, ranks: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """Of each window: whether it also starts in a smaller document, of this chunk or one before."""
        out = np.zeros(len(self.hashes), bool)
        if len(out):
            rank = np.repeat(ranks, self.counts)[self.order]
            least = np.minimum.reduceat(rank, self.firsts)
            out[self.order] = elsewhere[self.group] | (rank > least[self.group])
        return out

    def kept(self, repeated: np.ndarray):
        """(words, removed words, kept words joined by a space) of each document."""
        at = 0
        for w in self.words:
            n = np.maximum(w.counts - self.k + 1, 0)
            hit = repeated[at : at + n.sum()]
            at += n.sum()
            # the word at which each window of this slice starts
            start = np.repeat((w.last - w.counts) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            start = start[hit]
            total = len(w.starts)
            cover = np.cumsum(np.bincount(start, minlength=total + 1) - np.bincount(start + self.k, minlength=total + 1)[: total + 1])[:total] > 0
            gone = np.concatenate(([0], np.cumsum(cover)))
            s, e = w.starts[~cover], w.ends[~cover]
            data = w.data.copy()
            data[e] = 32
            mask = np.zeros(len(data) + 1, np.int8)
            mask[s] += 1
            mask[e + 1] -= 1
            mask = np.cumsum(mask, dtype=np.int8)[:-1].astype(bool)
            out = data[mask].tobytes()
            ends = np.concatenate(([0], np.cumsum(mask)))[w.text_ends]
            first = 0
            for last, words, i in zip(ends, w.counts, w.last, strict=True):
                yield int(words), int(gone[i] - gone[i - words]), out[first : max(first, last - 1)]
                first = last


class Runs:
    """The runs of one bucket: each sorted, immutable, of hashes that no older run has."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def seen(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of each fingerprint of a sorted run: whether a run has it."""
        out = np.zeros(len(h), bool)
        for rh, rc in self.runs:
            if not len(rh):
                continue
            at = np.minimum(np.searchsorted(rh, h), len(rh) - 1)
            out |= (rh[at] == h) & (rc[at] == c)
        return out

    def add(self, h: np.ndarray, c: np.ndarray) -> None:
        self.runs.append((h, c))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < RATIO * len(self.runs[-1][0]):
            self.compact(2)

    def compact(self, n: int) -> None:
        last = self.runs[-n:]
        h = np.concatenate([x[0] for x in last])
        order = np.argsort(h, kind="stable")
        self.runs[-n:] = [(h[order], np.concatenate([x[1] for x in last])[order])]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    chunks, buckets, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"__chunk": pa.array(chunks, pa.int64()), "__bucket": pa.array(buckets, pa.int64()), "__data": pa.array(data, pa.binary())})


def _texts(table: pa.Table, text: str) -> list[bytes]:
    return [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in table.column(text).cast(pa.binary()).combine_chunks()] if table.num_rows else []


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("__key", "ascending")]) if table.num_rows else table


class FingerprintIndex:
    """An index of the window hashes of all batches so far: run tables (bucket, run) in the shared folder, which can be saved and opened by a later job."""

    def __init__(self, bits: int, k: int = WINDOW):
        self.bits, self.k, self.tables = bits, k, []

    def save(self, spark: SparkSession, folder: str) -> None:
        """The index as one compacted table in a folder, with what it was made with; a folder that is there already is an error."""
        self.compact()
        runs = self.tables[0] if self.tables else spark.createDataFrame([], REPLY)
        runs.write.parquet(f"{folder}/runs")
        spark.createDataFrame([(self.bits, self.k)], "bits int, k int").coalesce(1).write.parquet(f"{folder}/made")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> "FingerprintIndex":
        """A saved index, whose documents come before all that are ingested from now on."""
        made = spark.read.parquet(f"{folder}/made").first()
        index = cls(made["bits"], made["k"])
        index.tables = [spark.read.schema(REPLY).parquet(f"{folder}/runs")]
        return index

    def ingest(self, docs: DataFrame, text: str, made: list, keep: list[str], keep_runs: bool, groups: list[int]) -> DataFrame:
        """docs of one batch (with __chunk, __key) as rows of keep and made; then their hashes are in the index.

        groups has the first chunk of each group of chunks that are no earlier ones to each other.
        """
        k, bits = self.k, self.bits

        def send(table: pa.Table) -> pa.Table:
            run = Chunk(_texts(_sorted(table), text), k).run
            edges = bucket_edges(run[0], bits)
            chunk = table.column("__chunk")[0].as_py()
            return _rows([(chunk, b, pack(run[0][x:y], run[1][x:y])) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x])

        def join(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table.column("__chunk").to_pylist(), table.column("__data"), strict=True), key=lambda r: r[0])
            bucket, out, index, new = table.column("__bucket")[0].as_py(), [], Runs(), Runs()
            group, waiting = -1, []

            def enter():
                for h, c in waiting:
                    fresh = ~new.seen(h, c)
                    new.add(h[fresh], c[fresh])
                waiting.clear()

            for chunk, data in rows:
                h, c = unpack(data.as_py(), CHECK)
                if chunk < 0:  # a run of the history
                    index.add(h, c)
                    continue
                if (at := bisect_right(groups, chunk)) != group:
                    enter()
                    group = at
                seen = index.seen(h, c) | new.seen(h, c)
                if seen.any():
                    out.append((chunk, bucket, np.packbits(seen).tobytes()))
                waiting.append((h[~seen], c[~seen]))
            enter()
            if keep_runs and new.runs:
                new.compact(len(new.runs))
                out.append((-1, bucket, pack(*new.runs[0])))
            return _rows(out)

        def answer(table: pa.Table, replies: pa.Table) -> pa.Table:
            table = _sorted(table)
            chunk = Chunk(_texts(table, text), k)
            edges = bucket_edges(chunk.run[0], bits)
            elsewhere = np.zeros(len(chunk.run[0]), bool)
            for b, data in zip(replies.column("__bucket").to_pylist(), replies.column("__data"), strict=True):
                x, y = edges[b], edges[b + 1]
                elsewhere[x:y] = np.unpackbits(np.frombuffer(data.as_py(), np.uint8), count=y - x).astype(bool)
            keys = np.array(table.column("__key").to_pylist(), np.int64)
            got = list(chunk.kept(chunk.repeated(keys, elsewhere)))
            columns = {"n_words": pa.array([x[0] for x in got], pa.int64()), "n_removed": pa.array([x[1] for x in got], pa.int64())}
            if "kept_text" in dict(made):
                columns["kept_text"] = pa.array([x[2] for x in got], pa.binary()).cast(pa.string())
            if "kept_sha256" in dict(made):
                columns["kept_sha256"] = pa.array([hashlib.sha256(x[2]).hexdigest() for x in got], pa.string())
            return pa.table([*[table.column(c) for c in keep], *[columns[n] for n, _ in made]], names=[*keep, *[n for n, _ in made]])

        new = docs.groupBy("__chunk").applyInArrow(send, REPLY)
        for t in self.tables:
            new = new.unionByName(t)
        replies = new.groupBy("__bucket").applyInArrow(join, REPLY)
        if keep_runs:
            replies = written(replies, "substring-runs")
            self.tables.append(replies.where("__chunk < 0"))
            replies = replies.where("__chunk >= 0")
            if len(self.tables) >= MOST_RUNS:
                self.compact()
        types = {f.name: f.dataType for f in docs.schema.fields}
        schema = T.StructType([T.StructField(c, types[c]) for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in made])
        return docs.groupBy("__chunk").cogroup(replies.groupBy("__chunk")).applyInArrow(answer, schema)

    def compact(self) -> None:
        """The run tables as one."""

        def merge(table: pa.Table) -> pa.Table:
            runs = Runs()
            runs.runs = [unpack(x.as_py(), CHECK) for x in table.column("__data")]
            runs.compact(len(runs.runs))
            return _rows([(-1, table.column("__bucket")[0].as_py(), pack(*runs.runs[0]))])

        if len(self.tables) < 2:
            return
        whole = self.tables[0]
        for t in self.tables[1:]:
            whole = whole.unionByName(t)
        self.tables = [written(whole.groupBy("__bucket").applyInArrow(merge, REPLY), "substring-compacted")]


def ranges(key, points: list[int]):
    """The number of points below key: two steps, over every w-th point and over the w points after it."""
    w = max(1, int(len(points) ** 0.5))
    parts = [points[i : i + w] for i in range(0, len(points), w)]
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if not parts:
        return F.lit(0).cast("long")
    below = lambda a: F.size(F.filter(a, lambda s: s < key))
    part = below(lit([p[0] for p in parts[1:]])) if len(parts) > 1 else F.lit(0)
    return (part * w + below(F.get(F.array(*[lit(p) for p in parts]), part))).cast("long")


def cuts(rows: DataFrame, text: str, parts: int) -> tuple[Column, list[int]]:
    """The chunk of each row of rows (__key, text), of about `parts`, and the first chunk of each group.

    Keys are cut into FINE times as many ranges, whose bytes say where chunks begin. A key that fills a
    range by itself is a range of its own, and a group of chunks if it has the bytes of several.
    """
    if parts < 2:
        return F.lit(0).cast("long"), [0]
    n = parts * FINE
    points = rows.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("p")).first()["p"] or []
    alone = {p for p, q in zip(points, points[1:], strict=False) if p == q}
    points = sorted({*points, *[p - 1 for p in alone]})
    range_of = ranges(F.col("__key"), points)
    weighed = rows.groupBy(range_of.alias("r")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("w")).collect()  # a row for each range
    weights = [0] * (len(points) + 1)
    for r in weighed:
        weights[r["r"]] = r["w"]
    share = sum(weights) / parts
    first, subs, groups, held = [], [], [0], 0.0
    for i, w in enumerate(weights):
        own = i < len(points) and points[i] in alone
        if held and (held + w > share or own):
            groups.append(groups[-1] + 1)
            held = 0.0
        first.append(groups[-1])
        subs.append(max(1, round(w / share)) if own else 1)
        held += w
        if own:
            groups.append(groups[-1] + subs[-1])
            held = 0.0
    numbers = lambda xs: lookup(xs, range_of)
    return (numbers(first) + F.pmod(F.xxhash64(text), numbers(subs))).cast("long"), groups


def lookup(values: list[int], at: Column) -> Column:
    """The value at a position of a list, in two steps."""
    w = max(1, int(len(values) ** 0.5))
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    return F.get(F.get(F.array(*[lit(values[i : i + w]) for i in range(0, len(values), w)]), F.floor(at / w).cast("int")), F.pmod(at, F.lit(w)).cast("int"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, full: bool = True, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = BATCH_BYTES, index: FingerprintIndex | None = None) -> DataFrame:
    """docs with long n_words and n_removed and string kept_text (with full=False kept_sha256, and of docs the key alone).

    A word is removed if a window of k words that covers it also starts in a document of smaller key.
    kept_text has the other words, joined by one space. Null texts have no words; documents of fewer than
    k words lose none; rows of one key are no earlier documents of each other; null keys count as the
    largest. Two windows are taken for equal if 96 bits of two independent hashes agree. An empty table gives no
    rows. The columns made replace columns of their names. What an index holds that is given comes before all of
    docs, whose windows it then has as well; k is the index's.
    """
    bounded_batches(docs.sparkSession)
    made = [("n_words", "bigint"), ("n_removed", "bigint"), ("kept_text", "string") if full else ("kept_sha256", "string")]
    docs, (key, text), back = shielded(docs, key, text)
    keep = [c for c in (docs.columns if full else [key]) if c not in dict(made)]
    rows = docs.select(*dict.fromkeys([*keep, key, text])).withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(LAST)))
    total = rows.agg(F.sum(F.octet_length(text)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return back(rows.select(*keep, *[F.lit(None).cast(t).alias(n) for n, t in made]))
    size, lasting = total["t"] or 0, index is not None
    batches = max(1, -(-size // batch_bytes))
    chunks = max(1, min(MOST_CHUNKS, -(-size // (batches * chunk_bytes))))
    chunk, groups = cuts(rows, text, batches * chunks)
    rows = rows.withColumn("__chunk", chunk)
    index, out = index or FingerprintIndex(bits_for(size, BUCKET_WINDOWS), k), None
    # batches end where groups do
    ends = [groups[min(len(groups) - 1, -(-len(groups) * b // batches))] for b in range(batches)]
    for b in range(batches):
        part = rows if batches == 1 else rows.where((F.col("__chunk") >= ends[b]) & (F.col("__chunk") < ends[b + 1] if b < batches - 1 else F.lit(True)))
        got = index.ingest(part, text, made, keep, lasting or batches > 1, groups)
        out = got if out is None else out.unionByName(got)
    return back(out)


def op4(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), full=False)
