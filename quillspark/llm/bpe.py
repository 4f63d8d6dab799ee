"""Operator 5, BPE encoding and decoding of whole texts with a public byte-level vocabulary.

A text is cut into pieces by the vocabulary's pattern. The bytes of a piece form a doubly linked list of
symbols; a heap of (rank, position) yields the best merge, entries whose symbols have changed since are
skipped, and each merge pushes the two pairs it makes. Decoding concatenates the vocabulary's strings.
Texts are taken some at a time: what stands between spaces is encoded once for all of them.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

#: Fixed values of byte-level vocabularies: the pattern that cuts a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this many bytes are remembered, so many and as many older ones; others are encoded anew.
REMEMBER_BYTES, REMEMBER = 48, 150_000
#: Characters of texts that are taken at a time (a longer text alone), and words whose ids are put together at a time.
HELD, AT_ONCE = 8 << 20, 1 << 18
#: Ids as they are kept, and as they are given.
IDS, GIVEN = np.dtype(np.uint32), np.dtype("<u4")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes as the vocabulary file at `path` says (BPE model, byte-level, no normalizer)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in enumerate(byte_chars())}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab.get(c) for c in byte_chars()]
        # the rank of left << 20 | right, and what the merge of a rank makes
        self.ranks, self.made = {}, []
        for rank, m in enumerate(spec["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault(vocab[x] << 20 | vocab[y], rank)
            self.made.append(vocab[x + y])
        self.byte_pairs = [-1 if x is None or y is None else self.ranks.get(x << 20 | y, -1) for x in self.byte_ids for y in self.byte_ids]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that strip, normalize or want whole words are not supported")
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.unsafe = regex.compile(r"\s |^ ").search
        strings = {i: bytes(of[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        self.strings = pa.array([strings.get(i, b"") for i in range(max(strings) + 1)], pa.binary())
        # the pieces of late with their ids, and those used before them
        self.late: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, data: bytes) -> list[int]:
        get, made = self.ranks.get, self.made
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        # of each symbol the rank of its merge with the next one as they now stand, -1 where there is none
        now = [self.byte_pairs[x << 8 | y] for x, y in zip(data, data[1:], strict=False)]
        # heap entries are rank << shift | position of the left symbol
        shift = n.bit_length()
        heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
        if not heap:
            return ids
        now.append(-1)
        before, after, low = list(range(-1, n - 1)), list(range(1, n + 1)), (1 << shift) - 1
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & low, entry >> shift
            if now[i] != rank:
                continue  # stale: one of its two symbols has been merged since
            j = after[i]
            ids[i], ids[j], now[j] = x, _, _ = made[rank], -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                now[i] = r = get(x << 20 | ids[k], -1)
                if r >= 0:
                    heappush(heap, r << shift | i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = get(ids[h] << 20 | x, -1)
                if r >= 0:
                    heappush(heap, r << shift | h)
        return [x for x in ids if x >= 0]

    def remembered(self, piece: str) -> bytes:
        """The ids of a piece that isn't among those of late."""
        got = self.older.get(piece)
        if got is None:
            data = piece.encode()
            got = array("I", self.piece(data)).tobytes()
            if len(data) > REMEMBER_BYTES:
                return got
        if len(self.late) >= REMEMBER:
            self.older, self.late = self.late, {}
        self.late[piece] = got
        return got

    def cut(self, text: str) -> bytes:
        found = self.pieces(text)
        if len(found) == 1:
            return self.late.get(text) or self.remembered(text)
        return b"".join([self.late.get(p) or self.remembered(p) for p in found])

    def special_cut(self, text: str) -> bytes:
        """A text's ids, piece by piece, with the vocabulary's added tokens."""
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [self.cut(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*parts, self.cut(text[at:])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts.

        Between a character and a single space after it a piece always ends, and what follows is cut without
        regard to what stands before: so what stands between single spaces, each with its space, is encoded once for
        all the texts and put together by number. Texts of other spaces or with added tokens go by themselves.
        """
        plain = [not self.unsafe(t) and not (self.special and self.special.search(t)) for t in texts]
        out = [None if p else np.frombuffer(self.special_cut(t), IDS) for p, t in zip(plain, texts, strict=True)]
        # the last word of each text has its text's end behind it, the first has no space before it
        split = pc.split_pattern(pa.array([t for p, t in zip(plain, texts, strict=True) if p], pa.large_string()), " ")
        ends = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        firsts, at = ends[:-1], words.indices.to_numpy()
        known = words.dictionary.to_pylist()
        used = np.zeros(len(known), bool)
        inner = np.ones(len(at), bool)
        inner[firsts] = False
        used[at[inner]] = True
        ids = [self.cut(" " + w) if u else b"" for w, u in zip(known, used, strict=True)]
        ids += [self.cut(known[at[i]]) for i in firsts]
        at = at.astype(np.int64)
        at[firsts] = len(known) + np.arange(len(firsts))
        every = np.frombuffer(b"".join(ids), IDS)
        sizes = np.fromiter((len(x) // IDS.itemsize for x in ids), np.int64, len(ids))
        starts = np.cumsum(sizes) - sizes
        whole, parts = np.concatenate(([0], np.cumsum(sizes[at])))[ends], []
        for i in range(0, len(at), AT_ONCE):
            some = at[i : i + AT_ONCE]
            n = sizes[some]
            parts.append(every[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        joined = np.concatenate(parts) if parts else every[:0]
        got = iter(zip(whole[:-1], whole[1:], strict=True))
        return [joined[slice(*next(got))] if x is None else x for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings of ids, one after the other."""
        parts = [self.strings.take(pa.array(ids[i : i + AT_ONCE].astype(np.int64))) for i in range(0, len(ids), AT_ONCE)]
        return b"".join(p.buffers()[2].to_pybytes() for p in parts if p.buffers()[2] is not None).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, keep: tuple[str, ...] = ("doc_id",), full: bool = True) -> DataFrame:
    """For each row the columns `keep`, long n_tokens, binary ids (little-endian unsigned 32-bit), string decoded.

    With full=False, the digests ids_sha256 and decoded_sha256 (lowercase hex) instead of ids and decoded.
    A null text counts as empty: no ids, decoded empty. Texts are encoded whole, some of up to HELD bytes
    together, so memory is that of HELD bytes or of one longer text, and of the remembered pieces. An empty table gives no rows. The columns made replace
    kept ones of their names.
    """
    bounded_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    made = [("n_tokens", "bigint"), *([("ids", "binary"), ("decoded", "string")] if full else [("ids_sha256", "string"), ("decoded_sha256", "string")])]
    names = [c for c in keep if c not in {n for n, _ in made}]
    rows = docs.select(*names, docs[text].alias("__text"))
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]
    schema = T.StructType(fields + [T.StructField(n, T._parse_datatype_string(k)) for n, k in made])
    types = [pa.int64(), *([pa.binary(), pa.string()] if full else [pa.string(), pa.string()])]

    def made_of(c: Codec, held: list[pa.RecordBatch]):
        every = c.encode([t.as_py() or "" for b in held for t in b.column(b.num_columns - 1)])
        at = 0
        for b in held:
            some = every[at : at + b.num_rows]
            at += b.num_rows
            out = ([], [], [])
            for ids in some:
                back, ids = c.decode(ids), ids.astype(GIVEN, copy=False)
                out[0].append(len(ids))
                out[1].append(ids.tobytes() if full else hashlib.sha256(ids).hexdigest())
                out[2].append(back if full else hashlib.sha256(back.encode()).hexdigest())
            arrays = [b.column(i) for i in range(len(names))] + [pa.array(x, k) for x, k in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *[n for n, _ in made]])

    def run(batches):
        c, held, size = codec(path), [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= HELD:
                yield from made_of(c, held)
                held, size = [], 0
        yield from made_of(c, held)

    return rows.mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, full=False)
