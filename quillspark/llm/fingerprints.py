"""Hashes of word sequences by numpy, and their sorted runs as compact binary blocks."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers: of bytes in a word, of words in a window, of the second hash of a window.
BYTE, WORD, SECOND = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text hashed at a time; a longer text is hashed alone.
SLICE = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of BYTE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = U(pow(int(BYTE), -1, 1 << 64))
        for i, base in enumerate((BYTE, inverse)):
            steps = np.full(max(n, SLICE + 4096), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(32)
    return h


class Words:
    """The words of some texts (UTF-8): bytes, byte ranges of the words, words of each text, hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.data = LOWER[data] if lower else data
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_ends = np.cumsum(lengths)  # after the space that ends each text
        space = SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.last = np.searchsorted(self.starts, self.text_ends)  # words up to the end of each text
        self.counts = np.diff(self.last, prepend=0)
        p, inverse = powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(TABLE[self.data] * p[: len(self.data)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + U(1))


def slices(texts: list[bytes]):
    """Consecutive groups of texts of about SLICE bytes."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > SLICE:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def window_hashes(words: Words, k: int, second: bool = False):
    """The hash of each window of k words in one text, in order, windows of each text (and the second hash)."""
    n = len(words.hashes) - k + 1
    counts = np.maximum(words.counts - k + 1, 0)
    out = []
    for base in (WORD, SECOND)[: 1 + second]:
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(k if n > 0 else 0):
            h += words.hashes[j : n + j] * U(pow(int(base), j, 1 << 64))
        out.append(h)
    firsts = words.last - words.counts
    at = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return (mix(out[0][at]), counts, mix(out[1][at])) if second else (mix(out[0][at]), counts)


def planes(values: np.ndarray) -> bytes:
    """An array's bytes by significance, so that a general compressor finds the empty ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() if len(values) else b""


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if data else np.zeros(0, kind)


def pack(hashes: np.ndarray, more: np.ndarray) -> bytes:
    """A sorted run: differences of its hashes and, of each, a value of a small type, by planes."""
    return planes(np.diff(hashes, prepend=U(0))) + planes(more)


def unpack(data: bytes, kind) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // (8 + np.dtype(kind).itemsize)
    return np.cumsum(unplanes(data[: 8 * n], np.uint64)), unplanes(data[8 * n :], kind)


def bucket_edges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2^bits ranges of hashes begins in a sorted run, and its end."""
    if not bits:
        return np.array([0, len(hashes)])
    at = np.arange(1 << bits, dtype=np.uint64) << U(64 - bits)
    return np.append(np.searchsorted(hashes, at), len(hashes))


def bits_for(total_bytes: int, per_bucket: int) -> int:
    """Bits of a hash that name its bucket, for buckets of about per_bucket windows (a word takes some 6 bytes)."""
    return max(4, min(30, (total_bytes // (6 * per_bucket)).bit_length()))
