"""Words and their hashes for whole Arrow batches of texts at a time.

Texts stay UTF-8 bytes. ASCII white space (U+0020, U+0009-000D) ends a word,
so no character is ever cut. A hash of 64 bits stands for a word or a run of
words; within one document (even of millions of words) a collision has a
chance below one in a million.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for p in (_P, _P_INV):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = out[0], out[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place of a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffer(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and len(texts)+1 offsets. A null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        width = np.int32
    else:
        texts, width = texts.cast(pa.large_string()), np.int64
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    return (LOWER[raw] if lower else raw), offs - offs[0]


class Words:
    """Words of a batch: byte ranges ``start:end``, and ``doc`` (row number)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None):
        self.data, self.offs, self.n_docs = data, offs, len(offs) - 1
        n = len(data)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            return
        inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offs[:-1][offs[:-1] < n]
        first[heads] = inside[heads]
        if cuts is not None:
            first[cuts] = True
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[:-1] |= inside[:-1] & first[1:]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def bounds(self) -> np.ndarray:
        """Word numbers at which the documents begin, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.counts())))

    def hashes(self) -> np.ndarray:
        return ranges_hash(self.data, self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def ranges_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal bytes have equal hashes anywhere."""
    return hash_of(prefix_sums(data), start, end) if len(start) else np.zeros(0, np.uint64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What :func:`hash_of` takes the hashes of byte ranges from."""
    up, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def hash_of(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs_hash(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a document, and the word
    number at which each begins."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    weight = np.uint64(1)
    for j in range(width):
        with np.errstate(over="ignore"):
            weight = weight * np.uint64(0xA0761D6478BD642F)
        total += h[j : j + n] * weight
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return mix(total[at]), at


def factorized(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each value, distinct values, index of each one's first place."""
    codes, distinct = pd.factorize(h)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(h) - 1, -1, -1)
    return codes, np.asarray(distinct), first


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of all ranges in a row."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
