"""Operator 13: document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk wherever the hash plus
one is a multiple of the block size 3 * 2**k, so a chunk's borders depend on
the text around them only, and an edit changes the chunks it touches. Each
chunk gives one of 64 letters. A fingerprint is ``k:first:second``: the letters at
block size 3 * 2**k, and at the double of it. k is the largest at which the
text has at least LEAST chunks, beginning from the size that would give SPREAD
chunks; the last letter stands for all that follows chunk SPREAD - 1, so every
byte counts.

Two fingerprints are compared where both have letters for one block size. Their
likeness is 1 - d / (m + n), d the edit distance by insertions and deletions (a
change is one of each), if they share RUN letters in a row or are equal, else
0; the larger of both sizes counts. Distances of many pairs are taken at once, by
the bit-parallel longest common subsequence in 64-bit words.

Documents are ordered by (doc_id, hash of the text); nulls come first. Nulls: a
null text is empty. Repeated rows are each other's next document. An empty text
has the fingerprint ``0::``; two of them are equal (1), one and another text are
not alike (0). An empty table gives an empty result; a single row is its own
next document. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, gathered, narrow, row_bytes, stored
from sessionlore.llm.textvec import buffer, hash_of, prefix_sums, spread

WINDOW, SPREAD, LEAST, RUN = 7, 64, 32, 4
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_CODE = np.zeros(256, np.uint8)
_CODE[LETTERS] = np.arange(64)
#: Text bytes for each partition of ordered documents.
PARTITION_BYTES = 8 << 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the WINDOW bytes that end at each byte of its text."""
    spaced = data.astype(np.uint32) + np.uint32(1)
    total = np.zeros(len(data), np.uint32)
    weight = np.uint32(1)
    # The first bytes of each text, and how many of its bytes are before them.
    width = np.minimum(np.diff(offs), WINDOW - 1)
    short = spread(offs[:-1], width)
    inside = short - np.repeat(offs[:-1], width)
    for j in range(min(WINDOW, len(data))):
        part = spaced[: len(data) - j] * weight
        lost = short[inside < j] - j
        part[lost[lost >= 0]] = 0  # bytes of the text before
        total[j:] += part
        weight = np.uint32(int(weight) * 0x01000193 & 0xFFFFFFFF)
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    total ^= total >> np.uint32(13)
    return total


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Structured rows (k, n1, s1[64], n2, s2[64]) of letter codes, one a text."""
    data, offs = buffer(texts)
    n_docs, size = len(offs) - 1, np.diff(offs)
    out = np.zeros(n_docs, [("k", np.int8), ("n1", np.uint8), ("s1", np.uint8, SPREAD), ("n2", np.uint8), ("s2", np.uint8, SPREAD)])
    if not len(data):
        return out
    start_k = np.zeros(n_docs, np.int64)
    full = size > 3 * SPREAD
    start_k[full] = np.ceil(np.log2(size[full] / (3.0 * SPREAD))).astype(np.int64)
    value = rolling(data, offs) + np.uint32(1)
    at = np.flatnonzero((value % np.uint32(3) == 0) & (value != 0))
    value = value[at]
    power = np.bitwise_count((value & -value) - np.uint32(1))
    per_doc = np.diff(np.searchsorted(at, offs))
    doc = np.repeat(np.arange(n_docs), per_doc)
    sums = prefix_sums(data)
    k = start_k
    while True:
        n = np.bincount(doc[power >= k[doc]], minlength=n_docs) + 1
        less = (n < LEAST) & (k > 0)
        if not less.any():
            break
        k = k - less
    out["k"] = k
    for shift, n_name, s_name in ((0, "n1", "s1"), (1, "n2", "s2")):
        hit = power >= k[doc] + shift
        ends, owner = at[hit] + 1, doc[hit]
        # A text's last byte need not be a trigger; what follows the last trigger is a chunk too.
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = number < SPREAD - 1
        ends, owner = ends[kept], owner[kept]
        tail = np.flatnonzero(size > 0)
        all_ends, all_owner = np.concatenate((ends, offs[1:][tail])), np.concatenate((owner, tail))
        order = np.lexsort((all_ends, all_owner))
        all_ends, all_owner = all_ends[order], all_owner[order]
        begins = np.concatenate(([0], all_ends[:-1]))
        first = np.concatenate(([True], all_owner[1:] != all_owner[:-1]))
        begins[first] = offs[:-1][all_owner[first]]
        real = all_ends > begins
        all_ends, all_owner, begins = all_ends[real], all_owner[real], begins[real]
        letter = (hash_of(sums, begins, all_ends) & np.uint64(63)).astype(np.uint8)
        number = np.arange(len(all_owner)) - np.searchsorted(all_owner, all_owner)
        out[s_name][all_owner, number] = letter
        out[n_name] = np.bincount(all_owner, minlength=n_docs)
    return out


def as_texts(prints: np.ndarray) -> list[str]:
    one, two = LETTERS[prints["s1"]], LETTERS[prints["s2"]]
    return [f"{k}:{one[i, :n].tobytes().decode()}:{two[i, :m].tobytes().decode()}" for i, (k, n, m) in enumerate(zip(prints["k"], prints["n1"], prints["n2"], strict=True))]


def parsed(texts: list[str]) -> np.ndarray:
    """The inverse of :func:`as_texts`."""
    out = np.zeros(len(texts), [("k", np.int8), ("n1", np.uint8), ("s1", np.uint8, SPREAD), ("n2", np.uint8), ("s2", np.uint8, SPREAD)])
    for i, text in enumerate(texts):
        k, one, two = text.split(":")
        out["k"][i], out["n1"][i], out["n2"][i] = int(k), len(one), len(two)
        out["s1"][i, : len(one)], out["s2"][i, : len(two)] = _CODE[list(one.encode())], _CODE[list(two.encode())]
    return out


def common_subsequence(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows of letters."""
    rows = len(a)
    masks = np.zeros((rows, 64), np.uint64)
    every = np.arange(rows)
    for j in range(SPREAD):
        live = every[n > j]
        masks[live, a[live, j]] |= np.uint64(1 << j)
    state = np.full(rows, ~np.uint64(0))
    for j in range(int(m.max()) if rows else 0):
        live = m > j
        met = state & masks[every, b[:, j]]
        state = np.where(live, (state + met) | (state - met), state)
    open_bits = np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << (n.astype(np.uint64) % np.uint64(64))) - np.uint64(1))
    return np.bitwise_count(~state & open_bits).astype(np.int64)


def share_a_run(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rows have RUN letters in a row in common."""

    def runs(s: np.ndarray, length: np.ndarray) -> np.ndarray:
        code = np.zeros((len(s), SPREAD - RUN + 1), np.int64)
        for j in range(RUN):
            code = code << 6 | s[:, j : SPREAD - RUN + 1 + j]
        row = np.arange(len(s), dtype=np.int64)[:, None] << 6 * RUN
        return (row | code)[np.arange(SPREAD - RUN + 1) + RUN <= length[:, None]]

    found = np.zeros(len(a), bool)
    found[np.intersect1d(runs(a, n), runs(b, m)) >> 6 * RUN] = True
    return found


def _like(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    n, m = n.astype(np.int64), m.astype(np.int64)
    total = n + m
    alike = 2 * common_subsequence(a, n, b, m) / np.maximum(total, 1)
    return np.where((total > 0) & share_a_run(a, n, b, m), alike, 0.0)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1 for each pair of fingerprints; equal ones have 1."""
    out = np.zeros(len(x))
    dk = x["k"].astype(int) - y["k"]
    for d, left, right in ((0, "1", "1"), (0, "2", "2"), (1, "1", "2"), (-1, "2", "1")):
        at = np.flatnonzero(dk == d)
        p, q = x[at], y[at]
        out[at] = np.maximum(out[at], _like(p[f"s{left}"], p[f"n{left}"], q[f"s{right}"], q[f"n{right}"]))
    same = (dk == 0) & (x["n1"] == y["n1"]) & (x["n2"] == y["n2"]) & (x["s1"] == y["s1"]).all(axis=1) & (x["s2"] == y["s2"]).all(axis=1)
    out[same] = 1.0
    return out


def edited(texts: list[str], following: list[str]) -> list[str]:
    """Each text with its last half (rounded down) replaced by as much of the
    begin of the text that follows, or all of that."""
    return [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]


def compared(doc_ids: pa.Array, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray, with_prints: bool = True) -> dict:
    changed = edited(texts, following)
    out = {
        "doc_id": doc_ids, "n_chars": np.array([len(t) for t in texts], np.int64),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
    }
    if not with_prints:
        return out | {c: pa.nulls(len(texts)) for c in ("fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    other = fingerprints(pa.array(changed, pa.large_string()))
    return out | {"fingerprint": as_texts(own), "edited_fingerprint": as_texts(other), "near_edited": likeness(own, other), "near_next": likeness(own, after)}


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row alone."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in gathered(batches):
            yield {"doc_id": batch.column("doc_id"), "fingerprint": as_texts(fingerprints(batch.column("text")))}

    return arrow_map(narrow(docs, "doc_id", "text"), run, "doc_id long, fingerprint string")


def compared_with_next(docs: DataFrame, partition_bytes: int = PARTITION_BYTES, with_prints: bool = True) -> DataFrame:
    """``RESULT`` of each row: its fingerprint, that of its edited text, and their
    likenesses. The documents are cut into ranges of the order and pass one
    shuffle; within a range each row sees the one after it. The last row of a
    range and the first of the next one meet afterwards: one text each for each
    range. ``with_prints`` false leaves the fingerprints out."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    _, text_bytes = row_bytes(rows)
    parts = max(1, math.ceil(text_bytes / partition_bytes))
    # Equal rows are spread by their number, or a much repeated row were one task.
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        empty = {c: None for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}

        def border(kind: int, doc_id, text: str) -> dict:
            return {c: [None] for c in empty} | {"doc_id": [doc_id], "kind": [kind], "part": [part], "text": [text]}

        for batch in gathered(batches):
            ids, texts, own = batch.column("doc_id"), batch.column("text").to_pylist(), fingerprints(batch.column("text")) if with_prints else None
            if held is None:
                yield border(1, None, texts[0])
            else:
                last_id, last_text, last_own = held
                ids, texts = pa.concat_arrays([last_id, ids]), [last_text, *texts]
                own = np.concatenate((last_own, own)) if with_prints else None
            k = len(texts) - 1
            held = ids[k:], texts[k], own[k:] if with_prints else None
            if k:
                done = compared(ids[:k], texts[:k], texts[1:], own[:k] if with_prints else None, own[1:] if with_prints else None, with_prints)
                yield done | {"kind": np.zeros(k, np.int32), "part": np.full(k, part), "text": pa.nulls(k)}
        if held is not None:
            yield border(2, held[0][0].as_py(), held[1])

    found, _ = stored(arrow_map(ordered, run, RESULT + ", kind int, part int, text string"), "fingerprints")
    inner = found.where("kind = 0").drop("kind", "part", "text")
    # One number for each range that has rows.
    used = sorted(r["part"] for r in found.where("kind = 1").select("part").collect())
    if not used:
        return inner
    follows = docs.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "part int, next_part int")
    firsts = found.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    borders = found.where("kind = 2").select("part", "doc_id", "text").join(follows, "part").join(firsts, "next_part").select("doc_id", "text", "next_text")

    def meet(batches: Iterator[pa.RecordBatch]):
        for batch in gathered(batches):
            texts, following = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
            prints = (fingerprints(batch.column("text")), fingerprints(batch.column("next_text"))) if with_prints else (None, None)
            yield compared(batch.column("doc_id"), texts, following, *prints, with_prints)

    return inner.unionByName(arrow_map(borders, meet, RESULT))
