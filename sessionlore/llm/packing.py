"""Operator 3: lexical retrieval packing.

Documents are dealt to shards by their most characteristic term (highest BM25
weight) and doc_id, in a range partitioning, so that a term with a third of
all documents is spread over many shards. Each shard is an inverted BM25 index of
its documents, with idf and mean length over the whole collection. A window of 4096 ids
begins with a seed; its best unused neighbours by BM25 over all its terms fill
the window, the last one is cut, and its rest begins the next window as the new seed. The
open end of a partition is cut into sequences of powers of two, which need
no padding.

Nulls: a null text is empty (its end id alone is packed). A null doc_id is
kept. Repeated doc_ids are packed once per row. No rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, dropped, row_bytes, slices, stored
from sessionlore.llm.subwords import Subwords, default_path
from sessionlore.llm.textvec import spread
from sessionlore.llm.tokens import tokenized, unpacked

WINDOW = 4096
END_ID = 2
K1, B = 1.2, 0.75
#: Ids of one shard's index.
SHARD_IDS = 1_500_000
PARTITION_BYTES = 48 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def terms_of(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each document: row number, id and count."""
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    key, tf = np.unique(row << 32 | ids.astype(np.int64), return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, tf


def weights(row: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: np.ndarray, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[row] / mean))


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per piece: the document's ids ``start``..``start+length``, at
    ``offset`` in sequence ``sequence_id``. A shard's index has about ``shard_ids`` ids;
    the text of a partition, whose shards follow each other, about ``partition_bytes``."""
    path = path or default_path()
    coder = Subwords.of(path)
    size, dtype = coder.size, coder.dtype
    _, text_bytes = row_bytes(docs)
    tokens, tokens_path = stored(tokenized(docs, path), "tokens")

    def frequencies(batches: Iterator[pa.RecordBatch]):
        df, rows, total = np.zeros(size + 1, np.int64), 0, 0
        for batch in slices(batches, "ids", 4 << 20):
            n = batch.column("n_tokens").to_numpy()
            _, term, _ = terms_of(unpacked(batch.column("ids"), dtype), n)
            df[:size] += np.bincount(term, minlength=size)
            rows, total = rows + len(n), total + int(n.sum())
        used = np.flatnonzero(df)
        yield {"term": [*used.tolist(), -1, -2], "n": [*df[used].tolist(), rows, total]}

    # As long as the vocabulary, whatever the number of documents.
    found = {r["term"]: r["n"] for r in arrow_map(tokens, frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, n_ids = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(size)
    df[list(found)] = list(found.values())
    mean = max(1.0, n_ids / max(1, n_docs))
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "ids", 4 << 20):
            n = batch.column("n_tokens").to_numpy()
            row, term, tf = terms_of(unpacked(batch.column("ids"), dtype), n)
            w = weights(row, tf, idf[term], n, mean)
            best = np.full(len(n), -1, np.int64)
            order = np.lexsort((term, -w, row))
            head = np.flatnonzero(np.diff(row[order], prepend=-1))
            best[row[order][head]] = term[order][head]
            yield {"key": best, "doc_id": batch.column("doc_id"), "n_tokens": n, "ids": batch.column("ids")}

    n_parts = max(1, math.ceil(text_bytes / partition_bytes))
    # Stored, so that the ranges are sampled from keys alone.
    with_keys, _ = stored(arrow_map(tokens, keyed, "key int, doc_id long, n_tokens long, ids binary"), "keyed-tokens")
    dropped(docs.sparkSession, tokens_path)
    # The row number spreads rows of one key and one doc_id (a null, say).
    with_keys = with_keys.withColumn("row", F.monotonically_increasing_id())
    dealt = with_keys.repartitionByRange(n_parts, "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "ids").drop("row")

    def fill(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 32, end_id, dtype, idf, mean, shard_ids)
        for batch in batches:
            yield from packer.add(batch)
        yield from packer.finish()

    return arrow_map(dealt, fill, SCHEMA)


class Packer:
    """Packs the documents of one partition, shard by shard."""

    def __init__(self, first_sequence: int, end_id: int, dtype: np.dtype, idf: np.ndarray, mean: float, shard_ids: int = SHARD_IDS):
        self.sequence, self.end_id, self.dtype, self.idf, self.mean, self.shard_ids = first_sequence, end_id, dtype, idf, mean, shard_ids
        self.held: list[pa.RecordBatch] = []
        self.size = 0
        #: The open window: documents (id, ids, place of the first id here).
        self.open: list[tuple[object, np.ndarray, int]] = []

    def add(self, batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices([batch], "ids", self.shard_ids * self.dtype.itemsize // 4):
            self.held.append(part)
            self.size += part.num_rows + int(np.sum(part.column("n_tokens").to_numpy()))
            if self.size >= self.shard_ids:
                yield self.shard(last=False)

    def finish(self) -> Iterator[dict]:
        if self.held or self.open:
            yield self.shard(last=True)

    def shard(self, last: bool) -> dict:
        doc_ids: list = []
        ids: list[np.ndarray] = []
        begin: list[int] = []
        for doc, x, at in self.open:
            doc_ids.append(doc)
            ids.append(x)
            begin.append(at)
        kept = len(ids)
        if self.held:
            whole = pa.Table.from_batches(self.held).combine_chunks()
            n = whole["n_tokens"].to_numpy()
            flat = np.concatenate([unpacked(c, self.dtype) for c in whole["ids"].chunks]) if len(n) else np.zeros(0, self.dtype)
            ends = np.cumsum(n)
            doc_ids += whole["doc_id"].to_pylist()
            ids += [np.append(flat[e - k : e], self.end_id).astype("<u4") for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            begin += [0] * len(n)
            order = [*range(kept), *(kept + i for i in retrieval_order(flat, n, self.idf, self.mean, sum(len(x) - b for x, b in zip(ids[:kept], begin[:kept], strict=True))))]
        else:
            order = list(range(kept))
        self.held, self.size, self.open = [], 0, []
        out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        # Ids left of each document, and the borders at which a sequence ends.
        total = sum(len(ids[i]) - begin[i] for i in order)
        tail = total % WINDOW
        borders = [*range(WINDOW, total - tail + 1, WINDOW)]
        at = total - tail
        for k in range(WINDOW.bit_length() - 1, -1, -1):
            if last and tail >> k & 1:
                at += 1 << k
                borders.append(at)
        place, k, sequence_start = 0, 0, 0
        for i in order:
            start, n = begin[i], len(ids[i])
            while start < n:
                if k == len(borders):
                    self.open.append((doc_ids[i], ids[i], start))
                    break
                length = min(n - start, borders[k] - place)
                row = (doc_ids[i], start, length, zlib.crc32(ids[i][start : start + length].tobytes()), n, self.sequence, place - sequence_start)
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
                place, start = place + length, start + length
                if place == borders[k]:
                    k, sequence_start = k + 1, place
                    self.sequence += 1
        return out


class Postings:
    """The inverted index of a shard: for each term the rows that have it, with
    their weights. Used rows are taken out whenever they are half of it."""

    def __init__(self, flat: np.ndarray, n: np.ndarray, idf: np.ndarray, mean: float):
        self.row, self.term, tf = terms_of(flat, n)
        self.weight = weights(self.row, tf, idf[self.term], n, mean).astype(np.float32)
        self.begin = np.searchsorted(self.row, np.arange(len(n) + 1))
        self.n_terms, self.used, self.since = len(idf), np.zeros(len(n), bool), 0
        self.build(np.arange(len(self.row)))

    def build(self, kept: np.ndarray) -> None:
        by_term = kept[np.argsort(self.term[kept], kind="stable")]
        self.rows, self.weights = self.row[by_term], self.weight[by_term]
        self.first = np.searchsorted(self.term[by_term], np.arange(self.n_terms + 1))
        self.left = len(by_term)

    def use(self, row: int) -> None:
        self.used[row] = True
        self.since += int(self.begin[row + 1] - self.begin[row])
        if self.since * 2 > self.left:
            self.since = 0
            self.build(np.flatnonzero(~self.used[self.row]))

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused rows by falling BM25 score for the seed, in time in proportion
        to the postings of its terms."""
        terms = self.term[self.begin[seed] : self.begin[seed + 1]]
        at = spread(self.first[terms], self.first[terms + 1] - self.first[terms])
        rows, gain = self.rows[at], self.weights[at]
        if len(rows) * 4 < len(self.used):
            found, code = np.unique(rows, return_inverse=True)
            score = np.bincount(code, weights=gain, minlength=len(found))
        else:
            score = np.bincount(rows, weights=gain, minlength=len(self.used))
            found = np.flatnonzero(score)
            score = score[found]
        free = ~self.used[found]
        found, score = found[free], score[free]
        while len(found):  # the best of them first; mostly they fill the window
            best = score >= np.partition(score, len(score) - 64)[len(score) - 64] if len(score) > 64 else np.ones(len(score), bool)
            yield from found[best][np.argsort(-score[best], kind="stable")].tolist()
            found, score = found[~best], score[~best]


def retrieval_order(flat: np.ndarray, n: np.ndarray, idf: np.ndarray, mean: float, filled: int = 0) -> list[int]:
    """The order in which the documents of a shard fill windows; ``filled`` ids
    are in the first window already. Documents without terms are nobody's
    neighbours and come last, as they stand."""
    index = Postings(flat, n, idf, mean)
    order: list[int] = []
    some = np.flatnonzero(n > 0)
    next_seed, room = 0, WINDOW - filled % WINDOW
    queue: Iterator[int] = iter(())
    while len(order) < len(some):
        doc = next((i for i in queue if not index.used[i]), -1)
        seed = doc < 0
        if seed:
            while index.used[some[next_seed]]:
                next_seed += 1
            doc = int(some[next_seed])
        index.use(doc)
        order.append(doc)
        length = int(n[doc]) + 1
        if length >= room:  # the rest of this document begins the next window
            room, seed = WINDOW - (length - room) % WINDOW, True
        else:
            room -= length
        if seed:
            queue = index.neighbours(doc)
    return order + np.flatnonzero(n == 0).tolist()
