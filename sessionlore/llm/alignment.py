"""Operator 11: alignment of two tokenizers' ids over the same bytes.

Tokenizer A is a byte-level BPE, B a sentencepiece BPE; both read a space and the
text. The ends of their tokens, as byte offsets, are two sorted lists. They are
merged by merge path: a binary search on each diagonal (a number of merged ends)
finds where both lists stand there, which cuts the merge into independent pieces of
equal work, whatever documents they belong to. A piece emits the ends that both
lists have, by which tokens fall into groups; a group over the border of pieces is
stitched from the last common end of one and the first common end of a later piece.

All A and B tokens of a group are linked. A pair of ids counts the documents that
have it linked: tasks count distinct pairs of their documents, sums by pair follow.
The table of pairs is broadcast after a check of its size; beyond it, blocks of
documents ask for their own pairs.

Texts are encoded by the libraries unit by unit, a unit once while a worker's table
has it. A unit begins at a space or line end before a visible character; neither
tokenizer has a token across that place, which tests assert against whole texts.

Nulls: texts null or empty, or whose tokens do not give their bytes back (those
with U+2581), have no tokens: zeros, and an empty ``groups_sha256``. A null doc_id
stays null. Repeated rows are documents of their own. An empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.llm.collocations import Container
from sessionlore.llm.common import arrow_map, as_batch, gathered, narrow, row_bytes, stored
from sessionlore.llm.textvec import buffer, factorized, ranges_hash, spread

#: Merged ends of a piece.
PIECE = 1 << 16
#: Units that the table of a Python worker holds at most; beyond it starts anew.
TABLE_UNITS = 1_000_000
#: Pairs that a task holds before it passes them on.
TASK_PAIRS = 2 << 20
#: Pairs of ids (17 bytes each) that are broadcast at most.
BROADCAST_PAIRS = 6_000_000
#: Text bytes of a block, where pairs are looked up by blocks.
BLOCK_BYTES = 16 << 20
#: Links of a group beyond which equal ids are taken together.
LARGE_GROUP = 1 << 12
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_START = np.zeros(256, bool)
_START[[0x20, 0x0A]] = True
#: Bytes after which no white space of any kind can begin: visible ASCII, and lead
#: bytes of characters none of which is white space.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
_DIGITS = np.zeros((1 << 16, 6), np.uint8)
_SHOWN = np.zeros((1 << 16, 6), bool)
for _k in range(5):
    _power = 10 ** (4 - _k)
    _DIGITS[:, _k] = np.arange(1 << 16) // _power % 10 + 48
    _SHOWN[:, _k] = (np.arange(1 << 16) >= _power) | (_k == 4)
_SHOWN[:, 5] = True


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, and a table of units that have been encoded."""

    _open: dict[tuple[str, str], Pair] = {}

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        vocab = self.a.get_vocab()
        self.width_a = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width_a[i] = len(token)  # a character stands for a byte
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.vocab_size()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.size_b))]
        self.width_b = np.array([len(x) for x in self.bytes_b], np.int64)
        if max(len(self.width_a), self.size_b) > 1 << 16:
            raise ValueError("vocabularies of over 65,536 ids are not supported")
        self.clear()

    @classmethod
    def of(cls, paths: tuple[str, str]) -> Pair:
        """One per Python worker and pair of files."""
        if paths not in cls._open:
            cls._open[paths] = cls(*paths)
        return cls._open[paths]

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.rows = np.zeros((0, 5), np.int64)  # begin and length in A's pool and in B's, and whether the bytes come back
        self.pools = [np.zeros(0, np.uint16), np.zeros(0, np.uint16)]

    def lookup(self, texts: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A row of the table for each unit, a byte range of ``texts``."""
        codes, distinct, first = factorized(ranges_hash(texts, start, end))
        if len(self.known) + len(distinct) > TABLE_UNITS:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != distinct[inside]
        if fresh.any():
            rows = self.encoded([texts[start[i] : end[i]].tobytes() for i in first[fresh]])
            known = np.concatenate((self.known, distinct[fresh]))
            order = np.argsort(known, kind="stable")
            self.known, self.rows = known[order], np.concatenate((self.rows, rows))[order]
            at = np.searchsorted(self.known, distinct)
        return self.rows[at[codes]]

    def encoded(self, units: list[bytes]) -> np.ndarray:
        """Rows of new units. Those that begin as units inside a text do, and do not
        end in a space, are encoded many at a time, after a sentinel."""
        rows = np.zeros((len(units), 5), np.int64)
        new: tuple[list, list] = [], []
        sizes = [len(p) for p in self.pools]

        def kept(at: list[int], pool: int, lengths: np.ndarray, ids: np.ndarray) -> None:
            rows[at, 2 * pool] = sizes[pool] + np.cumsum(lengths) - lengths
            rows[at, 2 * pool + 1] = lengths
            sizes[pool] += len(ids)
            new[pool].append(ids)

        inner = np.array([len(u) > 1 and u[0] in b" \n" and bool(_VISIBLE[u[1]]) and u[-1] != 0x20 and len(u) < 1000 and "▁".encode() not in u for u in units], bool)
        alone = np.flatnonzero(~inner).tolist()
        many = np.flatnonzero(inner)
        for begin in range(0, len(many), 20_000):
            groups = [many[i : min(i + 400, begin + 20_000)].tolist() for i in range(begin, min(begin + 20_000, len(many)), 400)]
            joined = [b" a" + b"".join(units[i] for i in g) for g in groups]
            texts = [x.decode() for x in joined]
            found_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            found_b = self.b.encode([t[1:] for t in texts], num_threads=1)
            for g, raw, a, b in zip(groups, joined, found_a, found_b, strict=True):
                ends = 2 + np.cumsum([len(units[i]) for i in g])
                a, b = np.array(a, np.uint16), np.array(b, np.uint16)
                last_a, last_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
                at_a, at_b = np.searchsorted(last_a, [2, *ends]), np.searchsorted(last_b, [2, *ends])
                whole = last_a[-1] == last_b[-1] == ends[-1] and (last_a[at_a[1:]] == ends).all() and (last_b[at_b[1:]] == ends).all() and last_a[at_a[0]] == last_b[at_b[0]] == 2
                if not whole or b"".join(self.bytes_b[i] for i in b) != raw:
                    alone += g
                    continue
                kept(g, 0, np.diff(at_a), a[at_a[0] + 1 :])
                kept(g, 1, np.diff(at_b), b[at_b[0] + 1 :])
                rows[g, 4] = 1
        if alone:
            texts = [units[i].decode() for i in alone]
            found_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            # B adds a space of its own: that of the unit, or one before a line end, a token by itself.
            found_b = [self.b.encode(t[1:] if t[0] == " " else t) for t in texts]
            for i, t, a, b in zip(alone, texts, found_a, found_b, strict=True):
                b = [self.b.piece_to_id("▁")] if t == " " else b if t[0] == " " else b[1:]
                kept([i], 0, np.array([len(a)]), np.array(a, np.uint16))
                kept([i], 1, np.array([len(b)]), np.array(b, np.uint16))
                rows[i, 4] = b"".join(self.bytes_b[x] for x in b) == units[i]
        self.pools = [np.concatenate([p, *x]) for p, x in zip(self.pools, new, strict=True)]
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all texts in a row, and each text's numbers of them."""
        raw, offs = buffer(texts)
        n_docs, size = len(offs) - 1, np.diff(offs)
        some = size > 0
        data = np.insert(raw, offs[:-1][some], 0x20)
        offs = offs + np.concatenate(([0], np.cumsum(some)))
        if not len(data):
            none = np.zeros(n_docs, np.int64)
            return np.zeros(0, np.uint16), none, np.zeros(0, np.uint16), none
        begins = _START[data]
        begins[:-1] &= _VISIBLE[data[1:]]
        begins[-1] = False
        begins[1:] &= (data[1:] == 0x0A) | (data[:-1] != 0x20)
        begins[offs[:-1][some]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        doc = np.searchsorted(offs, start, "right") - 1
        rows = self.lookup(data, start, end)
        bad = np.zeros(n_docs, bool)
        bad[doc[rows[:, 4] == 0]] = True
        rows, doc = rows[~bad[doc]], doc[~bad[doc]]
        out = []
        for pool, column in ((self.pools[0], 0), (self.pools[1], 2)):
            out.append(pool[spread(rows[:, column], rows[:, column + 1])])
            out.append(np.bincount(doc, weights=rows[:, column + 1], minlength=n_docs).astype(np.int64))
        return tuple(out)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before every ``work``-th merged item, by
    binary searches on all diagonals at once; equal items stay together."""
    d = np.unique(np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b)))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) >> 1
        further = np.zeros(len(d), bool)
        further[open_] = a[middle[open_]] <= b[d[open_] - middle[open_] - 1]
        low, high = np.where(open_ & further, middle + 1, low), np.where(open_ & ~further, middle, high)
    i, j = low, d - low
    met = (i > 0) & (j < len(b))
    met[met] = a[i[met] - 1] == b[j[met]]
    return i, j + met


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in both sorted lists after each end that they share, of one piece."""
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit + 1, at[hit] + 1


def groups(ends_a: np.ndarray, ends_b: np.ndarray, work: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of A and B tokens of each group, piece by piece."""
    i, j = diagonals(ends_a, ends_b, work)
    found = [(x + i[k], y + j[k]) for k in range(len(i) - 1) for x, y in [common_ends(ends_a[i[k] : i[k + 1]], ends_b[j[k] : j[k + 1]])]]
    # Stitching: a group lies between two common ends that follow each other, of any pieces.
    after_a, after_b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return np.diff(after_a, prepend=0), np.diff(after_b, prepend=0)


class Aligned:
    """The groups and links of a batch of texts."""

    def __init__(self, pair: Pair, texts: pa.Array, work: int = PIECE):
        self.a, self.n_a, self.b, self.n_b = pair.encode(texts)
        self.in_a, self.in_b = groups(np.cumsum(pair.width_a[self.a]), np.cumsum(pair.width_b[self.b]), work)
        self.size_b = pair.size_b
        ends = np.cumsum(self.in_a)
        self.n_groups = np.diff(np.searchsorted(ends, np.cumsum(self.n_a), "right"), prepend=0)
        self.group_doc = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        self.n_links = np.zeros(len(self.n_a), np.int64)
        np.add.at(self.n_links, self.group_doc, self.in_a * self.in_b)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair of ids (A's times B's vocabulary, plus B's) and number of links."""
        begin_a, begin_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        large = self.in_a * self.in_b > LARGE_GROUP
        group = np.repeat(np.arange(len(self.in_a)), np.where(large, 0, self.in_a))
        token = spread(begin_a, np.where(large, 0, self.in_a))
        times = self.in_b[group]
        pairs = np.repeat(self.a[token].astype(np.int64) * self.size_b, times) + self.b[spread(begin_b[group], times)]
        docs, n = [np.repeat(self.group_doc[group], times)], [np.ones(len(pairs), np.int64)]
        pairs = [pairs]
        for g in np.flatnonzero(large):
            a, n_a = np.unique(self.a[begin_a[g] : begin_a[g] + self.in_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[begin_b[g] : begin_b[g] + self.in_b[g]], return_counts=True)
            pairs.append((a.astype(np.int64)[:, None] * self.size_b + b).reshape(-1))
            n.append((n_a[:, None] * n_b).reshape(-1))
            docs.append(np.full(len(pairs[-1]), self.group_doc[g]))
        return np.concatenate(docs), np.concatenate(pairs), np.concatenate(n)

    def distinct_pairs(self) -> np.ndarray:
        """Each document's pairs, once."""
        doc, pair, _ = self.links()
        return pd.unique(doc << 32 | pair) & np.int64(0xFFFFFFFF)

    def digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each text."""
        both = self.in_a + self.in_b
        begin = np.cumsum(both) - both
        ids = np.zeros(len(self.a) + len(self.b), np.uint16)
        ids[spread(begin, self.in_a)], ids[spread(begin + self.in_a, self.in_b)] = self.a, self.b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[begin + self.in_a - 1], mark[begin + both - 1] = ord("|"), ord(";")
        chars, shown = _DIGITS[ids], _SHOWN[ids]
        chars[:, 5] = mark
        ends = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        raw = memoryview(chars[shown])
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    def result(self, doc_ids: pa.Array, pairs: np.ndarray, counts: np.ndarray, best: np.ndarray) -> dict:
        """Columns of ``RESULT``, by a sorted table of pairs that has all of these."""
        doc, pair, n = self.links()
        codes, distinct = pd.factorize(pair)
        at = np.searchsorted(pairs, distinct)
        n_best, count_sum = np.zeros(len(self.n_a), np.int64), np.zeros(len(self.n_a), np.int64)
        if len(pair):
            np.add.at(count_sum, doc, counts[at][codes] * n)
            np.add.at(n_best, doc, np.where(best[at][codes], n, 0))
        return {
            "doc_id": doc_ids, "n_a": self.n_a, "n_b": self.n_b, "n_groups": self.n_groups, "n_links": self.n_links,
            "n_best": n_best, "count_sum": count_sum, "groups_sha256": self.digests(),
        }


def pair_counts(docs: DataFrame, paths: tuple[str, str], size_b: int, work: int = PIECE, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(pair, n, best): the documents that have a pair linked, and whether no other
    pair of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]):
        pair, held = Pair.of(paths), Container(np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in gathered(batches, limit=1 << 20):
            found = Aligned(pair, batch.column("text"), work).distinct_pairs()
            codes, distinct = pd.factorize(found)
            held.add(distinct, np.bincount(codes, minlength=len(distinct)))
            if len(held) > task_pairs:
                held.settle()
            if len(held) > task_pairs:
                yield {"pair": held.keys, "n": held.counts}
                held = Container(np.zeros(0, np.int64), np.zeros(0, np.int64))
        held.settle()
        yield {"pair": held.keys, "n": held.counts}

    counts = arrow_map(docs.select("text"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # An A id has at most as many pairs as B has ids.
    own = Window.partitionBy(F.expr(f"pair div {size_b}"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None, work: int = PIECE, broadcast_pairs: int = BROADCAST_PAIRS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``RESULT`` of each row of (doc_id, text)."""
    paths = paths or default_paths()
    spark = docs.sparkSession
    rows = narrow(docs, "doc_id", "text")
    known, _ = stored(pair_counts(rows, paths, Pair.of(paths).size_b, work), "pair-counts")
    if known.count() > broadcast_pairs:
        return by_blocks(rows, known, paths, work, block_bytes)
    table = known.toPandas().sort_values("pair")
    name, arrays = uuid.uuid4().hex, spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]):
        pair = Pair.of(paths)
        for batch in gathered(batches, limit=1 << 20):
            yield Aligned(pair, batch.column("text"), work).result(batch.column("doc_id"), *arrays.value)

    return arrow_map(rows, run, RESULT)


def by_blocks(rows: DataFrame, known: DataFrame, paths: tuple[str, str], work: int = PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As :func:`aligned`, where a block of documents asks for its pairs once. Blocks
    are dealt by content; one that much repeated rows make large is cut by salts, to
    each of which its pairs go."""
    _, text_bytes = row_bytes(rows)
    blocks = max(1, math.ceil(text_bytes / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("block").agg(F.ceil(F.sum(F.octet_length("text")) / (2 * block_bytes)).cast("int").alias("salts"))
    # At most one row for each two blocks of text.
    large, _ = stored(sizes.where("salts > 1"), "large-blocks")
    wanted = "block int, pair long"

    def ask(batches: Iterator[pa.RecordBatch]):
        pair = Pair.of(paths)
        for batch in gathered(batches, limit=1 << 20):
            doc, pairs, _ = Aligned(pair, batch.column("text"), work).links()
            keys = pd.unique(batch.column("block").to_numpy().astype(np.int64)[doc] << 32 | pairs)
            yield {"block": keys >> 32, "pair": keys & np.int64(0xFFFFFFFF)}

    asked = arrow_map(dealt.select("text", "block"), ask, wanted).distinct()
    every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    answers = asked.join(known, "pair").join(F.broadcast(large), "block", "left").select(F.col("block").alias("at"), every, "pair", "n", "best")
    salted = dealt.join(F.broadcast(large), "block", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    schema = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (f.split()[0] for f in RESULT.split(", "))])

    def answer(texts: pa.Table, table: pa.Table) -> pa.Table:
        pair, order = Pair.of(paths), np.argsort(table["pair"].to_numpy())
        arrays = [table[c].to_numpy()[order] for c in ("pair", "n", "best")]
        done = [as_batch(Aligned(pair, batch.column("text"), work).result(batch.column("doc_id"), *arrays), schema) for batch in gathered(texts.to_batches(), limit=1 << 20)]
        return pa.Table.from_batches(done, schema)

    return salted.groupBy("block", "salt").cogroup(answers.groupBy("at", "salt")).applyInArrow(answer, RESULT)
