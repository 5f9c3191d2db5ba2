"""Operator 9: unigram Viterbi encoding over a double-array trie, and decoding.

White space becomes the marker U+2581, one marker is put before the text, and
the segmentation with the highest sum of log scores is chosen (of equal ones,
that whose last pieces are longer). A character of no piece counts as one
unknown step and is written as its UTF-8 bytes; so is a marker that the text
itself holds, and the round trip is exact. A unit of over 128 characters (a text
without spaces) is cut where no piece can span, which changes nothing.

Only spaces join the marker; no piece has a marker behind a letter, so a text
is cut before each run of spaces and around line ends, and each distinct unit
is segmented once.

Nulls: a null text is encoded like an empty one (a single marker). A null
doc_id is kept, repeated ids keep their rows, no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sessionlore.llm.common import arrow_map, gathered, narrow
from sessionlore.llm.textvec import buffer, factorized, ranges_hash, spread
from sessionlore.llm.tokens import crc32s, packed
from sessionlore.llm.trie import LONG, MARK, Trie, length_groups, load_pieces

#: What an unknown character costs beyond the least piece.
UNKNOWN = 10.0
TABLE_UNITS = 1_500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    _open: dict[str, Pieces] = {}

    def __init__(self, path: str):
        self.text, self.score, byte_ids = load_pieces(path)
        self.byte_id = np.array([byte_ids[f"<0x{b:02X}>"] for b in range(256)], np.int64)
        self.trie = Trie(self.text)
        self.unknown = float(self.score[np.isfinite(self.score)].min()) - UNKNOWN
        raw = [t.replace(MARK, " ").encode() for t in self.text]
        for b in range(256):
            raw[self.byte_id[b]] = bytes([b])
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.clear()

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    @staticmethod
    def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a space before each text; starts, ends and documents of
        the units; and the offsets."""
        data, offs = buffer(texts)
        n = len(offs) - 1
        lead = np.empty(len(data) + n, np.uint8)
        begin = offs[:-1] + np.arange(n)
        lead[begin] = 0x20
        rest = np.ones(len(lead), bool)
        rest[begin] = False
        lead[rest] = data
        space, line = lead == 0x20, lead == 0x0A
        first = np.zeros(len(lead), bool)
        first[begin] = True
        first[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start = np.flatnonzero(first)
        end = np.append(start[1:], len(lead))
        return lead, start, end, np.searchsorted(begin, start, "right") - 1, offs

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the number of each text's ids, and how
        many of these are bytes."""
        n_docs = len(texts)
        if not n_docs:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, start, end, doc, _ = self.units(texts)
        codes, distinct, first = factorized(ranges_hash(data, start, end))
        row = self.lookup(data, start, end, distinct, first)[codes]
        length = self.length[row]
        ids = self.pool[spread(self.at[row], length)]
        n = np.bincount(doc, weights=length, minlength=n_docs).astype(np.int64)
        is_byte = np.zeros(len(self.text), bool)
        is_byte[self.byte_id] = True
        sums = np.concatenate(([0], np.cumsum(is_byte[ids])))
        ends = np.cumsum(n)
        return ids, n, sums[ends] - sums[ends - n]

    def lookup(self, data, start, end, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(self.keys) + len(h) > TABLE_UNITS:
            self.clear()
        row = np.searchsorted(self.keys, h)
        fresh = np.ones(len(h), bool)
        inside = row < len(self.keys)
        fresh[inside] = self.keys[row[inside]] != h[inside]
        if fresh.any():
            some = first[fresh]
            units = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            at, length, pool = self.segmented(units)
            keys = np.concatenate((self.keys, h[fresh]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], np.concatenate((self.at, at + len(self.pool)))[order]
            self.length, self.pool = np.concatenate((self.length, length))[order], np.concatenate((self.pool, pool))
            row = np.searchsorted(self.keys, h)
        return row

    def segmented(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, lengths and ids of units, whose spaces are markers."""
        # A marker of the text itself must not look like a space: no code.
        marked = [u.replace(MARK, "￿").replace(" ", MARK) for u in units]
        spans, of = self.trie.parts(marked)
        where = np.array([b - a for a, b in spans], np.int64)
        at, length, parts, total = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64), [], 0
        cut = lambda texts, i: texts[of[i]][slice(*spans[i])]
        short = np.flatnonzero(where <= LONG)
        groups = [*(short[g] for g in length_groups(where[short])), *np.flatnonzero(where > LONG).reshape(-1, 1)]
        for rows in groups:
            found = [cut(marked, i) for i in rows], [cut(units, i) for i in rows]
            ids, n = self.viterbi(*found) if where[rows[0]] <= LONG else self.walked(found[0][0], found[1][0])
            at[rows] = total + np.cumsum(n) - n
            length[rows] = n
            parts.append(ids)
            total += len(ids)
        pool = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        n = np.bincount(of, weights=length, minlength=len(units)).astype(np.int64)
        return np.cumsum(n) - n, n, pool[spread(at, length)]

    def walked(self, word: str, raw: str) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`viterbi` for one long word, in time in proportion to it."""
        begin, end, piece = self.trie.edges(word)
        step = np.where(piece >= 0, self.score[piece], self.unknown)
        best, came = [-np.inf] * (len(word) + 1), [0] * (len(word) + 1)
        best[0] = 0.0
        for k, (a, b, x) in enumerate(zip(begin.tolist(), end.tolist(), step.tolist(), strict=True)):
            if best[a] + x > best[b]:
                best[b], came[b] = best[a] + x, k
        place, path = len(word), []
        while place:
            path.append(came[place])
            place = int(begin[came[place]])
        path.reverse()
        ids: list[int] = []
        for k in path:
            ids += [int(piece[k])] if piece[k] >= 0 else self.byte_id[np.frombuffer(raw[begin[k]].encode(), np.uint8)].tolist()
        return np.array(ids, np.int32), np.array([len(ids)])

    def viterbi(self, words: list[str], raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and each word's number of ids; bytes of
        unknown characters are those of ``raw``."""
        codes, length = self.trie.matrix(words)
        n, width = codes.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, width + 1), np.int32)
        piece_at = np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            single = np.zeros(n, bool)
            for k, rows, piece in self.trie.matches(codes, i):
                if k == 1:
                    single[rows] = True
                value = best[rows, i] + self.score[piece]
                better = value > best[rows, i + k]
                rows = rows[better]
                best[rows, i + k] = value[better]
                came[rows, i + k] = i
                piece_at[rows, i + k] = piece[better]
            rows = np.flatnonzero(~single & (length > i))
            value = best[rows, i] + self.unknown
            rows, value = rows[(better := value > best[rows, i + 1])], value[better]
            best[rows, i + 1], came[rows, i + 1], piece_at[rows, i + 1] = value, i, -1
        # Back from the end of each word.
        row, place = np.arange(n), length.copy()
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            alive = place > 0
            row, place = row[alive], place[alive]
            before = came[row, place]
            steps.append((row, before, piece_at[row, place]))
            place = before.astype(np.int64)
        rows, begins, pieces = [np.concatenate(x) for x in zip(*steps, strict=True)]
        order = np.lexsort((begins, rows))
        rows, begins, pieces = rows[order], begins[order], pieces[order]
        if (unknown := np.flatnonzero(pieces < 0)).size:
            chars = [raw[r][b].encode() for r, b in zip(rows[unknown].tolist(), begins[unknown].tolist(), strict=True)]
            size = np.ones(len(pieces), np.int64)
            size[unknown] = [len(c) for c in chars]
            rows, pieces = np.repeat(rows, size), np.repeat(pieces, size)
            pieces[pieces < 0] = self.byte_id[np.frombuffer(b"".join(chars), np.uint8)]
        return pieces.astype(np.int32), np.bincount(rows, minlength=n)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in a row, and each text's number of bytes."""
        size = self.raw_length[ids]
        data = self.raw[spread(self.raw_at[ids], size)]
        sums = np.concatenate(([0], np.cumsum(size)))
        ends = np.cumsum(n)
        length = sums[ends] - sums[ends - n]
        keep = np.ones(len(data), bool)
        keep[(np.cumsum(length) - length)[length > 0]] = False  # the marker before the text
        return data[keep], np.maximum(length - 1, 0)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, n_byte_pieces), ids in packed 32-bit numbers."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]):
        coder = Pieces.of(path)
        for batch in gathered(batches):
            ids, n, n_bytes = coder.encode(batch.column("text"))
            yield {"doc_id": batch.column("doc_id"), "ids": packed(ids.astype("<u4"), n), "n_pieces": n, "n_byte_pieces": n_bytes}

    return arrow_map(narrow(docs, "doc_id", "text"), run, "doc_id long, ids binary, n_pieces long, n_byte_pieces long")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of :func:`encode`."""
    from sessionlore.llm.tokens import unpacked

    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]):
        coder = Pieces.of(path)
        for batch in gathered(batches, "ids"):
            n = pa.compute.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            data, length = coder.decode(unpacked(batch.column("ids"), np.dtype("<u4")), n)
            yield {"doc_id": batch.column("doc_id"), "text": packed(data, length).cast(pa.large_string())}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of encoding each whole text and decoding it again."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]):
        coder = Pieces.of(path)
        for batch in gathered(batches):
            texts = batch.column("text")
            ids, n, n_bytes = coder.encode(texts)
            data, length = coder.decode(ids, n)
            raw, offs = buffer(texts)
            ends = np.cumsum(length)
            same = [
                k == b - a and data[e - k : e].tobytes() == raw[a:b].tobytes()
                for e, k, a, b in zip(ends.tolist(), length.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)
            ]
            yield {"doc_id": batch.column("doc_id"), "n_pieces": n, "n_byte_pieces": n_bytes, "ids_crc32": crc32s(ids.astype("<u4"), n), "n_bytes": length, "round_trip": same}

    return arrow_map(narrow(docs, "doc_id", "text"), run, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, n_bytes long, round_trip boolean")
