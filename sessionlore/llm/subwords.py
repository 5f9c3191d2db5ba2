"""Token ids of whole texts, by encoding each distinct word once.

The tokenizer drops white space and never joins pieces across it, so the ids
of a text are the ids of its words in a row. A word is cut once more where an
ASCII letter meets ASCII punctuation (not an apostrophe), which is always a
border of the tokenizer's own pattern. A word that holds one of the tokenizer's
own special tokens stays whole, as it stands. Distinct units are encoded with the
``tokenizers`` library; a bounded table of them lives as long as the worker.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sessionlore.llm.textvec import SPACE, Words, buffer, factorized, ranges_hash, spread

#: Units that the table of a Python worker holds at most; beyond it starts anew.
TABLE_UNITS = 1_500_000

_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalpha()]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Subwords:
    _open: dict[str, Subwords] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(SPACE[b] for t in self.special for b in t):
            raise ValueError("special tokens with white space are not supported")
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    @classmethod
    def of(cls, path: str) -> Subwords:
        """One per Python worker and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    @staticmethod
    def units(texts: pa.Array, special: list[bytes] = ()) -> Words:
        data, offs = buffer(texts, lower=True)
        kind = _KIND[data]
        pair = kind[:-1] * 3 + kind[1:]
        cuts = np.flatnonzero((pair == 5) | (pair == 7)) + 1
        heads = np.zeros(len(data) + 1, bool)
        heads[offs] = True
        cuts = cuts[~heads[cuts]]
        if len(found := np.unique(np.concatenate([places(data, t) for t in special])) if special else ()):
            ends = np.union1d(np.flatnonzero(SPACE[data]), offs)
            begin, end = ends[np.searchsorted(ends, found, "right") - 1], ends[np.searchsorted(ends, found, "right")]
            inside = np.zeros(len(data) + 1, np.int64)
            np.add.at(inside, begin, 1)
            np.add.at(inside, end, -1)
            inside = np.cumsum(inside)[:-1] > 0
            raw, _ = buffer(texts)
            data = np.where(inside, raw, data)
            cuts = cuts[~inside[cuts]]
        return Words(data, offs, cuts)

    def lookup(self, units: Words, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows of the table for the distinct hashes ``h``; new ones are encoded."""
        if len(self.known) + len(h) > TABLE_UNITS:
            self.clear()
        row = np.searchsorted(self.known, h)
        fresh = np.ones(len(h), bool)
        inside = row < len(self.known)
        fresh[inside] = self.known[row[inside]] != h[inside]
        if fresh.any():
            at, length, pool = self.encoded([units.text(i) for i in first[fresh]])
            known = np.concatenate((self.known, h[fresh]))
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at = np.concatenate((self.at, at + len(self.pool)))[order]
            self.length = np.concatenate((self.length, length))[order]
            self.pool = np.concatenate((self.pool, pool))
            row = np.searchsorted(self.known, h)
        return row

    def encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, lengths and ids of units. Units that are one piece of the
        tokenizer's pattern (letters only, or ASCII punctuation) go joined by
        spaces; their ids end where a token has the end-of-word mark."""
        texts = [u.decode("utf-8", "replace") for u in units]
        plain = np.array([_one_piece(t) for t in texts], bool)
        length = np.zeros(len(texts), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        simple = np.flatnonzero(plain)
        for i in range(0, len(simple), 50_000):
            some = simple[i : i + 50_000]
            joined = [" ".join(texts[k] for k in some[j : j + 500]) for j in range(0, len(some), 500)]
            ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            flat = np.concatenate(ids) if ids else np.zeros(0, self.dtype)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) != len(some):
                raise ValueError("a unit is not one piece of the tokenizer's pattern")
            length[some] = np.diff(ends, prepend=0)
            parts.append(flat)
            order.append(some)
        other = np.flatnonzero(~plain)
        for i in range(0, len(other), 20_000):
            some = other[i : i + 20_000]
            ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False)]
            length[some] = [len(x) for x in ids]
            parts.append(np.concatenate(ids))
            order.append(some)
        at = np.zeros(len(texts), np.int64)
        if order:
            seen = np.concatenate(order)
            at[seen] = np.cumsum(length[seen]) - length[seen]
        return at, length, np.concatenate(parts) if parts else np.zeros(0, self.dtype)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids."""
        units = self.units(texts, self.special)
        if not len(units):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        codes, distinct, first = factorized(ranges_hash(units.data, units.start, units.end))
        row = self.lookup(units, distinct, first)[codes]
        length = self.length[row]
        ids = self.pool[spread(self.at[row], length)]
        return ids, np.bincount(units.doc, weights=length, minlength=units.n_docs).astype(np.int64)


def places(data: np.ndarray, token: bytes) -> np.ndarray:
    """Where ``token`` begins in ``data``."""
    at = np.flatnonzero(data[: max(0, len(data) - len(token) + 1)] == token[0])
    for k in range(1, len(token)):
        at = at[data[at + k] == token[k]]
    return at


def _one_piece(t: str) -> bool:
    if t.isascii():
        return t.isalpha() or not any(c.isalnum() or c == "'" or c < "!" or c > "~" for c in t)
    return t.isalpha() and max(t) < "ɐ" and "İ" not in t
