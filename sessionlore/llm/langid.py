"""Operator 7: language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
from a forward pass; that of a text is the product over its words and a
prior. Training is expectation-maximisation from one common start: the
forward-backward pass gives the expected number of uses of each piece in the
words of a language, over all training rows.

Words: lower-cased runs between white space, cut where an ASCII letter meets
ASCII punctuation; runs without a letter say nothing. A character of no piece
counts as one step of a small fixed probability. Pieces with capitals meet no
lower-cased word and are left out. A run of over 128 characters is cut where no
piece can span, so that the sum is still over all segmentations.

Nulls: a null text, or one without a letter, is ``und`` with score 0. Rows
whose lang is null train nothing. A null doc_id is kept, and trains nothing
where the id decides on training. With nothing to learn from, every text is
``und``. Repeated rows count each time; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, gathered
from sessionlore.llm.pieces import default_path
from sessionlore.llm.subwords import Subwords
from sessionlore.llm.textvec import factorized, ranges_hash
from sessionlore.llm.trie import LONG, MARK, Trie, length_groups, load_pieces

UNDETERMINED = "und"
UNKNOWN = 1e-7
#: A word's sums carry this factor for each character, to stay in range.
SCALE = 20.0
#: A long run's sums are brought back into range after so many characters.
RESCALED = 64
#: Share of the common start in each language's probabilities.
SMOOTH = 0.01
ROUNDS = 1
TABLE_UNITS = 400_000
MODEL_SCHEMA = "lang string, piece int, uses double"


class Segmenter:
    """Forward and backward sums over the segmentations of words."""

    _open: dict[str, Segmenter] = {}

    def __init__(self, path: str):
        pieces, score, _ = load_pieces(path)
        kept = [p if p == p.lower() else "" for p in pieces]
        self.trie = Trie(kept)
        self.n_pieces = len(kept)
        self.size = np.array([len(p) for p in kept], float)
        start = np.where([bool(p) for p in kept], np.exp(score), 0)
        self.start = start / start.sum()

    @classmethod
    def of(cls, path: str) -> Segmenter:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def scaled(self, p: np.ndarray) -> np.ndarray:
        return p * SCALE ** self.size[:, None]

    def forward(self, codes: np.ndarray, length: np.ndarray, q: np.ndarray):
        """``a[i, rows]``: scaled sums over all segmentations of the first i
        characters, for each column of ``q``; and the edges (from, length,
        rows, pieces) in the order of their starts."""
        n, width = codes.shape
        a = np.zeros((width + 1, n, q.shape[1]))
        a[0] = 1
        edges = []
        for i in range(width):
            single = np.zeros(n, bool)
            for k, rows, piece in self.trie.matches(codes, i):
                if k == 1:
                    single[rows] = True
                a[i + k, rows] += a[i, rows] * q[piece]
                edges.append((i, k, rows, piece))
            rows = np.flatnonzero(~single & (length > i))
            if len(rows):
                a[i + 1, rows] += a[i, rows] * (UNKNOWN * SCALE)
                edges.append((i, 1, rows, None))
        return a, edges

    def groups(self, words: list[str], columns: int):
        """Parts of words, and the words they are of, in groups of a like length;
        a long part is a group by itself, as a text."""
        spans, of = self.trie.parts(words)
        length = np.array([b - a for a, b in spans], np.int64)
        short = np.flatnonzero(length <= LONG)
        part = lambda i: words[of[i]][slice(*spans[i])]
        for some in length_groups(length[short], (1 << 20) // max(1, columns)):
            rows = short[some]
            yield *self.trie.matrix([part(i) for i in rows]), of[rows]
        for i in np.flatnonzero(length > LONG):
            yield part(i), None, of[i]

    def log_p(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word for each column of ``p``."""
        out, q = np.zeros((len(words), p.shape[1])), self.scaled(p)
        for codes, length, of in self.groups(words, p.shape[1]):
            if length is None:
                for c in range(p.shape[1]):
                    a, scale = chain(*self.steps(codes, q[:, c])[:3], len(codes))
                    out[of, c] += np.log(a[-1]) + scale[-1] - len(codes) * np.log(SCALE)
                continue
            a, _ = self.forward(codes, length, q)
            np.add.at(out, of, np.log(a[length, np.arange(len(of))]) - length[:, None] * np.log(SCALE))
        return out

    def steps(self, word: str, q: np.ndarray):
        """Begins, ends, factors and pieces of all steps through a long word."""
        begin, end, piece = self.trie.edges(word)
        return begin, end, np.where(piece >= 0, q[piece], UNKNOWN * SCALE), piece

    def uses(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece for each column of ``p``, when word w
        occurs ``weight[w]`` times."""
        total, q = np.zeros((self.n_pieces, p.shape[1])), self.scaled(p)
        for codes, length, of in self.groups(words, p.shape[1]):
            if length is None:
                n = len(codes)
                for c in np.flatnonzero(weight[of]):
                    begin, end, factor, piece = self.steps(codes, q[:, c])
                    a, up = chain(begin, end, factor, n)
                    # The way back is a chain through the mirrored word.
                    b, down = chain(n - end, n - begin, factor, n)
                    whole = np.log(a[-1]) + up[-1]
                    share = a[begin] * factor * b[n - end] * np.exp(up[begin] + down[n - end] - whole)
                    total[:, c] += np.bincount(piece[piece >= 0], weights=weight[of, c] * share[piece >= 0], minlength=self.n_pieces)
                continue
            a, edges = self.forward(codes, length, q)
            every = np.arange(len(of))
            b = np.zeros_like(a)
            b[length, every] = weight[of] / a[length, every]
            for i, k, rows, piece in reversed(edges):
                part = b[i + k, rows] * (UNKNOWN * SCALE if piece is None else q[piece])
                b[i, rows] += part
                if piece is not None:
                    part *= a[i, rows]
                    for c in range(p.shape[1]):
                        total[:, c] += np.bincount(piece, weights=part[:, c], minlength=self.n_pieces)
        return total


def chain(begin: np.ndarray, end: np.ndarray, factor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all ways from 0 to each place up to n: the true sum at place i
    is a[i] * exp(scale[i]). One pass over the steps."""
    order = np.argsort(begin, kind="stable")
    begin, end, factor = begin[order], end[order], factor[order]
    a, scale = [0.0] * (n + 1), np.zeros(n + 1)
    a[0] = 1.0
    borders = np.arange(0, n + RESCALED, RESCALED)
    cuts = np.searchsorted(begin, borders).tolist()
    for at, i, j in zip(borders[1:].tolist(), cuts, cuts[1:], strict=False):
        for s, e, x in zip(begin[i:j].tolist(), end[i:j].tolist(), factor[i:j].tolist(), strict=True):
            a[e] += a[s] * x
        if at < n:
            top = max(a[at : at + RESCALED])
            a[at : at + RESCALED] = [x / top for x in a[at : at + RESCALED]]
            scale[at:] += np.log(top)
    return np.array(a), scale


def spelled(units, some: np.ndarray) -> list[str]:
    """Lower-cased units behind the marker; '' for one without a letter."""
    out = []
    for i in some.tolist():
        t = units.text(i).decode("utf-8", "replace").lower()
        out.append(MARK + t if any(map(str.isalpha, t)) else "")
    return out


def expected_uses(docs: DataFrame, path: str, langs: list[str], p: np.ndarray) -> DataFrame:
    """(lang, piece, uses) summed over the words of all rows of (text, lang)."""
    column = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]):
        segmenter = Segmenter.of(path)
        words: dict[str, int] = {}
        weight = np.zeros((0, len(langs)))
        total = np.zeros((segmenter.n_pieces, len(langs)))
        for batch in gathered(batches):
            units, codes, distinct, first = units_of(batch.column("text"))
            lang = np.array([column[x] for x in batch.column("lang").to_pylist()], np.int64)
            seen = np.bincount(codes * len(langs) + lang[units.doc], minlength=len(distinct) * len(langs)).reshape(-1, len(langs))
            texts = spelled(units, first)
            for t in texts:
                words.setdefault(t, len(words))
            weight = np.concatenate((weight, np.zeros((len(words) - len(weight), len(langs)))))
            np.add.at(weight, [words[t] for t in texts], seen)
            if len(words) > TABLE_UNITS:
                total += segmenter.uses(list(words), weight * np.array([bool(w) for w in words])[:, None], p)
                words, weight = {}, np.zeros((0, len(langs)))
        total += segmenter.uses(list(words), weight * np.array([bool(w) for w in words], bool)[:, None], p)
        at, k = np.nonzero(total)
        yield {"lang": [langs[c] for c in k], "piece": at, "uses": total[at, k]}

    return arrow_map(docs.select("text", "lang"), run, MODEL_SCHEMA).groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))


def units_of(texts: pa.Array):
    units = Subwords.units(texts)
    if not len(units):
        return units, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return units, *factorized(ranges_hash(units.data, units.start, units.end))


class Model:
    """Languages, log priors, and piece probabilities (a column each)."""

    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray):
        self.langs, self.prior, self.p = langs, prior, p


def train(docs: DataFrame, path: str | None = None) -> Model | None:
    """Learn from all rows of (text, lang) with a lang and a text."""
    path = path or default_path()
    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    n = np.array([counts[x] for x in langs], float)
    segmenter = Segmenter.of(path)
    p = np.repeat(segmenter.start[:, None], len(langs), 1)
    for _ in range(ROUNDS):
        total = np.zeros_like(p)
        # At most a row for each piece of the fixed vocabulary and language.
        found = expected_uses(rows, path, langs, p).toPandas()
        total[found["piece"], found["lang"].map({x: k for k, x in enumerate(langs)})] = found["uses"]
        p = (1 - SMOOTH) * total / np.maximum(total.sum(0), 1e-300) + SMOOTH * segmenter.start[:, None]
    return Model(langs, np.log(n / n.sum()), p)


def predict(docs: DataFrame, model: Model | None, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, lang_pred and score (the posterior
    probability of that language) for each row."""
    path = path or default_path()
    kept = docs.select("doc_id", "text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]):
        segmenter = Segmenter.of(path)
        known: dict[int, int] = {}
        table = np.zeros((0, len(model.langs) + 1 if model else 1))
        for batch in gathered(batches):
            n_docs = batch.num_rows
            names, score = np.full(n_docs, UNDETERMINED, object), np.zeros(n_docs)
            if model:
                units, codes, distinct, first = units_of(batch.column("text"))
                if len(known) + len(distinct) > TABLE_UNITS:
                    known, table = {}, table[:0]
                hashes = distinct.tolist()
                fresh = np.array([h not in known for h in hashes], bool)
                texts = spelled(units, first[fresh])
                lettered = np.array([bool(t) for t in texts], bool)
                values = np.zeros((len(texts), len(model.langs) + 1))
                values[lettered, :-1] = segmenter.log_p([t for t in texts if t], model.p)
                values[lettered, -1] = 1
                known.update((h, len(table) + k) for k, h in enumerate(h for h, f in zip(hashes, fresh.tolist(), strict=True) if f))
                table = np.concatenate((table, values))
                row = np.array([known[h] for h in hashes], np.int64)[codes]
                sums = np.column_stack([np.bincount(units.doc, weights=table[row, c], minlength=n_docs) for c in range(table.shape[1])])
                total = sums[:, :-1] + model.prior
                best = total.argmax(1)
                some = sums[:, -1] > 0
                names[some] = np.array(model.langs, object)[best[some]]
                score[some] = (1 / np.exp(total - total.max(1, keepdims=True)).sum(1))[some]
            yield {c: batch.column(c) for c in ("doc_id", *keep)} | {"lang_pred": names, "score": score}

    return arrow_map(kept, run, f"{schema}, lang_pred string, score double")


def is_held_out(doc_id: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """The rows whose crc32 of the id as text leaves ``part``; a null id is no
    training row either, and is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
