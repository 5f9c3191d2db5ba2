"""Operator 8: language-model scoring with causal self-attention, in numpy.

The model reads subword ids. One head of masked self-attention looks back
over the window; its sum, and the last id's own vector, are the context of the
next subword. That context gives the probabilities of classes, and, by an
output vector for each member, those of a class's members: two softmaxes, and
both depend on the context. The most frequent subwords are classes of their own; the
others are in classes by frequency. Windows of 2 * STEP ids overlap by half: each
scores its second half, so every id is scored once, with STEP to 2 * STEP - 1
ids of context (fewer at the beginning).

The weights are trained on all training texts, in windows end to end, so that
every id is a target once. Parts of the data train copies side by side, whose weights are
averaged, twice with one part and up to MOST_ROUNDS times with many; a
round takes the texts of its turn, so that all rounds together are one pass
over every window.

Beside it stands a unigram base score over words with add-half smoothing. Its
count table has a row per word and is joined in blocks of documents, each
asking for its distinct words only; words that very many blocks ask for are
broadcast, a bounded number of them.

Nulls: a null text is empty and has only its end. A row with a null doc_id is
scored, and trains nothing; it is not held out. Repeated rows each count.
Subwords that no training text has share one probability. Without training
texts every subword is as likely as any other. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, as_batch, gathered, one_blas_thread, row_bytes, slices, stored
from sessionlore.llm.langid import is_held_out
from sessionlore.llm.subwords import Subwords, default_path
from sessionlore.llm.textvec import Words, buffer, factorized, spread
from sessionlore.llm.tokens import packed, unpacked

STEP, WIDTH = 16, 32
DIM, OWN_CLASS, OWN_ROW = 16, 24, 4096
ROUNDS, MOST_ROUNDS, BATCH, RATE = 2, 8, 256, 0.03
#: Contexts, and windows, that are worked on at a time.
CHUNK, CHUNK_WINDOWS, SCORED_WINDOWS = 1024, 32, 2048
BLOCK_BYTES = 16 << 20
PART_WINDOWS = 200_000
#: Weights of so many parts are added up in one task.
ADDED_PARTS = 32
#: At most so many words that many blocks ask for are broadcast.
HEAD_WORDS = 1_000_000
U2 = np.dtype("<u2")
F4 = np.float32


def is_training(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~is_held_out(doc_id, 5, 1)


class Vocabulary:
    """Symbols, classes and input rows of the ids 0..size-1, and of the marks
    for begin, end and nothing (size, size + 1, size + 2). The symbols are
    the ids that occur, the end, and one that stands for all other ids;
    ``first[c]:first[c + 1]`` are the symbols of class c."""

    def __init__(self, counts: np.ndarray, end_count: int):
        self.size = len(counts)
        used = np.flatnonzero(counts)
        unseen = self.size - len(used)
        n = np.concatenate((counts[used] + 0.5, [end_count + 0.5, max(0.5 * unseen, 1e-3)]))
        order = np.argsort(-n, kind="stable")
        n, m = n[order], len(n)
        own = min(OWN_CLASS, m)
        rest = n[own:]
        # A class costs 1, and P * k for its k members of mass P: least for equal sums
        # of roots, and as many classes as these sums have in all.
        root = np.sqrt(rest / n.sum())
        self.n_classes = max(48, own + round(root.sum()))
        share = (np.cumsum(root) - root / 2) / max(root.sum(), 1e-9)
        cls = np.concatenate((np.arange(own), own + (share * (self.n_classes - own)).astype(np.int64)))
        self.first = np.searchsorted(cls, np.arange(self.n_classes + 1))
        members = np.diff(self.first)
        self.large, self.several = np.flatnonzero(members > 1), np.repeat(members > 1, members)[:, None]
        symbol = np.full(self.size + 3, int(np.flatnonzero(order == m - 1)[0]))
        symbol[np.concatenate((used, [self.size + 1]))[order[order < m - 1]]] = np.flatnonzero(order < m - 1)
        self.cls, self.place = cls[symbol], (np.arange(m) - self.first[cls])[symbol]
        self.row = np.where(symbol < OWN_ROW, symbol, OWN_ROW + self.cls)
        self.n_rows = OWN_ROW + self.n_classes + 2 if m > OWN_ROW else m + 2
        self.row[self.size], self.row[self.size + 2] = self.n_rows - 2, self.n_rows - 1
        #: Log of what each of the ids behind one symbol has of it.
        self.share = np.zeros(self.size + 3, F4)
        self.share[: self.size][counts == 0] = -math.log(max(1, unseen))
        mass = np.bincount(cls, weights=n, minlength=self.n_classes)
        self.bias = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(F4)
        self.inner_bias = np.log(n / mass[cls]).astype(F4)

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        square = (DIM, DIM)
        return {"e": (self.n_rows, DIM), "q": square, "k": square, "v": square, "b": (WIDTH,), "o": (DIM, self.n_classes), "c": (self.n_classes,), "u": (len(self.inner_bias), DIM), "d": (len(self.inner_bias),)}


#: Distance from query to key, for the last 1, 2, ... places of a window as queries.
_APART = {n: (WIDTH - n + np.arange(n))[:, None] - np.arange(WIDTH) for n in (STEP, WIDTH)}


def fresh(vocabulary: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights before training; the outputs are the frequencies alone."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * (0.1 if k == "e" else 0.25)).astype(F4) for k, s in vocabulary.shapes.items()}
    w["b"], w["c"], w["d"] = -0.05 * np.arange(WIDTH, dtype=F4), vocabulary.bias.copy(), vocabulary.inner_bias.copy()
    w["o"], w["u"] = np.zeros_like(w["o"]), np.zeros_like(w["u"])
    return w


def flat(t: np.ndarray) -> np.ndarray:
    return t.reshape(-1, t.shape[-1])


def apart_bias(w: dict[str, np.ndarray], n: int) -> np.ndarray:
    """What the distance adds, for the last ``n`` places of a window as queries."""
    return np.where(_APART[n] < 0, F4(-1e9), w["b"][np.maximum(_APART[n], 0)])


def joined(w: dict[str, np.ndarray]) -> np.ndarray:
    """Weights of query, key and value in one matrix (queries are divided by the
    root of DIM), with a last column for ones."""
    q = w["q"] * w["q"].dtype.type(1 / math.sqrt(DIM))
    return np.concatenate((q, w["k"], w["v"], np.zeros_like(q[:, :1])), 1)


def weighted(z: np.ndarray, values: np.ndarray, steep: bool) -> np.ndarray:
    """Exponentials of ``z``, put in its place, and their products with ``values``,
    whose last column is of ones: the sums. ``steep`` subtracts the greatest before."""
    if steep:
        z -= z.max(-1, keepdims=True)
    return np.exp(z, out=z) @ values


def in_range(totals: np.ndarray) -> bool:
    """Whether no sum of exponentials came near the ends of the numbers' range."""
    return bool(totals.min(initial=1) > 1e-30 and totals.max(initial=1) < 1e30)


def looked(q: np.ndarray, k: np.ndarray, v1: np.ndarray, bias: np.ndarray, short=(), nothing=None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the keys before they are divided by their sums, and the sums of
    values and shares; ``short`` are the windows with ``nothing`` in some places."""
    for steep in (False, True):
        s = q @ k.transpose(0, 2, 1)
        s += bias
        if len(short):
            s[short] += np.where(nothing[short, None, :], F4(-1e9), F4(0))
        found = weighted(s, v1, steep)
        if in_range(found[..., DIM]):
            break
    return s, found


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones_like(x[:, :1])), 1)


def predicted(w: dict[str, np.ndarray], vocabulary: Vocabulary, h: np.ndarray, y: np.ndarray, gradient: dict | None = None, steep: bool = False) -> np.ndarray:
    """Log probability of each id ``y`` after its context ``h``; with
    ``gradient``, that of the mean negative log probability is put there."""
    order = np.argsort(vocabulary.cls.astype(U2).take(y), kind="stable")  # 16 bits sort by radix
    sorted_y = y.take(order)
    cls, place = vocabulary.cls.take(sorted_y), vocabulary.place.take(sorted_y)
    ends = np.searchsorted(cls, np.arange(vocabulary.n_classes + 1))
    # A last component of one brings the biases into the products.
    near = with_ones(h.take(order, 0))
    outer, inner = np.concatenate((w["o"], w["c"][None])), np.concatenate((w["u"], w["d"][:, None]), 1)
    if gradient is None:
        outer_back, inner_back = np.ones_like(outer[:1].T), np.ones_like(inner[:, :1])
    else:
        outer_back, inner_back = with_ones(w["o"].T), with_ones(w["u"])
        d_outer, d_inner, dh = np.zeros_like(outer), np.zeros_like(inner), np.empty_like(h)
    scale = h.dtype.type(1 / max(1, len(y)))
    # Exponentials of the targets and sums of all, over classes and over members.
    p, totals = np.ones((2, len(y)), h.dtype), np.ones((2, len(y)), h.dtype)
    every = np.arange(max(CHUNK, np.diff(ends).max(initial=0)))
    for i in range(0, len(y), CHUNK):
        here = slice(i, i + CHUNK)
        some = near[here]
        z = some @ outer
        found = weighted(z, outer_back, steep)
        at = every[: len(some)], cls[here]
        p[0, here], totals[0, here] = z[at], found[:, -1]
        if gradient is not None:
            share = scale / found[:, -1:]
            z *= share
            z[at] -= scale
            d_outer += some.T @ z
            np.multiply(found[:, :DIM], share, out=dh[here])
    for c in vocabulary.large[np.diff(ends)[vocabulary.large] > 0].tolist():
        here, members = slice(ends[c], ends[c + 1]), slice(vocabulary.first[c], vocabulary.first[c + 1])
        some = near[here]
        z = some @ inner[members].T
        found = weighted(z, inner_back[members], steep)
        at = every[: len(some)], place[here]
        p[1, here], totals[1, here] = z[at], found[:, -1]
        if gradient is not None:
            share = scale / found[:, -1:]
            z *= share
            z[at] -= scale
            np.matmul(z.T, some, out=d_inner[members])
            found *= share
            dh[here] += found[:, :DIM]
    if not steep and not in_range(totals):
        return predicted(w, vocabulary, h, y, gradient, True)
    back = np.empty_like(order)
    back[order] = np.arange(len(y))
    if gradient is not None:
        of_target = (w["u"] * vocabulary.several).take(vocabulary.first.take(cls) + place, 0)
        of_target += w["o"].T.take(cls, 0)
        of_target *= scale
        dh -= of_target
        gradient |= {"o": d_outer[:DIM], "c": d_outer[DIM], "u": d_inner[:, :DIM], "d": d_inner[:, DIM], "h": dh.take(back, 0)}
    p /= np.maximum(totals, totals.dtype.type(1e-30))
    return np.log(np.maximum(p[0] * p[1], 1e-37)).take(back) + vocabulary.share.take(y)


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def gradient(w: dict[str, np.ndarray], vocabulary: Vocabulary, part: np.ndarray):
    """Mean loss over all targets of windows of ids, end to end, and its gradient.
    Nothing stands behind the end only, where no target looks."""
    x, y = vocabulary.row.take(part[:, :-1]), part[:, 1:].reshape(-1)
    counted = np.flatnonzero(y != vocabulary.size + 2)
    all_three, bias, g = joined(w), apart_bias(w, WIDTH), {}
    e = w["e"].take(x, 0)
    h, context, kept = np.empty_like(e), np.empty_like(e), []
    # Some windows at a time stay in the cache.
    pieces = [slice(i, i + CHUNK_WINDOWS) for i in range(0, len(x), CHUNK_WINDOWS)]
    for i in pieces:
        qkv = (flat(e[i]) @ all_three).reshape(*e[i].shape[:2], -1)
        qkv[..., -1] = 1
        q, k, v1 = qkv[..., :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
        a, found = looked(q, k, v1, bias)
        part_of_one = 1 / np.maximum(found[..., DIM:], found.dtype.type(1e-30))
        np.multiply(found[..., :DIM], part_of_one, out=context[i])
        kept.append((q, k, v1, a, part_of_one))
        np.tanh(context[i] + e[i], out=h[i])
    loss = -predicted(w, vocabulary, flat(h).take(counted, 0), y.take(counted), g).mean()
    dh = np.zeros_like(h)
    flat(dh)[counted] = g.pop("h")
    de, d_three, d_bias = np.empty_like(e), np.zeros_like(all_three[:, :-1]), np.zeros_like(bias)
    for i, (q, k, v1, a, part_of_one) in zip(pieces, kept, strict=True):
        square = h[i] * h[i]
        np.subtract(1, square, out=square)
        d = np.multiply(dh[i], square, out=dh[i])
        d1 = np.empty_like(v1, order="C")
        np.multiply(d, part_of_one, out=d1[..., :DIM])
        np.multiply(np.matmul(d * context[i], np.full((DIM, 1), -1, d.dtype)), part_of_one, out=d1[..., DIM:])
        d3 = np.empty((*d.shape[:2], 3 * DIM), d.dtype)
        np.matmul(a.transpose(0, 2, 1), d1[..., :DIM], out=d3[..., 2 * DIM :])
        ds = np.multiply(a, d1 @ v1.transpose(0, 2, 1), out=a)
        d_bias += ds.sum(0)
        np.matmul(ds, k, out=d3[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=d3[..., DIM : 2 * DIM])
        d_three += flat(e[i]).T @ flat(d3)
        np.add((flat(d3) @ all_three[:, :-1].T).reshape(d.shape), d, out=de[i])
    g["b"] = np.bincount(np.maximum(_APART[WIDTH], 0).reshape(-1), weights=d_bias.reshape(-1), minlength=WIDTH).astype(h.dtype)
    g["q"], g["k"], g["v"] = np.split(d_three, 3, axis=1)
    g["q"] = g["q"] * h.dtype.type(1 / math.sqrt(DIM))
    rows = x.reshape(-1).astype(U2)
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    g["e"] = np.zeros_like(w["e"])
    g["e"][rows.take(heads)] = np.add.reduceat(flat(de).take(order, 0), heads, axis=0)
    return loss, g


def windows(ids: np.ndarray, n: np.ndarray, vocabulary_size: int, keep=None, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Windows of WIDTH + 1 ids (the last ``step`` are targets), and the text of
    each. ``keep(text, number)`` chooses windows."""
    begin, end, none = vocabulary_size, vocabulary_size + 1, vocabulary_size + 2
    length = n + 2
    full = np.full(int(length.sum()) + WIDTH + 1, none, np.int64)
    at = np.cumsum(length) - length
    full[at], full[at + length - 1] = begin, end
    full[spread(at + 1, n)] = ids
    count = -(-(n + 1) // step)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    if keep is not None:
        chosen = keep(text, number)
        text, number = text[chosen], number[chosen]
    place = (step * (number + 1) - WIDTH)[:, None] + np.arange(WIDTH + 1)
    inside = (place >= 0) & (place < length[text][:, None])
    return np.where(inside, full[np.where(inside, place + at[text][:, None], 0)], none), text


@np.errstate(over="ignore", invalid="ignore", divide="ignore")
def text_log_p(w: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural log probability of each text and its end."""
    total = np.zeros(len(n))
    seen, text = windows(ids, n, vocabulary.size)
    none = vocabulary.size + 2
    # One row of the input has one query, key and value wherever it stands.
    qkv = w["e"] @ joined(w)
    qkv[:, -1] = 1
    q, k, v1 = [np.ascontiguousarray(c) for c in np.split(qkv, (DIM, 2 * DIM), axis=1)]
    bias = apart_bias(w, STEP)
    for i in range(0, len(seen), SCORED_WINDOWS):
        part = seen[i : i + SCORED_WINDOWS]
        x, y, nothing = vocabulary.row.take(part[:, :-1]), part[:, -STEP:].reshape(-1), part[:, :-1] == none
        short = nothing.any(1)
        h = w["e"].take(x[:, -STEP:], 0)
        for j in range(0, len(x), CHUNK_WINDOWS):
            here = slice(j, j + CHUNK_WINDOWS)
            keys = x[here]
            _, found = looked(q.take(keys[:, -STEP:], 0), k.take(keys, 0), v1.take(keys, 0), bias, np.flatnonzero(short[here]), nothing[here])
            found /= np.maximum(found[..., DIM:], found.dtype.type(1e-30))
            h[here] += found[..., :DIM]
            np.tanh(h[here], out=h[here])
        counted = np.flatnonzero(y != none)
        p = predicted(w, vocabulary, flat(h).take(counted, 0), y.take(counted))
        total += np.bincount(text[i + counted // STEP], weights=p, minlength=len(n))
    return total


def trained(w: dict[str, np.ndarray], vocabulary: Vocabulary, parts: Iterator[np.ndarray], rate: float = RATE) -> tuple[dict[str, np.ndarray], int]:
    """Adam over arrays of windows; the weights after, and how many were seen."""
    # All weights lie in one array, so that a step has few operations.
    x = np.concatenate([a.reshape(-1) for a in w.values()])
    cuts = np.cumsum([a.size for a in w.values()])[:-1]
    w = {k: a.reshape(w[k].shape) for k, a in zip(w, np.split(x, cuts), strict=True)}
    m, s, square = np.zeros_like(x), np.zeros_like(x), np.empty_like(x)
    seen, step = 0, 0
    for part in parts:
        for i in range(0, len(part), BATCH):
            _, by_name = gradient(w, vocabulary, part[i : i + BATCH])
            step, seen = step + 1, seen + len(part[i : i + BATCH])
            g = np.concatenate([by_name[k].reshape(-1) for k in w])
            # Sums of gradients and squares; their weights 0.1 and 0.001 are in the pace.
            m *= F4(0.9)
            m += g
            s *= F4(0.999)
            s += np.square(g, out=square)
            wide = math.sqrt(0.001 / (1 - 0.999**step))
            root = np.sqrt(s, out=g)
            root += F4(1e-7 / wide)
            np.divide(m, root, out=root)
            root *= F4(0.1 * rate / (1 + step / 2000) / (1 - 0.9**step) / wide)
            x -= root
    return w, seen


def coded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(row, doc_id, training, text, w): rows of (doc_id, text, training) with a
    number and the packed ids of their texts, stored, so that each text is encoded
    once and its parts are read where they are needed."""

    def read(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        coder, row = Subwords.of(path), TaskContext.get().partitionId() << 33
        for batch in gathered(batches):
            k = batch.num_rows
            ids, n = coder.encode(batch.column("text")) if with_ids else (np.zeros(0), np.zeros(k, np.int64))
            yield {c: batch.column(c) for c in ("doc_id", "training", "text")} | {"row": row + np.arange(k), "w": packed(ids.astype(U2), n)}
            row += k

    return stored(arrow_map(docs.select("doc_id", "text", "training"), read, "row long, doc_id long, training boolean, text string, w binary"), "coded-texts")[0]


def rounds_of(parts: int) -> int:
    """How often copies are averaged in the single pass over all windows: more of them
    drift apart sooner; but a round needs some ten thousand windows for each copy."""
    return min(MOST_ROUNDS, ROUNDS + 2 * (parts - 1).bit_length())


def fit(rows: DataFrame, size: int, part_windows: int = PART_WINDOWS, rounds: int | None = None) -> tuple[dict[str, np.ndarray], Vocabulary]:
    """Weights and vocabulary from all rows (row, w) of packed ids below ``size``. A
    copy of the weights learns from about ``part_windows`` windows; ``rounds`` are
    averages of the copies, :func:`rounds_of` their number by default."""
    texts = rows.select("row", "w")

    def count(batches: Iterator[pa.RecordBatch]):
        counts, n, n_windows = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            counts += np.bincount(unpacked(batch.column("w"), U2), minlength=size)
            n, n_windows = n + batch.num_rows, n_windows + int(n_training_windows(batch).sum())
        used = np.flatnonzero(counts)
        yield {"id": [*used.tolist(), -1, -2], "n": [*counts[used].tolist(), n, n_windows]}

    # At most as many rows as the vocabulary has ids.
    found = {r["id"]: r["n"] for r in arrow_map(texts, count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    counts = np.zeros(size, np.int64)
    for i, n in found.items():
        if i >= 0:
            counts[i] = n
    vocabulary = Vocabulary(counts, found.get(-1, 0))
    w = fresh(vocabulary)
    parts = max(1, math.ceil(found.get(-2, 0) / part_windows))
    rounds = rounds or rounds_of(parts)
    sizes = [int(np.prod(s)) for s in vocabulary.shapes.values()]
    for turn in range(rounds if found.get(-2) else 0):

        def learn(batches: Iterator[pa.RecordBatch], w=w, turn=turn):
            from pyspark import TaskContext

            one_blas_thread()
            rng = np.random.default_rng([turn, TaskContext.get().partitionId()])

            def arrays():
                for part in training_windows(batches, size):
                    yield part[rng.permutation(len(part))]

            after, seen = trained(w, vocabulary, arrays(), RATE / (1 + turn * ROUNDS / rounds))
            if seen:
                yield {"n": [seen], "w": [np.concatenate([after[k].reshape(-1) * seen for k in w], dtype="<f8").tobytes()]}

        def added(batches: Iterator[pa.RecordBatch]):
            n, total = 0, 0.0
            for batch in batches:
                for k, x in zip(batch.column("n").to_pylist(), batch.column("w"), strict=True):
                    n, total = n + k, total + np.frombuffer(x.as_buffer(), "<f8")
            if n:
                yield {"n": [n], "w": [total.tobytes()]}

        # One row a part: its weights, summed in tasks of a bounded number of parts.
        now = texts.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == turn)
        summed = arrow_map(now.coalesce(parts), learn, "n long, w binary")
        left = parts
        while left > ADDED_PARTS:
            left = math.ceil(left / ADDED_PARTS)
            summed = arrow_map(summed.repartition(left), added, "n long, w binary")
        done = summed.collect()
        if not done:  # no text has this turn
            continue
        mean = sum(np.frombuffer(r["w"], "<f8") for r in done) / sum(r["n"] for r in done)
        w = {k: x.reshape(s).astype(F4) for (k, s), x in zip(vocabulary.shapes.items(), np.split(mean, np.cumsum(sizes)[:-1]), strict=True)}
    return w, vocabulary


def n_training_windows(batch: pa.RecordBatch) -> np.ndarray:
    length = pc.binary_length(batch.column("w")).to_numpy().astype(np.int64) // U2.itemsize
    return -(-(length + 1) // WIDTH)


def training_windows(batches: Iterator[pa.RecordBatch], vocabulary_size: int, turn: int | None = None, rows: int = 10_000, rounds: int = ROUNDS) -> Iterator[np.ndarray]:
    """All windows of the coded texts of (row, w), or those of one of
    ``rounds`` turns, about ``rows`` at a time. Turns take the windows of a text
    in rotation, beginning with the one that its number says."""
    held: list[np.ndarray] = []
    for batch in batches:
        ends = np.cumsum(n_training_windows(batch))
        begin, base = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(ends.searchsorted(base + rows, "right")))
            part = batch.slice(begin, end - begin)
            length = pc.binary_length(part.column("w")).to_numpy().astype(np.int64) // U2.itemsize
            first = part.column("row").to_numpy() % rounds
            keep = None if turn is None else lambda t, k, first=first: (first[t] + k) % rounds == turn
            held.append(windows(unpacked(part.column("w"), U2), length, vocabulary_size, keep, WIDTH)[0])
            if sum(map(len, held)) >= rows:
                yield np.concatenate(held)
                held = []
            base, begin = int(ends[end - 1]), end
    if sum(map(len, held)):
        yield np.concatenate(held)


def word_hashes(texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(*buffer(texts, lower=True))
    return words, words.hashes()


def word_counts(dealt: DataFrame) -> tuple[DataFrame, int, int]:
    """(block, h, n): for each distinct word of each block, its count in all
    training texts; and the number of training words, all and distinct."""
    target = pa.schema([("block", pa.int32()), ("h", pa.int64()), ("n", pa.int32())])

    def asked(rows: pa.Table) -> pa.Table:
        import pandas as pd

        held: list[pd.Series] = []
        for batch in gathered(rows.to_batches()):
            words, h = word_hashes(batch.column("text"))
            codes, distinct, _ = factorized(h)
            training = batch.column("training").to_numpy(zero_copy_only=False).astype(float)
            held.append(pd.Series(np.bincount(codes, weights=training[words.doc], minlength=len(distinct)).astype(np.int64), index=distinct))
        total = pd.concat(held).groupby(level=0, sort=False).sum()
        return pa.Table.from_batches([as_batch({"block": np.full(len(total), rows["block"][0].as_py()), "h": total.index.to_numpy(np.uint64).view(np.int64), "n": total.to_numpy()}, target)])

    asked_for, _ = stored(dealt.groupBy("block").applyInArrow(asked, "block int, h long, n int"), "asked-words")
    words, _ = stored(asked_for.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")), "word-totals")
    row = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum("blocks").alias("rows")).first()
    # A word that many blocks ask for would meet in one task; there are few such.
    least = max(8, math.ceil(int(row["rows"] or 0) / HEAD_WORDS))
    head = F.broadcast(words.where(F.col("blocks") >= least).select("h", F.col("n").alias("total")))
    common = asked_for.join(head, "h").select("block", "h", F.col("total").alias("n"))
    rare = asked_for.join(head, "h", "left_anti").select("block", "h").join(words.select("h", "n"), "h").select("block", "h", "n")
    return common.unionByName(rare), int(row["n"] or 0), int(row["v"] or 0)


def scored(docs: DataFrame, path: str | None = None, with_model: bool = True) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    of each row of (doc_id, text), logarithms to base 10. ``with_model`` false
    leaves the score null and trains nothing."""
    path = path or default_path()
    rows = coded(docs.select("doc_id", "text", is_training().alias("training")), path, with_model)
    base = base_scores(rows)
    if with_model:
        model = docs.sparkSession.sparkContext.broadcast(fit(rows.where("training"), Subwords.of(path).size))

        def score(batches: Iterator[pa.RecordBatch]):
            one_blas_thread()
            for batch in slices(batches, "w", 1 << 20):
                n = pc.binary_length(batch.column("w")).to_numpy().astype(np.int64) // U2.itemsize
                yield {"row": batch.column("row"), "score": text_log_p(*model.value, unpacked(batch.column("w"), U2).astype(np.int64), n) / np.log(10)}

        base = base.join(arrow_map(rows.select("row", "w"), score, "row long, score double"), "row")
    else:
        base = base.withColumn("score", F.lit(None).cast("double"))
    return base.select("doc_id", is_held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def base_scores(rows: DataFrame) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, train_tokens, base_score) of rows (row,
    doc_id, training, text)."""
    _, text_bytes = row_bytes(rows)
    blocks = max(1, math.ceil(text_bytes / BLOCK_BYTES))
    dealt = rows.select("row", "doc_id", "training", "text", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    counts, n_words, n_distinct = word_counts(dealt)
    texts = rows.where("training").count()
    n_train, distinct = n_words + texts, n_distinct + (texts > 0)
    out = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64())])

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        parts = []
        keys, values = known["h"].to_numpy().view(np.uint64), known["n"].to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        logs = np.log10(values + 0.5)
        for batch in gathered(rows.to_batches()):
            words, h = word_hashes(batch.column("text"))
            at = np.searchsorted(keys, h)
            k = batch.num_rows
            parts.append(as_batch({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "n_tokens": words.counts() + 1,
                "n_known": np.bincount(words.doc, weights=values[at] > 0, minlength=k).astype(np.int64) + (texts > 0),
                "log_counts": np.bincount(words.doc, weights=logs[at], minlength=k) + np.log10(texts + 0.5),
            }, out))
        return pa.Table.from_batches(parts, out)

    answers = counts.select(F.col("block").alias("at"), "h", "n")
    met = dealt.select("row", "doc_id", "text", "block").groupBy("block").cogroup(answers.groupBy("at")).applyInArrow(look_up, "row long, doc_id long, n_tokens long, n_known long, log_counts double")
    scale = math.log10(n_train + 0.5 * (distinct + 1))
    return met.select("row", "doc_id", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("log_counts") - F.col("n_tokens") * F.lit(scale)).alias("base_score"))
