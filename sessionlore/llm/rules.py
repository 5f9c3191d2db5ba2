"""Operator 4: quality rules and an isolation forest on their statistics.

Statistics are exact counts over whole texts. A document fails the base rules
if it has under ``MIN_WORDS`` words or too many words in repeated 5-word
windows. Of the others, isolation forests (trees of random splits over
subsamples) say how soon a document stands alone: one forest on each rule's
statistic and one on all of them together, since in the joint one an odd
value of a single rule drowns in the spread of the others. The threshold on
each forest's score comes from labelled rows, and passing any one rejects.

The trees are grown on at most ``SAMPLE_ROWS`` labelled rows (those with the
least hash of doc_id); everything else covers all rows, the thresholds all
labelled ones. Without labels of
both kinds, only the base rules decide.

Nulls: a null or empty text has no words and fails. A null doc_id is kept
(it has no label); a doc_id labelled more than once counts as bad if any of
its labels is. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, dropped, gathered, narrow, stored
from sessionlore.llm.textvec import SPACE, Words, buffer, mix, ranges_hash, runs_hash

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
REPEAT_WIDTH = 5
SAMPLE_ROWS = 20_000
TREES, TREE_ROWS = 48, 256
#: Share of good labelled documents that a threshold may give up at most. A
#: forest rejects nothing unless most of what it rejects is bad, and that many
#: bad ones would come by chance less often than CHANCE.
GOOD_LOSS, CHANCE = 0.0005, 0.01

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_digits", "n_chars")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "upper", "punct", "digits", "line_words")


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offs[1:]] - sums[offs[:-1]]


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of a value in its document."""
    return mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offs = buffer(texts)
    words = Words(data, offs)
    n_docs = len(offs) - 1
    head = (data & 0xC0) != 0x80
    out = {
        "n_words": words.counts(), "word_chars": _per_doc(head & ~SPACE[data], offs), "n_symbols": _per_doc(_SYMBOL[data], offs),
        "n_upper": _per_doc(_UPPER[data], offs), "n_punct": _per_doc(_PUNCT[data], offs), "n_digits": _per_doc(_DIGIT[data], offs), "n_chars": _per_doc(head, offs),
    }
    # Lines with a word, and those whose bytes a line of the same text had.
    line_ends = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate((offs[:-1], line_ends + 1)))
    start = start[start < len(data)]
    doc = np.searchsorted(offs, start, "right") - 1
    end = np.append(start[1:], len(data))
    filled = np.concatenate(([0], np.cumsum(~SPACE[data], dtype=np.int64)))
    some = filled[end] > filled[start]
    start, end, doc = start[some], end[some], doc[some]
    cut = end - (data[end - 1] == 0x0A) if len(end) else end
    new = ~pd.Series(_keyed(ranges_hash(data, start, cut), doc)).duplicated().to_numpy()
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(doc[~new], minlength=n_docs)
    # Words in windows of five that occur twice or more in the text.
    run, at = runs_hash(words.hashes(), words.doc, REPEAT_WIDTH)
    twice = pd.Series(_keyed(run, words.doc[at])).duplicated(keep=False).to_numpy()
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + REPEAT_WIDTH, -1)
    out["n_repeat_words"] = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in gathered(batches):
            yield {"doc_id": batch.column("doc_id")} | text_counts(batch.column("text"))

    return arrow_map(narrow(docs, "doc_id", "text"), run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(x: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1), np.maximum(x["n_lines"], 1)
    return np.column_stack((
        np.minimum(x["word_chars"] / words, 50), np.minimum(x["n_symbols"] / words, 5), x["n_dup_lines"] / lines, x["n_repeat_words"] / words,
        x["n_upper"] / chars, np.minimum(x["n_punct"] / words, 5), x["n_digits"] / chars, np.log1p(x["n_words"] / lines),
    ))


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n < 2, 0, np.where(n == 2, 1, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


class Forest:
    """Trees as arrays: feature (-1: leaf), split value, children, and the
    path length at a leaf."""

    def __init__(self, rows: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = min(TREE_ROWS, len(rows))
        limit = int(np.ceil(np.log2(max(2, self.rows))))
        nodes: list[tuple[int, float, int, int, float]] = []
        self.roots = []
        for _ in range(TREES):
            self.roots.append(len(nodes))
            self._grow(nodes, rows[rng.choice(len(rows), self.rows, replace=False)], 0, limit, rng)
        self.feature, self.value, self.left, self.right, self.path = [np.array(c) for c in zip(*nodes, strict=True)]

    def _grow(self, nodes, rows, depth, limit, rng) -> int:
        me = len(nodes)
        low, high = rows.min(0), rows.max(0)
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) < 2 or not len(open_):
            nodes.append((-1, 0.0, me, me, depth + float(average_path(len(rows)))))
            return me
        f = int(rng.choice(open_))
        value = float(rng.uniform(low[f], high[f]))
        nodes.append((f, value, 0, 0, 0.0))
        below = rows[:, f] < value
        left = self._grow(nodes, rows[below], depth + 1, limit, rng) if below.any() else self._leaf(nodes, depth)
        right = self._grow(nodes, rows[~below], depth + 1, limit, rng)
        nodes[me] = (f, value, left, right, 0.0)
        return me

    @staticmethod
    def _leaf(nodes, depth) -> int:
        nodes.append((-1, 0.0, len(nodes), len(nodes), float(depth + 1)))
        return len(nodes) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for what stands alone."""
        total = np.zeros(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                at = node[rows]
                node[rows] = np.where(x[rows, f[rows]] < self.value[at], self.left[at], self.right[at])
            total += self.path[node]
        return 2 ** (-total / len(self.roots) / max(1e-9, float(average_path(self.rows))))


def convincing(found: int, lost: int, share: float) -> bool:
    """Whether ``found`` bad of ``found + lost`` rejected rows are most of them, and
    too many for chance (Chernoff's bound) where a ``share`` of all rows is bad."""
    n = found + lost
    if found <= lost or found <= share * n:
        return False
    p = found / n
    apart = p * np.log(p / share) + (0 if lost == 0 else (1 - p) * np.log((1 - p) / (1 - share)))
    return bool(n * apart >= -np.log(CHANCE))


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


class Forests:
    """The forests of each statistic and of all, with their thresholds."""

    def __init__(self, x: np.ndarray):
        self.columns = [[k] for k in range(x.shape[1])] + [list(range(x.shape[1]))]
        self.forests = [Forest(x[:, c], seed=k) for k, c in enumerate(self.columns)]
        self.thresholds = [np.inf] * len(self.forests)

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [f.score(x[:, c]) for f, c in zip(self.forests, self.columns, strict=True)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The largest excess of a score over its threshold; above 0: rejected."""
        out = np.full(len(x), -1.0)
        for forest, c, threshold in zip(self.forests, self.columns, self.thresholds, strict=True):
            if np.isfinite(threshold):
                out = np.maximum(out, forest.score(x[:, c]) - threshold)
        return out


def fit(stats: DataFrame, labels: DataFrame) -> Forests | None:
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled, path = stored(stats.join(marked, "doc_id").where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))), "labelled-statistics")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).toPandas()
    forests = None
    if len(sample):
        forests = Forests(features({c: sample[c].to_numpy() for c in COUNTS}))
        forests.thresholds = thresholds(labelled, forests)
    dropped(stats.sparkSession, path)
    return forests


def thresholds(labelled: DataFrame, forests: Forests) -> list[float]:
    """For each forest the score above which documents are rejected: half way
    from the least that loses at most ``GOOD_LOSS`` of all good labelled rows to
    the next bad row."""
    names = [f"s{i}" for i in range(len(forests.forests))]
    never = [np.inf] * len(names)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = forests.scores(features({c: batch.column(c).to_numpy() for c in COUNTS}))
            yield {"bad": batch.column("bad")} | dict(zip(names, scores, strict=True))

    rows, path = stored(arrow_map(labelled, run, ", ".join(["bad boolean", *(f"{c} double" for c in names)])), "forest-scores")
    total = rows.agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad")).first()
    if not total["good"] or not total["bad"]:
        return never
    # Somewhat below the wanted place, whose exact value is counted from above.
    place = max(0.0, 1 - GOOD_LOSS - 3e-5 - 2 / total["good"])
    low = rows.where(~F.col("bad")).agg(*[F.percentile_approx(c, place, 100_000).alias(c) for c in names]).first()
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("score"), F.lit(low[c]).alias("low")) for c in names])).alias("e")
    tail = rows.where(~F.col("bad")).select(each).select("e.*").where("score >= low").groupBy("name", "score").count().toPandas().sort_values("score", ascending=False)
    least = {}
    for c in names:
        part = tail[tail["name"] == c]
        least[c] = float(part["score"].to_numpy()[np.flatnonzero(part["count"].cumsum().to_numpy() > int(GOOD_LOSS * total["good"]))[0]])
    above = lambda c: F.col(c) > least[c]
    met = rows.agg(*[x for c in names for x in (F.count_if(F.col("bad") & above(c)).alias(f"{c}_bad"), F.count_if(~F.col("bad") & above(c)).alias(f"{c}_good"), F.min(F.when(F.col("bad") & above(c), F.col(c))).alias(f"{c}_next"))]).first()
    dropped(labelled.sparkSession, path)
    share = total["bad"] / (total["bad"] + total["good"])
    return [(least[c] + met[f"{c}_next"]) / 2 if convincing(met[f"{c}_bad"], met[f"{c}_good"], share) else np.inf for c in names]


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``anomaly`` and ``kept``."""
    stats, _ = stored(statistics(docs), "rule-statistics")
    forests = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in COUNTS}
            failed = base_failed(x["n_words"], x["n_repeat_words"])
            score = forests.margin(features(x)) if forests else np.full(len(failed), -1.0)
            yield {"doc_id": batch.column("doc_id")} | x | {"base_failed": failed, "anomaly": score, "kept": ~failed & (score <= 0)}

    return arrow_map(stats, run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean", "anomaly double", "kept boolean"]))
