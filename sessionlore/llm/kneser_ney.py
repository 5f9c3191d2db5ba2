"""Operator 1: quality by perplexity under a Kneser-Ney model of trusted text.

An interpolated, modified Kneser-Ney model of 4-grams of UTF-16 units (a
character, or half of one beyond U+FFFF; case kept: letters in the wrong case,
symbols and tables are what it should find odd) is counted on the trusted documents, those labelled of good quality and not
toxic. Counts are tables with a row per n-gram, sharded by it; the
probability of each n-gram of the corpus comes from joins of these tables,
order by order. A document's perplexity is over all its characters. It is
rejected above its language's threshold, which comes from quantiles of the
trusted documents of that language. A trusted document is scored without its
own counts: it is in one of ``FOLDS`` folds (by its text, so that copies are in the
same one) and meets the counts of the others, as a document without a label meets
counts that it had no part in.

The table of probabilities is broadcast while it has ``BROADCAST_GRAMS`` rows
at most (a bounded number goes through the driver); beyond, documents are dealt to blocks, each block joins the
probabilities of its own n-grams, and is scored with them.

Nulls: a null or empty text has no perplexity and is rejected. Rows without a
lang, or of one without trusted text, are held to the threshold over all
languages. Without trusted text in two folds nothing but empty texts is rejected. A null doc_id is kept as a
row and is never trusted. Repeated doc_ids each count. No rows give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, as_batch, dropped, gathered, row_bytes, stored
from sessionlore.llm.textvec import buffer, spread

ORDER = 4
#: Stands before a text: the first half of a character, which in texts only a second half follows.
BEGIN = 0xD800
BROADCAST_GRAMS = 1_000_000
BROADCAST_IDS, BROADCAST_LANGS = 500_000, 10_000
BLOCK_BYTES = 8 << 20
FOLDS = 4
#: What is held to the threshold is the log perplexity less ALLOWANCE over the
#: root of the number of characters, since short texts scatter. The threshold
#: is q + MARGIN * (q - median), q the QUANTILE of the language's trusted
#: documents.
QUANTILE, MARGIN, ALLOWANCE = 0.995, 0.35, 1.5


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each UTF-16 unit, and each text's number of units."""
    data, offs = buffer(texts)
    units = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
    # A character of four bytes is two units.
    heads = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0))))
    n = heads[offs[1:]] - heads[offs[:-1]]
    symbol = np.full(len(units) + (ORDER - 1) * len(n), BEGIN, np.uint64)
    at = spread(np.cumsum(n) - n + (ORDER - 1) * np.arange(1, len(n) + 1), n)
    symbol[at] = units
    gram = symbol[at]
    for k in range(1, ORDER):
        gram = gram | symbol[at - k] << np.uint64(16 * k)
    return gram, n


def gram_counts(docs: DataFrame, folds: int = 0) -> DataFrame:
    """(g, c, c1, c2, ...) of each 4-gram of all documents: its occurrences in
    the trusted ones, and in those outside fold 1, 2, ..., possibly 0. ``docs``
    has text and trusted, and fold where there are folds."""
    names = ["c", *[f"c{k}" for k in range(1, folds + 1)]]

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pd.DataFrame] = []
        closed = lambda t: {"g": t.index.to_numpy(np.uint64).view(np.int64)} | {c: t[c].to_numpy() for c in names}
        for batch in gathered(batches):
            gram, n = grams(batch.column("text"))
            codes, distinct = pd.factorize(gram)
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(float)
            fold = batch.column("fold").to_numpy() if folds else None
            weights = [trusted, *[trusted * (fold != k) for k in range(1, folds + 1)]]
            held.append(pd.DataFrame({c: np.bincount(codes, weights=np.repeat(w, n), minlength=len(distinct)).astype(np.int64) for c, w in zip(names, weights, strict=True)}, index=distinct))
            if len(held) == 16:
                held = [pd.concat(held).groupby(level=0, sort=False).sum()]
                if len(held[0]) > BROADCAST_GRAMS:
                    yield closed(held.pop())
        if held:
            yield closed(pd.concat(held).groupby(level=0, sort=False).sum())

    read = docs.select("text", "trusted", *["fold"] * bool(folds))
    return arrow_map(read, run, ", ".join(f"{c} long" for c in ["g", *names])).groupBy("g").agg(*[F.sum(c).alias(c) for c in names])


class Discounts:
    """Absolute discounts of n-grams counted once, twice and more often, for
    each column of counts."""

    def __init__(self, counts: DataFrame, names: list[str]):
        row = counts.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in names for k in (1, 2, 3, 4)]).first()
        self.d = {}
        for c in names:
            n = [row[f"{c}_{k}"] for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            # Where counts of counts are missing or leave nothing (tiny corpora), the
            # plain discount: without any, an unseen n-gram would be impossible.
            modified = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0 for k in (1, 2, 3)]
            self.d[c] = [d if d > 0 else y for d in modified]

    def of(self, name: str) -> Column:
        c, d = F.col(name), self.d[name]
        return F.when(c >= 3, d[2]).when(c == 2, d[1]).when(c == 1, d[0]).otherwise(0.0)

    def contexts(self, counts: DataFrame) -> DataFrame:
        """(h, total_c, back_c, ...): each context's count, null if 0, and the
        mass it gives to the lower order."""
        sums = [x for c in self.d for x in (F.nullif(F.sum(c), F.lit(0)).alias(f"total_{c}"), F.sum(self.of(c)).alias(f"left_{c}"))]
        shares = [x for c in self.d for x in (F.col(f"total_{c}"), (F.col(f"left_{c}") / F.col(f"total_{c}")).alias(f"back_{c}"))]
        return counts.groupBy(F.shiftrightunsigned("g", 16).alias("h")).agg(*sums).select("h", *shares)


def suffix(order: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << 16 * order) - 1))


def probabilities(counts: DataFrame) -> DataFrame:
    """(g, logp, logp1, ...) of every 4-gram in ``counts``, natural logarithm,
    by the counts c, c1, ..."""
    names = [c for c in counts.columns if c != "g"]
    seen = {ORDER: counts.where("c > 0")}
    for k in range(ORDER - 1, 0, -1):  # in how many contexts a shorter one occurs
        seen[k], _ = stored(seen[k + 1].groupBy(suffix(k).alias("g")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in names]), f"continuations-{k}")
    discounts = {k: Discounts(s, names) for k, s in seen.items()}
    one = seen[1].agg(*[x for c in names for x in (F.sum(c).alias(f"total_{c}"), F.sum(discounts[1].of(c)).alias(f"left_{c}"), F.count_if(F.col(c) > 0).alias(f"v_{c}"))]).first()

    def first(c: str) -> Column:
        total, left, v = one[f"total_{c}"] or 1, one[f"left_{c}"] or 1.0, (one[f"v_{c}"] or 0) + 1
        return F.coalesce((F.col(c) - discounts[1].of(c)) / total, F.lit(0.0)) + F.lit(left / total / v)

    known = counts.select("g")
    lower = known.select(suffix(1).alias("g")).distinct().join(seen[1], "g", "left").select("g", *[first(c).alias(f"p_{c}") for c in names])
    for k in range(2, ORDER + 1):
        rows = counts if k == ORDER else known.select(suffix(k).alias("g")).distinct().join(seen[k], "g", "left")
        rows = rows.select("g", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], F.shiftrightunsigned("g", 16).alias("h"), suffix(k - 1).alias("s"))
        p = lambda c, k=k: F.coalesce((F.col(c) - discounts[k].of(c)) / F.col(f"total_{c}"), F.lit(0.0)) + F.coalesce(f"back_{c}", F.lit(1.0)) * F.col(f"q_{c}")
        lower = rows.join(discounts[k].contexts(seen[k]), "h", "left").join(lower.select(F.col("g").alias("s"), *[F.col(f"p_{c}").alias(f"q_{c}") for c in names]), "s", "left").select("g", *[p(c).alias(f"p_{c}") for c in names])
        if k < ORDER:  # plans stay small: an order is planned without those before
            lower, _ = stored(lower, f"lower-{k}")
    return lower.select("g", *[F.log(f"p_{c}").alias(f"logp{c[1:]}") for c in names])


class Lookup:
    """An open-addressing table from 64-bit keys to values, in numpy."""

    _open: tuple[str, Lookup | None] = ("", None)

    @classmethod
    def of(cls, name: str, arrays) -> Lookup:
        """One per Python worker and broadcast."""
        if cls._open[0] != name:
            cls._open = name, cls(*arrays.value)
        return cls._open[1]

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.values = values
        left = np.arange(len(keys))
        at = self.place(keys)
        while len(left):
            free = self.slot[at] < 0
            first = np.unique(at[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.slot[at[taken]], self.keys[at[taken]] = left[taken], keys[left[taken]]
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Values of keys, all of which are in the table, each from its column."""
        at = self.place(keys)
        found = self.slot[at]
        left = np.flatnonzero(self.keys[at] != keys)
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            found[left] = self.slot[at]
            wrong = self.keys[at] != keys[left]
            left, at = left[wrong], at[wrong]
        return self.values[found, column]


def text_scores(batch: pa.RecordBatch, table: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the sum of their log probabilities, by the
    column of its fold."""
    gram, n = grams(batch.column("text"))
    fold = batch.column("fold").to_numpy() if "fold" in batch.schema.names else np.zeros(len(n), np.int32)
    sums = np.concatenate(([0.0], np.cumsum(table.get(gram, np.repeat(fold, n))))) if len(gram) else np.zeros(1)
    ends = np.cumsum(n)
    return n, sums[ends] - sums[ends - n]


SCORES = "doc_id long, lang string, trusted boolean, n_scored long, log_p double"


def scored(docs: DataFrame, logp: DataFrame, limit: int = BROADCAST_GRAMS) -> DataFrame:
    """``SCORES`` of (doc_id, text, lang, trusted), and fold where ``logp`` has
    columns for folds; fold 0 has the counts of all."""
    spark = docs.sparkSession
    columns = [c for c in logp.columns if c != "g"]
    if logp.count() <= limit:
        known = logp.toArrow()
        name, arrays = uuid.uuid4().hex, spark.sparkContext.broadcast((known["g"].to_numpy().view(np.uint64), np.column_stack([known[c].to_numpy() for c in columns])))
        del known

        def run(batches: Iterator[pa.RecordBatch]):
            table = Lookup.of(name, arrays)
            for batch in gathered(batches):
                n, total = text_scores(batch, table)
                yield {c: batch.column(c) for c in ("doc_id", "lang", "trusted")} | {"n_scored": n, "log_p": total}

        return arrow_map(docs, run, SCORES)
    _, text_bytes = row_bytes(docs)
    blocks = max(1, math.ceil(text_bytes / BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    wanted = pa.schema([("block", pa.int32()), ("g", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n_scored", pa.int64()), ("log_p", pa.float64())])

    def asked(rows: pa.Table) -> pa.Table:
        found = [np.unique(grams(b.column("text"))[0]) for b in gathered(rows.to_batches())]
        g = np.unique(np.concatenate(found))
        return pa.Table.from_batches([as_batch({"block": np.full(len(g), rows["block"][0].as_py()), "g": g.view(np.int64)}, wanted)])

    def answered(rows: pa.Table, known: pa.Table) -> pa.Table:
        table = Lookup(known["g"].to_numpy().view(np.uint64), np.column_stack([known[c].to_numpy() for c in columns]))
        parts = []
        for batch in gathered(rows.to_batches()):
            n, total = text_scores(batch, table)
            parts.append(as_batch({c: batch.column(c) for c in ("doc_id", "lang", "trusted")} | {"n_scored": n, "log_p": total}, out))
        return pa.Table.from_batches(parts, out)

    requests = dealt.groupBy("block").applyInArrow(asked, "block int, g long")
    responses = requests.join(logp, "g").select(F.col("block").alias("at"), "g", *columns)
    return dealt.groupBy("block").cogroup(responses.groupBy("at")).applyInArrow(answered, SCORES)


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, trusted, fold), fold 0 for those that are not trusted."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"), F.max("toxic").alias("toxic"))
    ids, _ = stored(marked.where("good and coalesce(toxic, 0) = 0").select("doc_id", F.lit(True).alias("trusted")), "trusted")
    few = ids.count() <= BROADCAST_IDS
    return docs.select("doc_id", "text", "lang").join(F.broadcast(ids) if few else ids, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))).withColumn("fold", F.when(F.col("trusted"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)) + 1).otherwise(0).cast("int"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, n_scored, log_perplexity, excess, threshold, kept) of
    each row."""
    marked = with_trust(docs, labels)
    counts, counts_path = stored(gram_counts(marked, FOLDS), "gram-counts")
    logp, logp_path = stored(probabilities(counts), "gram-probabilities")
    # A fold that has all the trusted text has no counts outside: no threshold from it.
    outside = counts.agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(1, FOLDS + 1)]).first()
    usable = [k for k in range(1, FOLDS + 1) if outside[f"c{k}"]]
    held = F.col("fold").isin(usable) if usable else F.lit(False)
    marked = marked.withColumn("trusted", held).withColumn("fold", F.when(held, F.col("fold")).otherwise(0))
    rows, _ = stored(scored(marked, logp), "perplexities")
    dropped(docs.sparkSession, counts_path, logp_path)
    rows = rows.withColumn("log_perplexity", F.when(F.col("n_scored") > 0, -F.col("log_p") / F.col("n_scored")))
    rows = rows.withColumn("excess", F.col("log_perplexity") - ALLOWANCE / F.sqrt("n_scored"))
    trusted = rows.where("trusted and excess is not null")
    limit = lambda: F.percentile_approx("excess", [0.5, QUANTILE], 10000)
    above = lambda q: (q[1] + MARGIN * (q[1] - q[0])).alias("threshold")
    by_lang = trusted.groupBy("lang").agg(limit().alias("q")).select("lang", above(F.col("q")))
    overall = trusted.agg(limit().alias("q")).select(above(F.col("q")).alias("overall")).first()["overall"]
    by_lang, _ = stored(by_lang, "thresholds")
    met = rows.join(F.broadcast(by_lang) if by_lang.count() <= BROADCAST_LANGS else by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(overall).cast("double")))
    kept = F.col("log_perplexity").isNotNull() & (F.coalesce(F.col("excess") <= F.col("threshold"), F.lit(True)))
    return met.select("doc_id", "lang", "n_scored", "log_perplexity", "excess", "threshold", kept.alias("kept"))
