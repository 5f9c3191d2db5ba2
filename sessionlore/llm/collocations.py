"""Operator 12: collocations, phrases that occur together more than their parts
let expect, per language.

Phrases are counted in each task by a HAT-trie: a shallow trie over the task's
word ids whose leaves are containers that count by hash. A container holds an
interval of first words; one that grows beyond BURST entries bursts into two at a
word, and one of a single word into a node over the next word. When the trie has
more than LIMIT entries, whole subtrees, the largest first, leave it as runs:
their phrases as texts in byte order, with their counts, cut by prefix partition (a
hash of the language and the first two words) and compressed. Each partition then
merges its runs, so a word in every document is spread by its second word, and a
task passes on one entry a phrase and run however often it occurs.

Phrases of at least LEAST occurrences stay. Every part of a frequent phrase is at
least as frequent, so parts and longer phrases are found among those that stay,
by joins. All arithmetic is exact, in decimals of 38 digits.

Nulls: a null text has no words, a null lang is ``und``; doc_id plays no part,
repeated rows count as often as they occur. Ties are broken as the order says; an
empty table gives an empty result. Further columns are ignored. A language is a
string; words of different languages never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, as_batch, gathered, row_bytes, stored
from sessionlore.llm.textvec import Words, buffer, mix, ranges_hash

# Fixed by the contract: words of a phrase, least occurrences, and rows per language.
LONGEST, LEAST, TOP = 3, 10, 2000
#: Text bytes for each prefix partition.
PARTITION_BYTES = 4 << 20
#: Entries of a container before it bursts, and of a trie before subtrees leave it.
BURST, LIMIT = 1 << 16, 3 << 19
#: Phrases of a run that are turned into texts at a time.
RUN_PHRASES = 1 << 17
BITS = 21
_MASK = np.int64((1 << BITS) - 1)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Container:
    """Counts by key. Entries wait in arrays and are summed up by hash when as many
    have come as there were."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def __len__(self) -> int:
        return len(self.keys) + self.n_waiting

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting > 1024 + len(self.keys):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
            counts = np.concatenate([self.counts, *[c for _, c in self.waiting]])
            codes, self.keys = pd.factorize(keys)
            self.counts = np.zeros(len(self.keys), np.int64)
            np.add.at(self.counts, codes, counts)
            self.waiting, self.n_waiting = [], 0

    def containers(self) -> Iterator[Container]:
        yield self


class Node:
    """Children over intervals of the word at ``depth``: ``bounds`` has the least
    key of each."""

    def __init__(self, depth: int, burst: int):
        self.depth, self.burst = depth, burst
        self.bounds = np.array([np.iinfo(np.int64).min])
        self.children: list[Container | Node] = [Container(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def __len__(self) -> int:
        return sum(map(len, self.children))

    def containers(self) -> Iterator[Container]:
        for child in self.children:
            yield from child.containers()

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted, distinct keys."""
        cut = [0, *np.searchsorted(keys, self.bounds[1:]).tolist(), len(keys)]
        full = []
        for i, child in enumerate(self.children):
            if cut[i] < cut[i + 1]:
                child.add(keys[cut[i] : cut[i + 1]], counts[cut[i] : cut[i + 1]])
                if isinstance(child, Container) and len(child) > self.burst:
                    full.append(i)
        for i in reversed(full):
            self.split(i)

    def split(self, i: int) -> None:
        child = self.children[i]
        child.settle()
        if len(child) <= self.burst:
            return
        order = np.argsort(child.keys)
        keys, counts = child.keys[order], child.counts[order]
        shift = np.int64(BITS * (LONGEST - 1 - self.depth))
        first, last = keys[0] >> shift, keys[-1] >> shift
        if first == last:
            if self.depth < LONGEST - 1:
                deeper = Node(self.depth + 1, self.burst)
                deeper.add(keys, counts)
                self.children[i] = deeper
            return
        # At the word that the middle entry has, or at the next word.
        middle = keys[len(keys) // 2] >> shift
        border = (middle if middle > first else middle + 1) << shift
        at = int(np.searchsorted(keys, border))
        self.children[i : i + 1] = [Container(keys[:at], counts[:at]), Container(keys[at:], counts[at:])]
        self.bounds = np.insert(self.bounds, i + 1, border)


class Dictionary:
    """A task's words: ids from 1 by hash, the words, and their languages."""

    def __init__(self):
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.hashes: list[np.ndarray] = [np.zeros(1, np.uint64)]

    def of(self, h: np.ndarray, words: Words, first: np.ndarray, langs: list[str]) -> np.ndarray:
        at = np.searchsorted(self.known, h)
        fresh = np.ones(len(h), bool)
        inside = at < len(self.known)
        fresh[inside] = self.known[at[inside]] != h[inside]
        if fresh.any():
            new = np.flatnonzero(fresh)
            ids = len(self.words) + np.arange(len(new))
            self.words += [words.text(i) for i in first[new]]
            self.langs += [langs[d] for d in words.doc[first[new]]]
            self.hashes.append(h[new])
            known = np.concatenate((self.known, h[new]))
            order = np.argsort(known, kind="stable")
            self.known, self.ids = known[order], np.concatenate((self.ids, ids))[order]
            at = np.searchsorted(self.known, h)
        return self.ids[at]


def phrase_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Lower-case words of a batch, and whether each is followed by another
    one of its piece."""
    data, offs = buffer(texts, lower=True)
    words = Words.__new__(Words)
    words.data, words.offs, words.n_docs = data, offs, len(offs) - 1
    inside = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))) if len(data) else inside
    last = inside & (edge[1:] | np.concatenate((~inside[1:], [True]))) if len(data) else inside
    words.start, words.end = np.flatnonzero(first), np.flatnonzero(last) + 1
    words.doc = np.searchsorted(offs, words.start, "right") - 1
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
    joined = (words.doc[1:] == words.doc[:-1]) & (breaks[words.start[1:]] == breaks[words.end[:-1]])
    return words, np.append(joined, False)[: len(words)]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(keys)
    n = np.bincount(codes, minlength=len(distinct))
    order = np.argsort(distinct)
    return distinct[order], n[order]


class Phrases:
    """The trie of a task, fed batch by batch."""

    def __init__(self, parts: int, burst: int = BURST, limit: int = LIMIT):
        self.parts, self.burst, self.limit = parts, burst, limit
        self.clear()

    def clear(self) -> None:
        self.dictionary, self.root = Dictionary(), Node(0, self.burst)

    def feed(self, texts: pa.Array, langs: list[str]) -> Iterator[dict]:
        words, joined = phrase_words(texts)
        if not len(words):
            return
        names = sorted(set(langs))
        raw, offs = buffer(pa.array(names, pa.string()))
        own = dict(zip(names, mix(ranges_hash(raw, offs[:-1], offs[1:])), strict=True))
        h = mix(ranges_hash(words.data, words.start, words.end) ^ np.array([own[x] for x in langs], np.uint64)[words.doc])
        codes, distinct = pd.factorize(h)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.dictionary.words) + len(distinct) > _MASK:
            yield from self.drain()
        ids = self.dictionary.of(np.asarray(distinct), words, first, langs)[codes]
        one = ids << 2 * BITS
        two = (one[:-1] | ids[1:] << BITS)[joined[:-1]]
        both = joined[:-2] & joined[1:-1]
        three = (one[:-2] | ids[1:-1] << BITS | ids[2:])[both] if len(ids) > 2 else one[:0]
        for keys in (one, two, three):
            if len(keys):
                self.root.add(*counted(keys))
        if len(self.root) > self.limit:
            yield from self.spill(self.limit // 2)

    def spill(self, left: int) -> Iterator[dict]:
        """Runs of the largest subtrees, until the trie has ``left`` entries."""
        for child in self.root.children:
            for c in child.containers():
                c.settle()
        total = len(self.root)
        if total <= left:
            return
        sizes = sorted(range(len(self.root.children)), key=lambda i: -len(self.root.children[i]))
        leaving: list[Container] = []
        for i in sizes:
            if total <= left:
                break
            child = self.root.children[i]
            total -= len(child)
            leaving += child.containers()
            self.root.children[i] = Container(np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield from self.runs(leaving)

    def drain(self) -> Iterator[dict]:
        leaving = list(self.root.containers())
        for c in leaving:
            c.settle()
        yield from self.runs(leaving)
        self.clear()

    def runs(self, leaving: list[Container]) -> Iterator[dict]:
        keys, counts = np.concatenate([c.keys for c in leaving]), np.concatenate([c.counts for c in leaving])
        if not len(keys):
            return
        words = pa.array(self.dictionary.words, pa.large_binary())
        hashes = np.concatenate(self.dictionary.hashes)
        lang_names, lang_of = np.unique(np.array(self.dictionary.langs, object), return_inverse=True)
        order = pc.sort_indices(words).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        split = lambda k: (k >> 2 * BITS, k >> BITS & _MASK, k & _MASK)
        a, b, _ = split(keys)
        part = (mix(hashes[a] * np.uint64(3) + hashes[b]) % np.uint64(self.parts)).astype(np.int64)
        lang = lang_of[a]
        ranked = place[a] << 2 * BITS | place[b] << BITS | place[keys & _MASK]
        order = np.lexsort((ranked, lang, part))
        keys, counts, part, lang = keys[order], counts[order], part[order], lang[order]
        group = part * len(lang_names) + lang
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        begin = 0
        while begin < len(cuts) - 1:
            end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + RUN_PHRASES, "right")) - 1)
            lo, hi = cuts[begin], cuts[end]
            texts = joined_words(words, split(keys[lo:hi]))
            at = (cuts[begin : end + 1] - lo).tolist()
            offs, data = texts_buffer(texts)
            yield {
                "part": part[cuts[begin:end]], "lang": [lang_names[lang[i]] for i in cuts[begin:end]],
                "sizes": [squeezed(np.diff(offs[i : j + 1]).astype("<u4")) for i, j in zip(at, at[1:], strict=False)],
                "phrases": [squeezed(data[offs[i] : offs[j]]) for i, j in zip(at, at[1:], strict=False)],
                "counts": [squeezed(counts[lo + i : lo + j].astype("<i8")) for i, j in zip(at, at[1:], strict=False)],
            }
            begin = end


RUNS = "part int, lang string, sizes binary, phrases binary, counts binary"
TOTALS = "lang string, phrase string, k int, f long"


def joined_words(words: pa.Array, ids: tuple[np.ndarray, ...]) -> pa.Array:
    """Phrases as bytes; id 0 is no word."""
    out = words.take(pa.array(ids[0]))
    for more in ids[1:]:
        some = more > 0
        if some.any():
            longer = pc.binary_join_element_wise(out.filter(pa.array(some)), words.take(pa.array(more[some])), pa.scalar(b" ", pa.large_binary()))
            out = pc.replace_with_mask(out, pa.array(some), longer)
    return out


def texts_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw


def squeezed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def opened(raw: pa.Scalar, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_buffer()), kind)


def phrase_counts(docs: DataFrame, least: int = LEAST, partition_bytes: int = PARTITION_BYTES, burst: int = BURST, limit: int = LIMIT) -> DataFrame:
    """``TOTALS`` of (text, lang): phrases of 1 to LONGEST words that occur at least
    ``least`` times; and for each partition and language a row without a phrase
    that has the number of all word occurrences there."""
    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    _, text_bytes = row_bytes(rows)
    parts = max(1, math.ceil(text_bytes / partition_bytes))

    def count(batches: Iterator[pa.RecordBatch]):
        trie = Phrases(parts, burst, limit)
        for batch in gathered(batches, limit=1 << 20):
            yield from trie.feed(batch.column("text"), batch.column("lang").to_pylist())
        yield from trie.drain()

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())])

    def merge(runs: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(runs["lang"]).to_pylist():
            own = runs.filter(pc.equal(runs["lang"], lang))
            sizes = np.concatenate([opened(x, "<u4") for x in own["sizes"]]).astype(np.int64)
            data = np.concatenate([opened(x, "u1") for x in own["phrases"]])
            counts = np.concatenate([opened(x, "<i8") for x in own["counts"]])
            offs = np.concatenate(([0], np.cumsum(sizes)))
            phrases = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
            spaces = np.concatenate(([0], np.cumsum(data == 0x20)))
            single = spaces[offs[1:]] == spaces[offs[:-1]]
            total = pa.table({"phrase": phrases, "n": counts}).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
            total = total.filter(pc.greater_equal(total["n_sum"], least))
            found = pc.cast(total["phrase"], pa.string())
            k = pc.add(pc.count_substring(found, " "), 1)
            out.append(as_batch({"lang": [lang] * (len(total) + 1), "phrase": pa.concat_arrays([found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found, pa.nulls(1, pa.string())]), "k": np.append(np.asarray(k), 0), "f": np.append(np.asarray(total["n_sum"]), counts[single].sum())}, schema))
        return pa.Table.from_batches(out, schema)

    return arrow_map(rows, count, RUNS).groupBy("part").applyInArrow(merge, TOTALS)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, partition_bytes: int = PARTITION_BYTES, burst: int = BURST, limit: int = LIMIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of
    two or three words by score. A phrase's score is the least of its cuts' (the
    earliest of equal ones); phrases that lie in a longer one of at least half
    their occurrences go."""
    totals, _ = stored(phrase_counts(docs, least, partition_bytes, burst, limit), "phrase-counts")
    words = totals.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = totals.where("k > 0").select("lang", "phrase", "f")
    phrase = totals.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda begin, length: F.array_join(F.slice("w", begin, length), " ")
    cuts = phrase.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    met = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) as decimal(32,0)) * 1000000 div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    scored = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r")
    longer = phrase.where(F.col("k") == LONGEST).select("lang", F.explode(F.array(part(1, LONGEST - 1), part(2, LONGEST - 1))).alias("phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("longest is null or 2 * longest < a")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
