"""Operator 2: exact n-gram Jaccard join with set-relation skipping.

A document is its set of distinct 5-word shingles. Two documents link when
their sets' Jaccard similarity is 0.8 or more.

1. Copies: documents of equal sets are one set (two 64-bit sums over mixed
   hashes tell sets apart); only one of them goes on.
2. Index lists: in one order of all shingles, linked sets share a shingle
   among the first n - ceil(0.8 n) + 1 of each (their prefixes). The order is
   by hash, with a bounded list of frequent shingles last; any order gives
   the same links, this one keeps the lists short.
3. Block skipping: an entry of a list carries its set's size and its
   position. Lists are cut into blocks by size and by position; from its own size
   and position an entry knows which blocks can hold a partner (of a like
   size, and with enough left behind both positions for the overlap), and meets
   no other. Inside a block the same is asked of each entry.
4. Answers from similar sets: in each list all sets are first compared with
   its central set, the one with the least position (fewest rare shingles
   before it; an original has fewer than its edited copies), and with its
   smallest. What links to
   one of these has its component, and needs no comparison with others of that
   component. Only
   entries of a list that are then still in different components are compared
   with each other, until no list has an uncompared pair of that kind.

A parity sketch of about a bit for each shingle (1024 at least) bounds the
symmetric difference from below and saves comparisons; every link is verified
on the whole sets.

Nulls: a null or empty text has an empty set and links with nothing. A row
with a null doc_id is returned with a null component and takes no part.
Repeated doc_ids: each row is judged by its own text, and an id that stands
for two texts may join their components. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, dropped, gathered, narrow, stored
from sessionlore.llm.components import components
from sessionlore.llm.textvec import Words, buffer, mix, runs_hash

WIDTH = 5
#: Shingles that LOCAL_DOCS documents in a row (fewer at the end of a task) have
#: three times or more are counted there, whatever the length of the texts; of
#: those with HEAVY_DF or more in all, at most HEAVY_MAX go last in the order.
LOCAL_DF, LOCAL_DOCS, HEAVY_DF, HEAVY_MAX = 3, 1000, 24, 200_000
#: Shingles held at a time; beyond, those seen less than three times are let go.
LOCAL_SHINGLES = 2_000_000
#: Blocks of a list: sizes by a factor, positions by a share of the size.
SIZE_STEP, PLACE_STEP, PLACES = 1.1, 0.05, 4
#: Groups of so many copies and more are joined by broadcast, few as they are.
MANY_COPIES = 64
SKETCH_BITS = 1024  # at least
#: Lists of ids of up to this length (24 bytes an entry at most) may be broadcast.
BROADCAST_IDS = 500_000


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets in a row, each sorted; the documents of the items; set sizes."""
    data, offs = buffer(texts, lower=True)
    words = Words(data, offs)
    n_docs = len(offs) - 1
    h = words.hashes()
    run, at = runs_hash(h, words.doc, width)
    doc = words.doc[at]
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        # The whole sequence of a short text is its one shingle.
        bounds = words.bounds()
        own = [mix(np.array([_sequence(h[bounds[d] : bounds[d + 1]])], np.uint64))[0] for d in short.tolist()]
        run, doc = np.concatenate((run, np.array(own, np.uint64))), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        run, doc = run[order], doc[order]
    ends = np.cumsum(np.bincount(doc, minlength=n_docs))
    begin = 0
    for end in ends.tolist():
        if end - begin > 1:
            run[begin:end].sort()
        begin = end
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    run, doc = run[new], doc[new]
    return run, doc, np.bincount(doc, minlength=n_docs)


def _sequence(h: np.ndarray) -> int:
    total = len(h)
    for x in h.tolist():
        total = (total * 0xA0761D6478BD642F + x) & 0xFFFFFFFFFFFFFFFF
    return total


def prefix_size(n):
    return n - (4 * n + 4) // 5 + 1


def lists_of(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """A list column whose rows have n[0], n[1], ... values."""
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of the most frequent shingles, sorted; HEAVY_MAX at most."""

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, n = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.argsort(values)
        heads = np.flatnonzero(np.diff(values[order], prepend=np.uint64(0)) != 0) if len(values) else np.zeros(0, np.int64)
        heads = heads if len(heads) and heads[0] == 0 else np.concatenate(([0], heads))[: len(values)]
        values, n = values[order][heads], np.add.reduceat(n[order], heads) if len(heads) else n
        return values[n >= LOCAL_DF], n[n >= LOCAL_DF]

    def run(batches: Iterator[pa.RecordBatch]):
        held, size, docs = [], 0, 0
        for batch in gathered(batches):
            for at in range(0, batch.num_rows, LOCAL_DOCS):
                part = batch.slice(at, LOCAL_DOCS)
                held.append(np.unique(shingle_sets(part.column("text"))[0], return_counts=True))
                size, docs = size + len(held[-1][0]), docs + part.num_rows
                if size > LOCAL_SHINGLES:
                    held = [added(held)]
                    size = len(held[0][0])
                if docs >= LOCAL_DOCS:
                    values, n = added(held)
                    held, size, docs = [], 0, 0
                    yield {"token": values.view(np.int64), "n": n}
        if held:
            values, n = added(held)
            yield {"token": values.view(np.int64), "n": n}

    counted = arrow_map(docs.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = counted.where(F.col("n") >= HEAVY_DF).orderBy(F.col("n").desc(), "token").limit(HEAVY_MAX).toPandas()
    return np.sort(most["token"].to_numpy(np.int64).view(np.uint64))


def described(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """Of each document: set size, two sums that identify the set, its prefix
    (the rare and the frequent part of it), and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in gathered(batches):
            h, doc, n = shingle_sets(batch.column("text"))
            k = len(n)
            sums = [np.zeros(k + 1, np.uint64), np.zeros(k + 1, np.uint64)]
            ends = np.cumsum(n)
            for s, salt in zip(sums, (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A62), strict=True):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))))
                s[:k] = total[ends] - total[ends - n]
            often = np.zeros(len(h), bool)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                often = heavy[at] == h
            # Position of each item in its set's order: rare ones first.
            rare_before = np.concatenate(([0], np.cumsum(~often)))
            rare = rare_before[ends] - rare_before[ends - n]
            place = np.arange(len(h)) - (ends - n)[doc]
            rare_place = rare_before[:-1] - rare_before[ends - n][doc]
            position = np.where(often, rare[doc] + place - rare_place, rare_place)
            taken = position < prefix_size(n)[doc]
            a, b = taken & ~often, taken & often
            bits = 2 ** np.ceil(np.log2(np.maximum(n, SKETCH_BITS))).astype(np.int64)
            bit = mix(h).astype(np.int64) & (bits - 1)[doc]
            parity = np.bincount((np.cumsum(bits) - bits)[doc] + bit, minlength=int(bits.sum())) & 1
            sketch = np.packbits(parity.astype(np.uint8)).view(np.uint64)
            yield {
                "doc_id": batch.column("doc_id"), "n": n, "s1": sums[0][:k].view(np.int64), "s2": sums[1][:k].view(np.int64), "n_rare": rare,
                "rare": lists_of(h[a], np.bincount(doc[a], minlength=k)), "often": lists_of(h[b], np.bincount(doc[b], minlength=k)),
                "sketch": lists_of(sketch, bits // 64),
            }

    return arrow_map(narrow(docs, "doc_id", "text"), run, "doc_id long, n long, s1 long, s2 long, n_rare long, rare array<long>, often array<long>, sketch array<long>")


def index_lists(sets: DataFrame) -> DataFrame:
    """(token, n, id, pos, and the list's central and smallest set) of all
    lists with two sets or more."""
    end = ["n", "id", "pos"]
    ends = [("central", F.struct("pos", "id", "n")), ("small", F.struct("n", "id", "pos"))]
    # Size and position travel in one number.
    rare = sets.select("id", "n", F.posexplode("rare").alias("pos", "token")).select("token", "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np")).repartition("token")
    rare = rare.select("token", "id", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    whole = Window.partitionBy("token")
    listed = rare.select("token", *end, *[F.min(x).over(whole).alias(c) for c, x in ends], (F.min("id").over(whole) != F.max("id").over(whole)).alias("shared"))
    # Frequent shingles: HEAVY_MAX lists at most, so their ends can be
    # broadcast, and no list has to meet in one task.
    often = sets.select("id", "n", "n_rare", F.posexplode("often").alias("k", "token")).select("token", "n", "id", (F.col("n_rare") + F.col("k")).cast("int").alias("pos"))
    edge = often.groupBy("token").agg(*[F.min(x).alias(c) for c, x in ends], (F.min("id") != F.max("id")).alias("shared"))
    return listed.unionByName(often.join(F.broadcast(edge), "token").select(listed.columns)).where("shared").drop("shared")


def overlap(n1: Column, n2: Column) -> Column:
    """The least intersection of linked sets of these sizes: ceil(4/9 sum)."""
    return F.floor((4 * (n1 + n2) + 8) / 9)


def possible(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= overlap(n1, n2))


def near_sketches(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) whose sketches allow a link."""
    small = sets.select("id", "sketch")
    met = pairs.join(small.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(small.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    # Sizes differ by a quarter at most, so one sketch may be twice as long; its
    # halves laid on each other are the shorter sketch of the same set.
    k = F.least(F.size("sa"), F.size("sb"))
    folded = lambda c: F.when(F.size(c) > k, F.zip_with(F.slice(c, 1, k), F.slice(c, k + 1, k), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    apart = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return met.where(apart <= F.col("na") + F.col("nb") - 2 * overlap(F.col("na"), F.col("nb"))).select("a", "b").distinct()


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, verified on whole sets."""
    ids, path = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "compared")
    few = ids.count() <= BROADCAST_IDS
    wanted = narrow(docs, "doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in gathered(batches):
            h, _, n = shingle_sets(batch.column("text"))
            yield {"doc_id": batch.column("doc_id"), "items": lists_of(h, n)}

    sets, sets_path = stored(arrow_map(wanted, run, "doc_id long, items array<long>"), "compared-sets")
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    found, _ = stored(met.where(100 * both >= 80 * (F.size("x") + F.size("y") - both)).select("a", "b").distinct(), "verified")
    dropped(docs.sparkSession, path, sets_path)
    return found


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = narrow(docs, "doc_id", "text")
    spark = docs.sparkSession
    whole, whole_path = stored(described(docs, frequent(docs)), "shingle-sets")
    rows, _ = stored(whole.select("doc_id", "n", "s1", "s2"), "set-names")
    with_set = rows.where("n > 0 and doc_id is not null")
    reps, _ = stored(with_set.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "representatives")
    many = max(MANY_COPIES, math.ceil(rows.count() / BROADCAST_IDS))
    # Copies are fewer than sets mostly, so it is they that are taken out.
    names = ["doc_id", "s1", "s2"]
    copies, copies_path = stored(of_set(with_set, reps, many).where("doc_id != id").select(names).distinct(), "copies")
    few = copies.count() <= BROADCAST_IDS
    sets = whole.where("n > 0 and doc_id is not null").join(F.broadcast(copies) if few else copies, names, "left_anti").withColumnRenamed("doc_id", "id")
    # Repeated rows of one id and text are one set.
    repeated, _ = stored(with_set.groupBy(*names).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias("id"), "s1", "s2"), "repeated-rows")
    n_repeated = repeated.count()
    if n_repeated:
        hint = F.broadcast if n_repeated <= BROADCAST_IDS else (lambda df: df)
        key = ["id", "s1", "s2"]
        sets = sets.join(hint(repeated), key, "left_anti").unionByName(sets.join(hint(repeated), key, "left_semi").dropDuplicates(key))
    lists, lists_path = stored(index_lists(sets.select("id", "n", "n_rare", "rare", "often")), "index-lists")
    sets, sets_path = stored(sets.select("id", "sketch"), "sketches")
    dropped(spark, whole_path, copies_path)

    def pair(other: str) -> DataFrame:
        a, b = F.col("id"), F.col(f"{other}.id")
        fits = possible(F.col("n"), F.col("pos"), F.col(f"{other}.n"), F.col(f"{other}.pos"))
        return lists.where((a != b) & fits).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(a < b, F.col("n")).otherwise(F.col(f"{other}.n")).alias("na"), F.when(a < b, F.col(f"{other}.n")).otherwise(F.col("n")).alias("nb"))

    first, first_path = stored(near_sketches(pair("central").unionByName(pair("small")).distinct(), sets), "first-pairs")
    links = linked(first, docs)
    known, known_path = stored(components(links), "components")
    rest, rest_path = stored(near_sketches(unresolved(lists, known), sets).join(first, ["a", "b"], "left_anti"), "other-pairs")
    if rest.limit(1).count():
        more = linked(rest, docs)
        known, known_path = stored(components(links.unionByName(more)), "components")
    names, _ = stored(reps.join(known, "id", "left").select("s1", "s2", "copies", F.coalesce("component", "id").alias("component_id")), "set-components")
    dropped(spark, lists_path, sets_path, first_path, rest_path, known_path)
    own = of_set(with_set.select("doc_id", "n", "s1", "s2"), names, many).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.unionByName(alone)


def of_set(rows: DataFrame, sets: DataFrame, many: int) -> DataFrame:
    """``rows`` with the columns of their set. A set of ``many`` copies would
    meet in one task; there are at most rows / many of these."""
    key = ["s1", "s2"]
    large = sets.where(F.col("copies") >= many)
    small = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(sets.where(F.col("copies") < many), key)
    return rows.join(F.broadcast(large), key).unionByName(small).drop("copies")


def size_block(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def blocks_of(n: Column, pos: Column) -> Column:
    """(place, size) of the blocks that can hold a partner of an entry: sizes
    within a fifth, at most 9/4 (n - pos) - n for what is left behind the entry,
    and at least 4 n / (5 - 9 r) where r is the least share before the partner."""
    most = F.least(1.25 * n, 2.25 * (n - pos) - n) * (1 + 1e-9)
    every = []
    for k in range(PLACES):
        least = 4 * n / (5 - 9 * PLACE_STEP * k) * (1 - 1e-9)
        place = F.lit(k).alias("place")
        sizes = F.transform(F.sequence(size_block(least), size_block(most)), lambda b: F.struct(place, b.alias("size")))  # noqa: B023
        every.append(F.when(least <= most, sizes).otherwise(F.array().cast("array<struct<place:int,size:int>>")))
    return F.concat(*every)


def unresolved(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of one list that are in different components. In
    each list the component of its central set is the main one; only entries
    of other components look for partners, in the blocks that can hold one."""
    # Only sets that link at all are named.
    few = known.count() <= BROADCAST_IDS
    hint = F.broadcast if few else (lambda df: df)
    labelled = lists.join(hint(known.select("id", "component")), "id", "left").select("token", "id", "n", "pos", F.col("central.id").alias("main_id"), F.coalesce("component", "id").alias("c"))
    main = known.select(F.col("id").alias("main_id"), F.col("component").alias("main_c"))
    labelled = labelled.join(hint(main), "main_id", "left").withColumn("main_c", F.coalesce("main_c", "main_id"))
    labelled, _ = stored(labelled, "labelled-lists")
    minor = labelled.where("c != main_c").select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("c").alias("ca"), F.explode(blocks_of(F.col("n"), F.col("pos"))).alias("block"))
    place = F.least(F.floor(F.col("pos") / F.col("n") / PLACE_STEP), F.lit(PLACES - 1)).cast("int")
    other = labelled.select("token", F.struct(place.alias("place"), size_block(F.col("n")).alias("size")).alias("block"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"), (F.col("c") == F.col("main_c")).alias("is_main"))
    met = minor.join(other, ["token", "block"]).where((F.col("ca") != F.col("cb")) & (F.col("is_main") | (F.col("a") < F.col("b"))) & possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    less = F.col("a") < F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(less, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(less, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
