"""Operator 5: exact top-k by inner product over a pivot-distance index.

One more coordinate, sqrt(M^2 - |x|^2) with M the longest vector's length
(0 for a query), turns the inner product into a distance: |q' - x'|^2 =
|q|^2 + M^2 - 2 q.x. Vectors are keyed by their nearest pivot and their
distance from it, in rings (annuli) of the pivot, which are sorted by the
triangle inequality for each query: no vector of a ring is nearer than
|d(q,p) - ring|, for its own pivot and for ``REFERENCES`` other ones, whose
least and greatest distance every ring knows. A query expands over its sorted rings
in rounds, each of four times as many vectors, and drops what its k-th distance
so far excludes; it stops when no ring is left within that distance.

The index has at most ``PIVOTS[1] * RINGS`` rings however many vectors there
are; the vectors of a pivot are cut into chunks, and queries into blocks. A block
meets a chunk once a round, and there each query the rings that it visits. Scores are
exact integer sums: float64 products where they stay below 2^53, integers
beyond. A score that does not fit a long is the nearest long.

Pivots are chosen from PIVOT_SAMPLE vectors, which affects speed only. Vectors that
are null, or hold components that are null or not finite (or are not any more,
times 256), take no part, nor does a null vec_id; shorter vectors count as padded with zeros. Repeated
rows each count; rows of one vec_id are no candidates of each other. No rows
give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, as_batch, dropped, stored
from sessionlore.llm.tokens import packed, unpacked

#: Least and greatest number of pivots (between, the root of the rows), rings of
#: a pivot at most, and rows of a ring at least.
PIVOTS, RINGS, RING_ROWS = (32, 512), 32, 16
REFERENCES = 16
PIVOT_SAMPLE = 4096
CHUNK_ROWS, BLOCK_QUERIES = 8192, 2048
#: Vectors of the first round, and how many times as many each further one has.
FIRST_ROWS, GROWTH = 512, 4
F8 = np.dtype("<f8")
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, dim, sq, v): floor(factor * x) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column("embedding").cast(pa.large_list(pa.float64()))
            n = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            x = pa.compute.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore"):
                x = factor * x
            bad = np.bincount(row[~np.isfinite(x)], minlength=len(n)) > 0
            good = column.is_valid().to_numpy(zero_copy_only=False) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & ~bad
            v = np.floor(x[good[row]])
            sq = np.bincount(row[good[row]], weights=v * v, minlength=len(n))[good]
            yield {"vec_id": batch.column("vec_id").filter(pa.array(good)), "dim": n[good], "sq": sq, "v": packed(v.astype(F8), n[good])}

    return arrow_map(vectors.select("vec_id", "embedding"), run, "vec_id long, dim long, sq double, v binary")


def padded(column: pa.Array, n: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = unpacked(column, F8)
    return out


class Index:
    """Pivots, and each ring's inner and outer distance and rows."""

    def __init__(self, pivots: np.ndarray, width: int, longest: float):
        self.pivots, self.width, self.longest = pivots, width, longest
        self.rest = np.sqrt(np.maximum(longest - (pivots**2).sum(1), 0))
        self.norm = (pivots**2).sum(1)

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """From each row to each pivot, in the longer space."""
        sq = (x**2).sum(1)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - sq, 0))
        d = sq[:, None] + self.norm - 2 * x @ self.pivots.T + (rest[:, None] - self.rest) ** 2
        return np.sqrt(np.maximum(d, 0))

    def rings(self, cells: list, chunk: int = CHUNK_ROWS) -> None:
        """``cells`` by pivot and ring."""
        self.cell = np.array([(r["pivot"], r["ring"]) for r in cells], np.int64).reshape(-1, 2)
        self.inner, self.outer = np.array([r["inner"] for r in cells]), np.array([r["outer"] for r in cells])
        self.low, self.high = np.array([r["low"] for r in cells]).T, np.array([r["high"] for r in cells]).T
        self.count = np.array([r["n"] for r in cells], np.int64)
        #: Where each pivot's rings begin, its number, and its number of chunks.
        self.begin = np.flatnonzero(np.diff(self.cell[:, 0], prepend=-1))
        self.pivot = self.cell[self.begin, 0]
        self.chunks = -(-np.add.reduceat(self.count, self.begin) // chunk)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The least distance of a vector in each ring, for each query; a
        little less, for rounding."""
        every = self.distances(x, True)
        d = every[:, self.cell[:, 0]]
        least = np.maximum(d - self.outer, self.inner - d)
        for k in range(len(self.low)):
            np.maximum(least, every[:, k, None] - self.high[k], out=least)
            np.maximum(least, self.low[k] - every[:, k, None], out=least)
        return np.nan_to_num(np.maximum(least * (1 - 1e-9) - 1e-6 * (1 + math.sqrt(self.longest)), 0))


def build(rows: DataFrame) -> tuple[DataFrame, Index] | None:
    """Vectors with pivot, ring and chunk, stored; and the index."""
    seen = rows.agg(F.max("dim").alias("width"), F.max("sq").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    if seen["width"] is None:
        return None
    width, n = int(seen["width"]), int(seen["n"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    x = padded(pa.array(sample["v"], pa.binary()), sample["dim"].to_numpy(), width)
    index = Index(spaced(np.unique(x, axis=0), min(max(PIVOTS[0], math.isqrt(n)), PIVOTS[1])), width, float(seen["longest"]))
    refs = min(REFERENCES, len(index.pivots))

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            d = index.distances(padded(batch.column("v"), batch.column("dim").to_numpy(), width), False)
            best = d.argmin(1)
            yield {c: batch.column(c) for c in ("vec_id", "dim", "v")} | {"pivot": best, "distance": d[np.arange(len(d)), best], "refs": list(d[:, :refs])}

    kept = "vec_id long, dim long, v binary, pivot int, distance double, refs array<double>"
    near, near_path = stored(arrow_map(rows, keyed, kept), "pivots")
    n_rings = min(RINGS, max(2, n // (len(index.pivots) * RING_ROWS)))
    steps = ", ".join(str(k / n_rings) for k in range(1, n_rings))
    edges = {r["pivot"]: r["e"] for r in near.groupBy("pivot").agg(F.expr(f"percentile_approx(distance, array({steps}), 1000)").alias("e")).collect()}

    def ringed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            pivot, distance = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy()
            ring = np.zeros(len(pivot), np.int64)
            for p in np.unique(pivot):
                ring[pivot == p] = np.searchsorted(edges[p], distance[pivot == p])
            yield {c: batch.column(c) for c in ("vec_id", "dim", "v", "pivot", "distance", "refs")} | {"ring": ring}

    placed = arrow_map(near, ringed, f"{kept}, ring int")
    reach = [F.array(*[f(F.col("refs")[k]) for k in range(refs)]).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    cells = placed.groupBy("pivot", "ring").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count(F.lit(1)).alias("n"), *reach).orderBy("pivot", "ring").collect()
    index.rings(cells)
    chunks = np.zeros(len(index.pivots), np.uint64)
    chunks[index.pivot] = index.chunks

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            h = batch.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield {c: batch.column(c) for c in ("vec_id", "dim", "v", "pivot", "ring")} | {"chunk": ((h >> np.uint64(32)) % chunks[batch.column("pivot").to_numpy()]).astype(np.int64)}

    indexed, _ = stored(arrow_map(placed, cut, "vec_id long, dim long, v binary, pivot int, ring int, chunk int"), "rings")
    dropped(rows.sparkSession, near_path)
    return indexed, index


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, held within a long."""
    size = lambda t: math.sqrt(float((t * t).sum(1).max(initial=0)))
    most = size(q) * size(x)
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62 and max(np.abs(q).max(), np.abs(x).max()) < 2.0**62:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    whole = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
    return np.clip(whole, int(LONG.min), int(LONG.max)).astype(np.int64)


def spaced(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other, by farthest-first choice from the sample."""
    chosen = [int((x**2).sum(1).argmax())]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries vec_id % every == 0."""
    return searched(vectors, every, k)[0]


def searched(vectors: DataFrame, every: int = 50, k: int = 5, counted: bool = False) -> tuple[DataFrame, float | None]:
    """The rows of :func:`top_k`; and, if ``counted``, the share of all pairs of
    a query and a vector that were compared."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    rows, rows_path = stored(quantised(vectors), "vectors")
    built = build(rows)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), None
    indexed, index = built
    queries, _ = stored(rows.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), "queries")
    dropped(spark, rows_path)
    n_queries = queries.count()
    blocks = max(1, math.ceil(n_queries / BLOCK_QUERIES))

    def visits(begin: int, end: int):
        """Rows (pivot, chunk, block, query, rings) with the rings to visit, a bit
        each: those that have from ``begin`` to ``end`` vectors before them in a
        query's order and are within its k-th distance so far."""

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    part = batch.slice(at, 128)
                    x = padded(part.column("v"), part.column("dim").to_numpy(), index.width)
                    low = index.bounds(x)
                    order = np.argsort(low, 1, kind="stable")
                    before = np.cumsum(index.count[order], 1) - index.count[order]
                    near = np.zeros(low.shape, bool)
                    np.put_along_axis(near, order, (before >= begin) & (before < end), 1)
                    kth = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                    limit = (x**2).sum(1) + index.longest - 2 * kth
                    reach = np.where(np.isnan(kth) | (kth <= LONG.min), np.inf, np.sqrt(np.maximum(limit, 0)))
                    near &= low <= reach[:, None]
                    rings = np.add.reduceat(near << index.cell[:, 1], index.begin, axis=1)
                    rows = np.add.reduceat(near * index.count, index.begin, axis=1)
                    q, at_pivot = np.nonzero(rings)
                    n = index.chunks[at_pivot]
                    q, at_pivot = np.repeat(q, n), np.repeat(at_pivot, n)
                    chunk = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                    ids = part.column("vec_id").take(pa.array(q))
                    yield {
                        "pivot": index.pivot[at_pivot], "chunk": chunk, "block": np.abs(ids.to_numpy()) // every % blocks, "query_id": ids, "rings": rings[q, at_pivot],
                        "q_dim": part.column("dim").take(pa.array(q)), "q": part.column("v").take(pa.array(q)), "share": rows[q, at_pivot] / index.chunks[at_pivot],
                    }

        return run

    visit_schema = "pivot int, chunk int, block int, query_id long, rings long, q_dim long, q binary, share double"
    target = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray):
        score, own = products(q, x), q_ids[:, None] == ids
        score[own] = LONG.min
        kth = np.partition(score, len(ids) - min(k, len(ids)), 1)[:, len(ids) - min(k, len(ids))]
        r, c = np.nonzero((score >= kth[:, None]) & ~own)
        order = np.lexsort((c, ~score[r, c], r))  # ~s falls as s grows
        r, c = r[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[place < k], c[place < k]
        return q_ids[r], ids[c], score[r, c]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            x, rings = padded(left["v"].combine_chunks(), left["dim"].to_numpy(), index.width), left["ring"].to_numpy()
            ids = left["vec_id"].to_numpy()
            order = np.lexsort((ids, rings))
            x, ids, rings = x[order], ids[order], rings[order]
            asked, q_ids, q = right["rings"].to_numpy(), right["query_id"].to_numpy(), padded(right["q"].combine_chunks(), right["q_dim"].to_numpy(), index.width)
            begin = np.flatnonzero(np.diff(rings, prepend=-1))
            for low, high in zip(begin, [*begin[1:], len(rings)], strict=True):
                some = np.flatnonzero(asked >> rings[low] & 1)
                out += [nearest(q_ids[some[at : at + 256]], q[some[at : at + 256]], ids[low:high], x[low:high]) for at in range(0, len(some), 256)]
        q_id, vec_id, score = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((vec_id, ~score, q_id))  # the best of all rings
        order = order[np.arange(len(order)) - np.searchsorted(q_id[order], q_id[order]) < k]
        columns = [q_id[order], vec_id[order], score[order]]
        return pa.Table.from_batches([as_batch(dict(zip(target.names, columns, strict=True)), target)])

    def search(visit: DataFrame) -> DataFrame:
        # Each block of queries meets each chunk that one of them visits.
        key = ["pivot", "chunk", "block"]
        wanted = visit.select(*[F.col(c).alias(c) for c in key]).distinct()
        left = indexed.join(wanted, ["pivot", "chunk"])
        return left.groupBy(*key).cogroup(visit.drop("share").groupBy(*key)).applyInArrow(best, schema)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = spark.createDataFrame([], f"{schema}, rank int")
    begin, end, compared, path = 0, FIRST_ROWS, 0.0, None
    while begin < int(index.count.sum()):
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
        visit = arrow_map(queries.join(kth, "vec_id", "left").select("vec_id", "dim", "v", "kth"), visits(begin, end), visit_schema)
        if counted:
            compared += visit.agg(F.sum("share")).first()[0] or 0.0
        known = found.drop("rank").unionByName(search(visit)).withColumn("rank", rank).where(F.col("rank") <= k)
        found, new_path = stored(known, "nearest")
        if path:
            dropped(spark, path)
        begin, end, path = end, end * GROWTH, new_path
    return found.select("query_id", "rank", "vec_id", "score"), compared / max(1, n_queries * int(index.count.sum())) if counted else None
