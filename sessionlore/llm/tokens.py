"""Operator 6: token ids in files, in a frequency-ranked variable-length code.

A file (one Parquet part, written by Spark's own committer) is a row of
blocks of consecutive documents. Each id is stored as its frequency rank, in
1 to 4 bytes of the block's ``data``; two bits per id in the separate
``control`` bytes give that length (lowest bits first, four ids a byte, each
document begins with a fresh control byte). The rank table is a file beside
the blocks. Reading looks control bytes up in a 256 x 4 table of lengths.

Nulls: a null text has no ids of its own (only the end id); rows whose doc_id
is null are kept and come first. Repeated doc_ids keep all their rows. An
empty table gives empty files and an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.llm.common import arrow_map, gathered, narrow, new_path, row_bytes, slices, stored
from sessionlore.llm.subwords import Subwords, default_path
from sessionlore.llm.textvec import spread

#: Text bytes for each partition of files, and ids for each block.
FILE_BYTES = 48 << 20
BLOCK_IDS = 1 << 20

#: Lengths that the four 2-bit fields of a control byte stand for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of whole texts, packed in 16 bits each
    (32 for a vocabulary of over 65,536)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]):
        coder = Subwords.of(path)
        for batch in gathered(batches):
            ids, n = coder.encode(batch.column("text"))
            yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids": packed(ids, n)}

    return arrow_map(narrow(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids binary")


def packed(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column whose rows hold n[0], n[1], ... items of ``flat``."""
    offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int64) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def unpacked(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    """All items of a binary column in a row."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(dtype) if data is not None else np.zeros(0, dtype)


def id_counts(tokens: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """How often each id of the vocabulary occurs; as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column("ids"), dtype), minlength=size)
        used = np.flatnonzero(total)
        yield {"id": used, "n": total[used]}

    counts = np.zeros(size, np.int64)
    for row in arrow_map(tokens.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def encoded(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents with n[0], n[1], ... ranks;
    and how many of each every document has."""
    code = ((ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    mask = np.arange(4) <= code[:, None]
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[mask]
    groups = -(-n // 4)
    fields = np.zeros(int(groups.sum()) * 4, np.uint8)
    fields[spread((np.cumsum(groups) - groups) * 4, n)] = code
    fields = fields.reshape(-1, 4)
    control = fields[:, 0] | fields[:, 1] << 2 | fields[:, 2] << 4 | fields[:, 3] << 6
    sums = np.concatenate(([0], np.cumsum(code.astype(np.int64) + 1)))
    ends = np.cumsum(n)
    return control, data, groups, sums[ends] - sums[ends - n]


def decoded(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of documents with n[0], n[1], ... ids, by table lookup."""
    groups = -(-n // 4)
    lengths = LENGTHS[control].reshape(-1)[spread((np.cumsum(groups) - groups) * 4, n)]
    out = np.zeros((len(lengths), 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = data
    return out.view("<u4").reshape(-1)


def write_files(docs: DataFrame, target: str, path: str | None = None, end_id: int = 1) -> None:
    """Write the ids of all ``docs`` in ascending order of doc_id: the files
    in ``target``/blocks, the rank table in ``target``/ranks."""
    path = path or default_path()
    spark = docs.sparkSession
    coder = Subwords.of(path)
    size, dtype = max(coder.size, end_id + 1), coder.dtype
    _, text_bytes = row_bytes(docs)
    tokens, _ = stored(tokenized(docs, path), "tokens")
    counts = id_counts(tokens, dtype, size)
    counts[end_id] += tokens.count()
    by_rank = np.argsort(-counts, kind="stable")
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{target}/ranks")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size)

    def encode(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches, "ids", 4 << 20):
            n = batch.column("n_tokens").to_numpy() + 1
            ranks = np.full(int(n.sum()), rank[end_id], np.uint32)
            ranks[spread(np.cumsum(n) - n, n - 1)] = rank[unpacked(batch.column("ids"), dtype)]
            control, data, a, b = encoded(ranks, n)
            yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "control": packed(control, a), "data": packed(data, b)}

    rows = arrow_map(tokens, encode, "doc_id long, n_tokens long, control binary, data binary")
    n_files = max(1, math.ceil(text_bytes / FILE_BYTES))
    # Rows of one id (a null, say) go in order of their hash; the row number spreads equal ones.
    keyed = rows.withColumn("h", F.xxhash64("control", "data")).withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(n_files, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").drop("h", "row")

    def blocks(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        for batch in gathered(batches, "data", BLOCK_IDS):
            n = batch.column("n_tokens").to_numpy()
            yield {
                "shard": [shard], "block": [block], "n_ids": [int(n.sum())],
                "doc_ids": pa.ListArray.from_arrays([0, len(n)], batch.column("doc_id")),
                "lengths": pa.ListArray.from_arrays([0, len(n)], batch.column("n_tokens")),
                "control": [unpacked(batch.column("control"), np.uint8).tobytes()],
                "data": [unpacked(batch.column("data"), np.uint8).tobytes()],
            }
            block += 1

    schema = "shard int, block int, n_ids long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    arrow_map(ordered, blocks, schema).write.option("compression", "zstd").parquet(f"{target}/blocks")


def read_files(spark, target: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of files written by
    :func:`write_files`; ids are packed in 32 bits each. ``start`` counts the
    ids of all documents before. With ``digest``, ``ids_crc32`` is taken while
    decoding and stands in place of the ids, which then move nowhere."""
    by_rank = np.frombuffer(spark.read.parquet(f"{target}/ranks").first()["ids"], "<u4")
    blocks = spark.read.parquet(f"{target}/blocks")
    # One row per file here: the running sum over files stays small.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    in_shard = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_ids").over(in_shard) - F.col("n_ids")).alias("block_start")).join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = row.column("lengths").flatten().to_numpy()
                ranks = decoded(np.frombuffer(row.column("control")[0].as_buffer(), np.uint8), np.frombuffer(row.column("data")[0].as_buffer(), np.uint8), n)
                ids, k = by_rank[ranks], len(n)
                content = {"ids_crc32": crc32s(ids, n)} if digest else {"ids": packed(ids, n)}
                yield {
                    "shard": np.repeat(row.column("shard").to_numpy(), k), "block": np.repeat(row.column("block").to_numpy(), k),
                    "doc_id": row.column("doc_ids").flatten(), "inside": np.cumsum(n) - n, "n_tokens": n,
                } | content

    last = "ids_crc32" if digest else "ids"
    schema = f"shard int, block int, doc_id long, inside long, n_tokens long, {last} {'long' if digest else 'binary'}"
    docs = arrow_map(blocks.drop("n_ids"), decode, schema)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", last)


def crc32s(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each document's ids as little-endian 32-bit numbers."""
    raw, ends = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), np.cumsum(n) * 4
    return np.array([zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], np.int64)


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 1, digest: bool = False) -> DataFrame:
    """Write all documents to files in the shared folder, and read them back."""
    target = new_path(docs.sparkSession, "token-files")
    write_files(docs, target, path, end_id)
    return read_files(docs.sparkSession, target, digest)
