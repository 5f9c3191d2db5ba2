"""Shared helpers: the folder that all executors see, and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sessionlore.sources.shared import new_path

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A mapInArrow task works on slices of about so many bytes of text.
SLICE_BYTES = 2 << 20


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later plan reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns with clashing names do
    not matter."""
    return docs.select(*[docs[c] for c in columns])


def arrow_map(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]],
    schema: str,
) -> DataFrame:
    """mapInArrow for a function that yields dicts of columns. Where the
    session has Spark's default of 10,000 rows a batch it is lowered, since
    texts may be long; it stays so, as the plan runs later and reads it then."""
    target = to_arrow_schema(StructType.fromDDL(schema))
    if df.sparkSession.conf.get(BATCH_ROWS, "10000") == "10000":
        df.sparkSession.conf.set(BATCH_ROWS, "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield as_batch(columns, target)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def one_blas_thread() -> None:
    """Small products are slower on more threads, and a task has one core."""
    import ctypes
    from pathlib import Path

    import numpy as np

    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def as_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in target:
        value = columns[field.name]
        if isinstance(value, pa.ChunkedArray):
            value = value.combine_chunks()
        if not isinstance(value, pa.Array):
            value = pa.array(value, field.type)
        elif value.type != field.type:
            value = value.cast(field.type)
        arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def slices(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``limit`` bytes; a longer text is a
    slice of its own. Rows of small batches are not joined across batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = pc.cumulative_sum(pc.cast(sizes, pa.int64())).to_numpy(zero_copy_only=False)
        begin, base = 0, 0
        while begin < batch.num_rows:
            end = int(ends.searchsorted(base + limit, "right"))
            end = max(end, begin + 1)
            yield batch.slice(begin, end - begin)
            base, begin = int(ends[end - 1]), end


def gathered(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """As :func:`slices`, and small batches are joined up to the limit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in slices(batches, text, limit):
        n = part.column(text)
        length = pc.sum(pc.binary_length(n)).as_py() or 0
        if held and size + length > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += length
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def row_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes, for numbers of blocks and shards."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def without(docs: DataFrame, rejected: DataFrame, few: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``rejected``; these ids are
    stored, and broadcast only if they are few (8 bytes each). Rows with a
    null doc_id stay."""
    ids, _ = stored(rejected.select("doc_id").where("doc_id is not null").distinct(), "rejected")
    return docs.join(F.broadcast(ids) if ids.count() <= few else ids, "doc_id", "left_anti").select(docs.columns)


def once(docs: DataFrame, few: int = 500_000) -> DataFrame:
    """``docs`` with one of the rows that have one doc_id and one text; rows with a null
    doc_id all stay. Texts move only where an id is repeated."""
    ids, path = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = ids.count()
    if not n:
        dropped(docs.sparkSession, path)
        return docs
    hint = F.broadcast(ids) if n <= few else ids
    again = docs.join(hint, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(hint, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))
