"""Merging batches into keyed tables, and dense new ids."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def last_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; by partial aggregation, so a key with very
    many rows meets as one row per task."""
    rest = [c for c in batch.columns if c not in keys]
    newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return newest.select(*keys, *[F.col("_last")[c].alias(c) for c in rest]).select(batch.columns)


def numbered(rows: DataFrame, order: str, start: Column, name: str = "id") -> DataFrame:
    """Dense ids after ``start`` by a rising integer column, or by a struct whose
    first field is one. Quantiles of it cut the rows into ranges; each is
    numbered by itself from the number of rows in the ranges before, so no
    single task sees all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / parts for k in range(1, parts)]
    kind = rows.schema[order].dataType
    leading = F.col(order)[kind.names[0]] if isinstance(kind, StructType) else F.col(order)
    bounds = (rows.agg(F.percentile_approx(leading, steps, 1000).alias("b")).first()["b"] if steps else None) or []
    part = F.size(F.filter(F.lit(sorted(set(bounds))).cast("array<bigint>"), lambda b: b < leading)) if bounds else F.lit(0)
    placed = rows.withColumn("_part", part)
    # One number per range.
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    before = [0, *itertools.accumulate(sizes.get(k, 0) for k in range(parts - 1))]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    ahead = F.element_at(F.lit(before).cast("array<bigint>"), F.col("_part") + 1)
    return placed.withColumn("_local", local).withColumn(name, start + ahead + F.col("_local")).drop("_part", "_local")


def merged(existing: DataFrame, batch: DataFrame, keys: list[str], replaced: list[str]) -> DataFrame:
    """``existing`` with the batch's rows by key: matches take ``replaced``
    columns from the batch, others are added; columns of the batch must be
    those of ``existing``. One row per key in the batch. Null keys match nothing."""
    new = batch.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"_new_{c}") for c in existing.columns if c not in keys], F.lit(True).alias("_in"))
    met = existing.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("_old") & (F.col("_in").isNull() if c in replaced else F.lit(True)), F.col(c)).otherwise(F.col(f"_new_{c}"))
    return met.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in existing.columns])
