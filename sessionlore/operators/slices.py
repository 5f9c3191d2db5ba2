"""Speakers that do not fit one task: bursts, packet loss and quarantine by slices.

Rows of a key are cut into slices of its order (of time, or of numbers), and a slice,
not a key, is what one task holds. What happens at the border of two slices follows
from a summary of each: its first and last row, its counts, or its open run. A scan
over a key's summaries, a row a slice, carries that on. Results are those of the
functions of the same names in :mod:`sessionlore.operators.packets`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.operators.packets import IDLE_US, MAX_CONCEALED, QUARANTINE_AFTER

# Fixed value: an hour; at 50 packets a second that is 180,000 rows of a speaker.
SLICE_US = 3_600_000_000


def by_time(at: str, slice_us: int = SLICE_US) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(slice_us)).cast("long")


def by_number(order: str, rows: int = 200_000) -> Column:
    return F.floor(F.col(order) / F.lit(rows)).cast("long")


def _back(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their slice's columns; null keys are equal here, as in a window."""
    named = summary.select(F.col("_slice").alias("_at_slice"), *[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in summary.columns if c not in (*keys, "_slice")])
    same = F.col("_slice").eqNullSafe(F.col("_at_slice"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(named, same, "left").drop("_at_slice", *[f"_of_{k}" for k in keys])


def with_bursts(packets: DataFrame, keys: list[str], idle_us: int = IDLE_US, at: str = "received_at", order: str = "arrival_no", slice_us: int = SLICE_US) -> DataFrame:
    """``burst``: a number that grows with each silence of ``idle_us`` or more."""
    rows = packets.withColumn("_slice", by_time(at, slice_us)).withColumn("_us", F.unix_micros(at))
    w = Window.partitionBy(*keys, "_slice").orderBy(at, order)
    new = F.coalesce((F.col("_us") - F.lag("_us").over(w) >= idle_us).cast("int"), F.lit(0))
    rows = rows.withColumn("_new", new).withColumn("_inside", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    summary = rows.groupBy(*keys, "_slice").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.sum("_new").alias("_cuts"))
    scan = Window.partitionBy(*keys).orderBy("_slice")
    silent = F.coalesce((F.col("_first") - F.lag("_last").over(scan) >= idle_us).cast("long"), F.lit(0))
    summary = summary.withColumn("_silent", silent)
    before = F.sum(F.col("_cuts") + F.col("_silent")).over(scan.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cuts")
    met = _back(rows, summary.select(*keys, "_slice", before.alias("_base")), keys)
    return met.withColumn("burst", F.col("_base") + F.col("_inside")).drop("_slice", "_us", "_new", "_inside", "_base")


def loss_profile(packets: DataFrame, segment: list[str], slice_of: Column, limit: int = MAX_CONCEALED, sequence: str = "sequence", order: str = "arrival_no", corrupt: str | None = None) -> DataFrame:
    """(segment, n_packets, concealed, corrupt, frames); ``slice_of`` must rise with
    ``order``. Only summaries leave a slice."""
    bad = F.coalesce(F.col(corrupt), F.lit(False)) if corrupt else F.lit(False)
    concealed = lambda now, before: F.when((gap := F.pmod(now - (before + 1), F.lit(65536))).between(1, limit), gap).otherwise(0)
    rows = packets.select(*segment, slice_of.alias("_slice"), F.col(order).alias("_at"), F.col(sequence).alias("_no"), bad.cast("int").alias("_bad"))
    w = Window.partitionBy(*segment, "_slice").orderBy("_at")
    rows = rows.withColumn("_gap", concealed(F.col("_no"), F.lag("_no").over(w)))
    summary = rows.groupBy(*segment, "_slice").agg(F.min_by("_no", "_at").alias("_first"), F.max_by("_no", "_at").alias("_last"), F.count(F.lit(1)).alias("n"), F.sum("_gap").alias("gap"), F.sum("_bad").alias("bad"))
    scan = Window.partitionBy(*segment).orderBy("_slice")
    summary = summary.withColumn("border", concealed(F.col("_first"), F.lag("_last").over(scan)))
    out = summary.groupBy(*segment).agg(F.sum("n").alias("n_packets"), F.sum(F.col("gap") + F.col("border")).alias("concealed"), F.sum("bad").alias("corrupt"))
    return out.withColumn("frames", F.col("n_packets") + F.col("concealed"))


def quarantine(packets: DataFrame, key: list[str], order: list[str], slice_of: Column, outcome: str = "outcome", limit: int = QUARANTINE_AFTER) -> DataFrame:
    """``failures`` and ``action`` of each packet; ``slice_of`` must rise with
    ``order``. A slice's summary is whether it has good data, and its errors since
    the last of them; errors go on through slices without any."""
    rows = packets.withColumn("_slice", slice_of)
    w = Window.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failed, good = (F.col(outcome) == "error"), (F.col(outcome) == "data")
    rows = rows.withColumn("_run", F.coalesce(F.sum(good.cast("int")).over(w), F.lit(0)))
    in_run = Window.partitionBy(*key, "_slice", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_k", F.coalesce(F.sum(failed.cast("int")).over(in_run), F.lit(0)))
    summary = rows.groupBy(*key, "_slice").agg(F.max("_run").alias("_runs"), F.max(F.struct("_run", "_k"))["_k"].alias("_open"))
    scan = Window.partitionBy(*key).orderBy("_slice")
    summary = summary.withColumn("_era", F.sum((F.col("_runs") > 0).cast("int")).over(scan.rowsBetween(Window.unboundedPreceding, 0)))
    era = Window.partitionBy(*key, "_era").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn("_sum", F.sum("_open").over(era)).withColumn("_carried", F.coalesce(F.lag("_sum").over(scan), F.lit(0)))
    met = _back(rows, summary.select(*key, "_slice", "_carried"), key)
    k = F.col("_k") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)
    count = F.pmod(k - 1, F.lit(limit)) + 1
    met = met.withColumn("failures", F.when(failed, count).otherwise(0))
    action = F.when(good, "pass").when(failed & (F.col("failures") == limit), "quarantine").when(failed, "drop")
    return met.withColumn("action", action).drop("_slice", "_run", "_k", "_carried")
