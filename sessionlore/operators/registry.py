"""Names of speakers: upserts, lookups now and as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.text import strip
from sessionlore.operators.upserts import last_per_key, merged

KEYS = ["guild_id", "user_id"]


def register(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """The registry after updates (guild_id, user_id, character_name,
    updated_at, seq): the last of each key wins. Names are stripped, and may
    be empty."""
    rows = updates.withColumn("character_name", strip("character_name"))
    last = last_per_key(rows, KEYS, ["updated_at", "seq"]).select(existing.columns)
    return merged(existing, last, KEYS, ["character_name", "updated_at"])


def with_names(rows: DataFrame, registry: DataFrame, fallback: str, name: str = "character_name") -> DataFrame:
    """The registered name, an empty one too, else the fallback column."""
    found = registry.select(*KEYS, F.col("character_name").alias("_name"), F.lit(True).alias("_found"))
    return rows.join(found, KEYS, "left").withColumn(name, F.when(F.col("_found"), F.col("_name")).otherwise(F.col(fallback))).drop("_name", "_found")


def with_names_as_of(rows: DataFrame, updates: DataFrame, fallback: str, at: str = "started_at", name: str = "character_name") -> DataFrame:
    """As :func:`with_names`, with the last update at or before ``at``: updates
    and rows are sorted together, one shuffle by key. A null key finds
    nothing; such rows are spread over all tasks."""
    null_key = F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull()
    ups = updates.where(~null_key).select(*KEYS, F.col("updated_at").alias("_at"), F.lit(0).alias("_kind"), F.struct("character_name").alias("_update"), *( [F.col("seq").alias("_seq")] if "seq" in updates.columns else [F.lit(0).alias("_seq")]))
    ups = ups.withColumn("_salt", F.lit(0).cast("long"))
    salt = F.when(null_key, F.monotonically_increasing_id()).otherwise(0)
    mine = rows.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_seq", F.lit(0)).withColumn("_salt", salt)
    w = Window.partitionBy(*KEYS, "_salt").orderBy("_at", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    met = mine.unionByName(ups, allowMissingColumns=True).withColumn("_last", F.last("_update", ignorenulls=True).over(w))
    out = met.where("_kind = 1").withColumn(name, F.when(F.col("_last").isNotNull(), F.col("_last.character_name")).otherwise(F.col(fallback)))
    return out.drop("_at", "_kind", "_seq", "_update", "_last", "_salt")
