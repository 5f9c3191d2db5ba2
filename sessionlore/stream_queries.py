"""Queries over streams whose triggers are out of order: events arrive up to half a
day late, in several triggers. Results hold what the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.operators import slices
from sessionlore.queries import _QUARANTINE, GAP_US, MIN_US, _events, _outcomes, _replayed, query
from sessionlore.sources.shared import new_path
from sessionlore.streaming import live

#: Files of a trigger, and triggers.
FILES, TRIGGERS = 8, 5
LATE_S, DELAY, DELAY_US = 43_200, "1 day", 86_400_000_000
#: The last watermark, in whole milliseconds.
_MARK = f"(SELECT max(epoch_us(ts)) // 1000 * 1000 - {DELAY_US} FROM events)"


def disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, by arrival: each up to LATE_S after its time."""
    rows = _events(spark, sf_dir).withColumn("arrival", F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_S)) * 1_000_000)
    folder = new_path(spark, "arrivals")
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    cuts = [first + (last - first) * k // TRIGGERS for k in range(TRIGGERS)] + [last + 1] if first is not None else [0, 1]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        rows.where((F.col("arrival") >= begin) & (F.col("arrival") < end)).repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


@query(f"""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'purchase' AS ended FROM events),
g AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY user_id ORDER BY us, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS era FROM e),
x AS (SELECT user_id, era, us AS end_us FROM g WHERE ended),
p AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id, era ORDER BY us) >= {GAP_US})::INT, 0) AS new FROM g WHERE NOT ended),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id, era ORDER BY us ROWS UNBOUNDED PRECEDING) AS burst FROM p),
s AS (SELECT user_id, era, burst, min(us) AS started_us, max(us) AS ended_us, count(*) AS n, arg_min(event_id, us) AS first_event, burst = max(burst) OVER (PARTITION BY user_id, era) AS last FROM b GROUP BY user_id, era, burst)
SELECT user_id, started_us, ended_us, n::BIGINT AS n_packets, forced, 'event ' || first_event AS name FROM (SELECT s.*, end_us, coalesce(last AND end_us - ended_us < {GAP_US}, false) AS forced FROM s LEFT JOIN x USING (user_id, era))
WHERE (forced OR n * 20000 >= {MIN_US}) AND (coalesce(last AND end_us < {_MARK}, false) OR ended_us + {GAP_US} <= {_MARK})
""")
def live_segments_disordered(spark, sf_dir):
    """Bursts with the name of their first packet; purchases end a session."""
    rows = disordered(spark, sf_dir).select("user_id", "ts", (F.col("event_type") == "purchase").alias("ended"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"))
    done = _replayed(spark, live.live_segments_with_end(rows, ["user_id"], GAP_US, MIN_US, delay=DELAY, at="ts", ended="ended", names=("name",)), "live-ends")
    return done.select("user_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "n_packets", "forced", "name")


@query(f"SELECT q.event_id, q.user_id, q.action FROM ({_QUARANTINE}) q JOIN events e USING (event_id) WHERE epoch_us(e.ts) < {_MARK}")
def live_quarantine_disordered(spark, sf_dir):
    """Failures count in order of time and id over all triggers."""
    rows = live.live_quarantine(_outcomes(disordered(spark, sf_dir)), "event_id", key="user_id", at="ts", delay=DELAY)
    return _replayed(spark, rows, "live-quarantine").select("event_id", "user_id", "action")


@query(f"""
SELECT c.event_id, c.user_id, coalesce(u.name, 'user ' || c.user_id) AS character_name
FROM (SELECT * FROM events WHERE event_type = 'click' AND epoch_us(ts) < {_MARK}) c
LEFT JOIN LATERAL (SELECT 'name ' || s.event_id AS name FROM events s WHERE s.event_type = 'signup' AND s.user_id = c.user_id AND s.ts <= c.ts ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) u ON true
""")
def live_names_asof(spark, sf_dir):
    """A stream of starts and one of name updates, both out of order. All other events
    stand for starts too, so that both have the same last watermark; they are left out at the end."""
    rows = disordered(spark, sf_dir).withColumn("guild_id", F.lit(1))
    updates = rows.where("event_type = 'signup'").select("guild_id", "user_id", F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("character_name"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    starts = rows.select("guild_id", "user_id", "event_id", "event_type", F.col("ts").alias("started_at"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("fallback"))
    done = _replayed(spark, live.live_names_as_of(starts, updates, "fallback", delay=DELAY), "live-names")
    return done.where("event_type = 'click'").select("event_id", "user_id", "character_name")


# ---- one speaker that has all rows -------------------------------------------
_ONE = f"""
SELECT burst::BIGINT AS burst, min(us) AS started_us, max(us) AS ended_us, count(*)::BIGINT AS n_packets FROM (
  SELECT us, sum(new) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM (
    SELECT event_id, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) >= 300000000)::INT, 0) AS new FROM events)) GROUP BY burst
"""


@query(_ONE)
def hot_speaker_bursts(spark, sf_dir):
    """All events as one speaker's, by slices of a day; five minutes of silence cut."""
    rows = slices.with_bursts(_events(spark, sf_dir).select(F.lit(1).alias("speaker"), "ts", "event_id"), ["speaker"], 300_000_000, "ts", "event_id", slice_us=86_400_000_000)
    return rows.groupBy("burst").agg(F.min(F.unix_micros("ts")).alias("started_us"), F.max(F.unix_micros("ts")).alias("ended_us"), F.count(F.lit(1)).alias("n_packets"))


@query("""
SELECT count(*)::BIGINT AS n_packets, sum(CASE WHEN gap BETWEEN 1 AND 75 THEN gap ELSE 0 END)::BIGINT AS concealed, sum((event_type = 'error')::INT)::BIGINT AS corrupt
FROM (SELECT event_type, ((event_id % 65536 - lag(event_id % 65536) OVER (ORDER BY ts, event_id) - 1) % 65536 + 65536) % 65536 AS gap FROM events)
""")
def hot_speaker_loss(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.lit(1).alias("speaker"), "ts", F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 65536).alias("sequence"), (F.col("event_type") == "error").alias("corrupt"))
    return slices.loss_profile(rows, ["speaker"], slices.by_time("ts", 86_400_000_000), order="at", corrupt="corrupt").select("n_packets", "concealed", "corrupt")


@query(_QUARANTINE.replace("PARTITION BY user_id, run", "PARTITION BY run").replace("PARTITION BY user_id ", ""))
def hot_speaker_quarantine(spark, sf_dir):
    rows = _outcomes(_events(spark, sf_dir)).withColumn("speaker", F.lit(1))
    done = slices.quarantine(rows, ["speaker"], ["ts", "event_id"], slices.by_time("ts", 86_400_000_000))
    return done.select("event_id", "user_id", F.col("failures").cast("long").alias("failures"), "action")
