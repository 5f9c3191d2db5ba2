"""Voice packets: the valid ones, bursts of speech, packet loss, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.text import archive_name, suffix_route, wav_path

# Silence that closes a segment, packet length and the least
# speech of a segment, in microseconds; the largest gap that is concealed, in
# packets; errors in a row before quarantine.
IDLE_US, PACKET_US, MIN_SPEECH_US = 1_500_000, 20_000, 750_000
MAX_CONCEALED, QUARANTINE_AFTER = 75, 3


def valid_packets(packets: DataFrame) -> DataFrame:
    """Packets with a user, a payload and a header."""
    return packets.where(F.col("user_id").isNotNull() & (F.length("payload") > 0) & F.col("sequence").isNotNull())


def with_bursts(packets: DataFrame, keys: list[str], idle_us: int = IDLE_US, at: str = "received_at", order: str = "arrival_no") -> DataFrame:
    """``burst``: a number that grows with each silence of ``idle_us`` or more."""
    w = Window.partitionBy(*keys).orderBy(at, order)
    silence = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    return packets.withColumn("_new", F.coalesce((silence >= idle_us).cast("int"), F.lit(0))).withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def speech_segments(packets: DataFrame, keys: list[str], idle_us: int = IDLE_US, min_speech_us: int = MIN_SPEECH_US, packet_us: int = PACKET_US, session_end: DataFrame | None = None, names: tuple[str, ...] = (), at: str = "received_at", order: str = "arrival_no") -> DataFrame:
    """A row per burst that is long enough: first and last packet's time, number
    of packets, duration (packets times their length, not clock time), and the
    ``names`` of the first packet. With ``session_end`` (session_id, end_at),
    a burst still open at the end of its session is kept however short.
    Only keys, times and names pass the sort, no payload."""
    thin = packets.select(*keys, *names, at, order)
    bursts = with_bursts(thin, keys, idle_us, at, order)
    first = [F.min_by(n, F.struct(at, order)).alias(n) for n in names]
    out = bursts.groupBy(*keys, "burst").agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("n_packets"), *first)
    forced: Column = F.lit(False)
    if session_end is not None:
        out = out.join(session_end.select("session_id", "end_at"), "session_id", "left")
        still_open = F.unix_micros("end_at") - F.unix_micros("ended_at") < idle_us
        forced = F.coalesce((F.col("burst") == F.max("burst").over(Window.partitionBy(*keys))) & still_open, F.lit(False))
    out = out.withColumn("forced", forced).where((F.col("n_packets") * packet_us >= min_speech_us) | F.col("forced"))
    kept = [*keys, "burst", "started_at", "ended_at", "n_packets", (F.col("n_packets") * packet_us / 1e6).alias("duration_s"), *names, "forced"]
    return out.select(*kept)


def with_archive_path(segments: DataFrame, folder: Column, name: str = "character_name") -> DataFrame:
    return segments.withColumn("audio_path", F.concat_ws("/", folder, archive_name("started_at", "user_id", name)))


def routed(segments: DataFrame, files: DataFrame, path: str = "audio_path") -> DataFrame:
    """Segments with ``route`` (``ready``, ``decode`` or ``unsupported``) and
    ``ready_path``, the file to be transcribed: of a packed one, the wav beside it,
    which is there or has to be made. ``files`` (path) are those that exist."""
    there = files.select(F.col("path").alias("_wav"), F.lit(True).alias("_there")).where(F.lower("_wav").endswith(".wav")).distinct()
    met = segments.withColumn("_wav", wav_path(path)).join(there, "_wav", "left")
    route = suffix_route(path, F.coalesce("_there", F.lit(False)))
    ready = F.when(F.lower(F.col(path)).endswith(".wav"), F.col(path)).when(route != "unsupported", F.col("_wav"))
    return met.withColumn("route", route).withColumn("ready_path", ready).select(*segments.columns, "route", "ready_path")


def loss_profile(packets: DataFrame, segment: list[str], limit: int = MAX_CONCEALED, sequence: str = "sequence", order: str = "arrival_no", corrupt: str | None = None) -> DataFrame:
    """Packets, concealed frames, corrupt packets and decoded frames of each
    segment. A gap of 1 to ``limit`` sequence numbers (16 bits, wrapping) is
    concealed; a late packet or a larger gap adds nothing."""
    before = F.lag(sequence).over(Window.partitionBy(*segment).orderBy(order))
    gap = F.pmod(F.col(sequence) - (before + 1), F.lit(65536))
    bad = F.coalesce(F.col(corrupt), F.lit(False)) if corrupt else F.lit(False)
    rows = packets.withColumn("_gap", F.when(gap.between(1, limit), gap).otherwise(0)).withColumn("_bad", bad.cast("int"))
    return rows.groupBy(*segment).agg(F.count(F.lit(1)).alias("n_packets"), F.sum("_gap").alias("concealed"), F.sum("_bad").alias("corrupt")).withColumn("frames", F.col("n_packets") + F.col("concealed"))


def quarantine(packets: DataFrame, key: list[str], order: list[str], outcome: str = "outcome", limit: int = QUARANTINE_AFTER) -> DataFrame:
    """``action`` of each packet: ``pass``, ``drop`` or ``quarantine``. An error
    counts, good data starts anew, no data changes nothing; the ``limit``-th
    error in a row quarantines and starts anew. No data has no action."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((F.col(outcome) == "data").cast("int")).over(w)
    in_run = Window.partitionBy(*key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failed = F.col(outcome) == "error"
    k = F.sum(failed.cast("int")).over(in_run)
    count = F.pmod(k - 1, F.lit(limit)) + 1
    action = F.when(F.col(outcome) == "data", "pass").when(failed & (F.col("failures") == limit), "quarantine").when(failed, "drop")
    return packets.withColumn("_run", run).withColumn("failures", F.when(failed, count).otherwise(0)).withColumn("action", action).drop("_run")
