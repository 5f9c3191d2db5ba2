"""Model chunks of transcripts that need not fit one value: the same as
:func:`sessionlore.functions.text.transcript_chunks` of whole transcripts.

Lines are numbered and their lengths summed up without their texts. For each line it
is known where a chunk that begins there would end; which of these chunks are real is
found from the first line by doubling: each step follows twice as many chunks at once. Only then
do texts meet, a chunk at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.text import CHUNK_LIMIT, LINE_END, SINGLE_PASS_LIMIT, TRANSCRIPT_HEADING, is_usable, speaker_label, strip
from sessionlore.operators.transcripts import transcripts

#: What stands before the first line, and the last line end.
_AROUND = len(TRANSCRIPT_HEADING) + 3


def chunk_starts(lines: DataFrame, limit: int, persist: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(session_id, line) of the lines (session_id, line, start, end: sums of costs)
    at which a chunk begins: whole lines fill it up to ``limit``, at least one."""
    ends = lines.select("session_id", F.col("end").alias("at"), F.lit(0).alias("asks"), "line")
    asks = lines.select("session_id", (F.col("start") + limit).alias("at"), F.lit(1).alias("asks"), "line")
    w = Window.partitionBy("session_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("asks") == 0, F.col("line"))).over(w)
    found = ends.unionByName(asks).withColumn("last", last).where("asks = 1")
    # A line of its own where none fits.
    jumps = found.select("session_id", "line", (F.greatest("last", "line") + 1).alias("next"))
    jumps = persist(jumps.join(lines.groupBy("session_id").agg(F.max("line").alias("most")), "session_id").where(F.col("next") <= F.col("most")).drop("most"), "chunk-jumps")
    starts = persist(lines.where("line = 0").select("session_id", "line"), "chunk-starts")
    step = 0
    while not jumps.isEmpty():
        step += 1
        more = starts.join(jumps, ["session_id", "line"]).select("session_id", F.col("next").alias("line"))
        starts = persist(starts.unionByName(more), f"chunk-starts-{step}")
        after = jumps.select("session_id", F.col("line").alias("next"), F.col("next").alias("beyond"))
        jumps = persist(jumps.join(after, ["session_id", "next"]).select("session_id", "line", F.col("beyond").alias("next")), f"chunk-jumps-{step}")
    return starts


def chunks(sessions: DataFrame, segments: DataFrame, persist: Callable[[DataFrame, str], DataFrame], single_pass: int = SINGLE_PASS_LIMIT, limit: int = CHUNK_LIMIT) -> DataFrame:
    """(session_id, stage, chunk_no, text) as :func:`sessionlore.plans.workloads.model_inputs`
    of whole transcripts. ``persist`` stores what is used twice."""
    spoken = F.concat(speaker_label("character_name", "display_name"), F.lit(": "), strip("transcript_text"))
    told = segments.where(is_usable("transcript_text")).select("session_id", "started_at", "id", spoken.alias("told"))
    sizes = told.groupBy("session_id").agg(F.sum(F.length("told") + 2).alias("n"))
    long = persist(sizes.where(F.col("n") - 2 + _AROUND > max(single_pass, limit)).select("session_id"), "long-sessions")
    short = transcripts(sessions.join(long, "session_id", "left_anti"), segments.join(long, "session_id", "left_anti"))
    # Each segment has a blank line before it; the first one's goes with the heading.
    parts = F.concat(F.array(F.lit("")), F.split(F.regexp_replace("told", LINE_END, "\n"), "\n", -1))
    lines = persist(told.join(long, "session_id", "left_semi").select("session_id", "started_at", "id", F.posexplode(parts).alias("pos", "text")), "long-lines")
    w = Window.partitionBy("session_id").orderBy("started_at", "id", "pos")
    number = F.row_number().over(w) - 2
    cost = F.when(F.col("line") >= 0, F.col("size") + 1).otherwise(0)
    thin = lines.select("session_id", "started_at", "id", "pos", F.length("text").alias("size")).withColumn("line", number)
    thin = thin.withColumn("cost", cost).withColumn("end", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    thin = persist(thin.where("line >= 0").select("session_id", "started_at", "id", "pos", "line", (F.col("end") - F.col("cost")).alias("start"), "end"), "line-sums")
    starts = chunk_starts(thin, limit, persist).withColumn("_first", F.lit(1))
    by_line = Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = thin.join(starts, ["session_id", "line"], "left").withColumn("chunk_no", (F.sum(F.coalesce("_first", F.lit(0))).over(by_line) - 1).cast("int"))
    met = lines.join(numbered.select("session_id", "started_at", "id", "pos", "line", "chunk_no"), ["session_id", "started_at", "id", "pos"])
    text = F.array_join(F.col("xs.text"), "\n")
    whole = met.groupBy("session_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("xs"))
    whole = whole.select("session_id", "chunk_no", F.concat(F.lit(TRANSCRIPT_HEADING + "\n\n"), strip(text), F.lit("\n")).alias("text"))
    several = numbered.groupBy("session_id").agg((F.max("chunk_no") > 0).alias("several"))
    out = whole.join(several, "session_id").select("session_id", F.when(F.col("several"), "chunk").otherwise("single").alias("stage"), "chunk_no", "text")
    return out.unionByName(short.select("session_id", F.lit("single").alias("stage"), F.lit(0).alias("chunk_no"), F.col("markdown").alias("text")))
