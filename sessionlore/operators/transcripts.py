"""Transcripts of sessions, and texts of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.text import TRANSCRIPT_HEADING, WHITE_SPACE, is_usable, speaker_label, strip


def transcripts(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """(session_id, markdown): a line for each usable segment, by start and id,
    blank lines between. A session without any has the heading alone. One
    session's text is one value, as it is one document."""
    line = F.concat(speaker_label("character_name", "display_name"), F.lit(": "), strip("transcript_text"))
    lines = segments.where(is_usable("transcript_text")).select("session_id", F.struct("started_at", "id", line.alias("line")).alias("x"))
    bodies = lines.groupBy("session_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    text = F.concat(F.lit(TRANSCRIPT_HEADING), F.coalesce(F.concat(F.lit("\n\n"), F.array_join(F.col("xs.line"), "\n\n")), F.lit("")))
    return sessions.select("session_id").distinct().join(bodies, "session_id", "left").select("session_id", F.concat(F.rtrim(text, F.lit(WHITE_SPACE)), F.lit("\n")).alias("markdown"))


def clip_texts(utterances: DataFrame) -> DataFrame:
    """(clip, text) of utterances (clip, pos, text): each stripped, joined by one
    space in order (blank ones too), and stripped."""
    joined = utterances.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("pos", strip(F.coalesce("text", F.lit(""))).alias("text")))).alias("xs"))
    return joined.select("clip", strip(F.array_join(F.col("xs.text"), " ")).alias("text"))
