"""References between tables that point nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(sessions: DataFrame, segments: DataFrame, notes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(problem, id): segments without a session, vectors without a note, and
    notes without a vector, which no search finds."""

    def missing(rows: DataFrame, key: str, ids: DataFrame, own: str, problem: str, out: str) -> DataFrame:
        return rows.join(ids.select(F.col(own).alias(key)), key, "left_anti").select(F.lit(problem).alias("problem"), F.col(out).cast("long").alias("id"))

    return (
        missing(segments, "session_id", sessions, "id", "segment_without_session", "id")
        .unionByName(missing(embeddings, "note_id", notes, "id", "embedding_without_note", "note_id"))
        .unionByName(missing(notes.select("id"), "id", embeddings, "note_id", "note_without_embedding", "id"))
    )
