"""Model responses of sessions: the first good one, merged updates, recaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.responses import has_content, least_chars, normalized
from sessionlore.functions.text import TRANSCRIPT_HEADING, strip

# Attempts per call, and messages to the caller.
ATTEMPTS = 3
RAISED, LOW_CONTENT = "Could not generate summary", "Could not generate non-empty summary"
CALL = ["session_id", "stage", "chunk_no"]


def accepted_responses(responses: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(session_id, stage, chunk_no, attempt, payload, error) of responses (…,
    attempt, raw, error): the first attempt that parses and has content.
    Without one, ``error`` says whether an attempt failed outright."""
    tried = responses.where(F.col("attempt").between(1, attempts)).withColumn("payload", normalized("raw"))
    tried = tried.withColumn("ok", F.col("error").isNull() & has_content(F.col("payload"), least_chars(F.col("stage"))))
    tried = tried.withColumn("failed", F.col("error").isNotNull() | F.col("payload").isNull())
    first = tried.groupBy(*CALL).agg(F.min_by(F.when(F.col("ok"), F.struct("attempt", "payload")), F.when(F.col("ok"), F.col("attempt"))).alias("x"), F.bool_or("failed").alias("raised"))
    error = F.when(F.col("x").isNull(), F.when(F.col("raised"), RAISED).otherwise(LOW_CONTENT))
    return first.select(*CALL, F.col("x.attempt").alias("attempt"), F.col("x.payload").alias("payload"), error.alias("error"))


def updates_of(accepted: DataFrame) -> DataFrame:
    """Note updates of accepted responses in order: chunks first, then the
    final (or only) response. ``seq`` is (stage, chunk, position)."""
    stage = F.when(F.col("stage") == "chunk", 0).otherwise(1)
    rows = accepted.where("payload is not null").select(*CALL, F.posexplode("payload.note_updates").alias("pos", "u"))
    return rows.select(*CALL, "pos", F.struct(stage.alias("stage"), F.coalesce("chunk_no", F.lit(0)).alias("chunk_no"), "pos").alias("seq"), "u.*")


def merged_updates(updates: DataFrame, scope: str = "session_id") -> DataFrame:
    """Updates merged by (type, title) without case: the longest content wins,
    the earlier of equally long ones; ``seq`` is the place of the key's first
    row. Rows with a blank part go; blank metadata becomes ``{}``."""
    rows = updates.select(scope, "seq", *[strip(c).alias(c) for c in ("note_type", "title", "content")], F.coalesce("metadata", F.lit("{}")).alias("metadata"))
    rows = rows.where((F.col("note_type") != "") & (F.col("title") != "") & (F.col("content") != ""))
    rows = rows.withColumn("_type", F.lower("note_type")).withColumn("_title", F.lower("title"))
    # The largest of (length, earliest) by partial aggregation.
    best = F.min_by(F.struct("note_type", "title", "content", "metadata"), F.struct((-F.length("content")).alias("n"), F.col("seq")))
    return rows.groupBy(scope, "_type", "_title").agg(best.alias("best"), F.min("seq").alias("seq")).select(scope, "seq", "best.*")


def final_updates(accepted: DataFrame) -> DataFrame:
    """Updates per session to be upserted: merged where the transcript was
    chunked, as they are where one response covers it."""
    rows = updates_of(accepted)
    chunked = rows.where("stage = 'chunk'").select("session_id").union(accepted.where("stage = 'chunk'").select("session_id")).distinct()
    merged = merged_updates(rows.join(chunked, "session_id", "left_semi"))
    return merged.unionByName(rows.join(chunked, "session_id", "left_anti").select(merged.columns))


def update_counts(updates: DataFrame) -> DataFrame:
    return updates.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_updates"))


def recaps(accepted: DataFrame) -> DataFrame:
    """(session_id, markdown): notes and recaps of the chunks in order, without
    labels; the input of the final call."""
    parts = F.concat_ws("\n\n", strip("payload.session_notes_markdown"), strip("payload.cinematic_summary_markdown"))
    rows = accepted.where("stage = 'chunk' and payload is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", parts.alias("text")))).alias("xs"))
    return rows.select("session_id", F.concat(F.lit(TRANSCRIPT_HEADING + "\n\n"), strip(F.array_join(F.col("xs.text"), "\n\n")), F.lit("\n")).alias("markdown"))


