"""Sessions: creation, state changes, status texts, reprocess requests,
outcomes, and transcription results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.text import is_usable
from sessionlore.operators.upserts import last_per_key, numbered
from sessionlore.schemas import COMPLETED, FAILED, PROCESSING, RECORDING

# Messages to the caller.
NO_SESSION = "No saved session was found to reprocess."
OTHER_SERVER = "That session does not belong to this server."
BUSY_RECORDING = "Cannot reprocess while a live session is recording in this server."
BUSY_PROCESSING = "A session is already processing in this server."
NO_AUDIO = "No decodable audio was captured for this session. Voice packets were received, but no valid speaker audio could be saved."
NONE_TRANSCRIBED = "No audio segments could be transcribed. All saved segments failed to decode."
NO_TEXT = "No transcript text exists for this session yet. Run `!reprocess-session` first."
NO_STATUS = "No active or recent session."


def new_sessions(requests: DataFrame, last_id: int, as_of: Column) -> DataFrame:
    """Rows to append for requests (guild_id, voice_channel_id,
    text_channel_id, title, seq): state recording, new ids in order of seq."""
    null = lambda kind: F.lit(None).cast(kind)
    return numbered(requests, "seq", F.lit(last_id).cast("long")).select(
        "id", "guild_id", "voice_channel_id", "text_channel_id", "title", as_of.alias("started_at"), null("timestamp").alias("ended_at"),
        F.lit(RECORDING).alias("status"), null("string").alias("transcript_path"), null("string").alias("summary_path"),
    )


def by_id(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    return sessions.join(wanted.select("id").distinct(), "id", "left_semi")


def latest(sessions: DataFrame) -> DataFrame:
    """Each guild's session with the greatest id, whatever its times."""
    return sessions.groupBy("guild_id").agg(F.max_by(F.struct(*sessions.columns), "id").alias("s")).select("s.*")


def updated(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions after events (session_id, event, at, status, transcript_path,
    summary_path), applied in order of ``at`` and ``seq``: ``status`` sets the
    status; ``reset_audio`` sets processing and clears both paths;
    ``reset_text`` sets processing and clears the summary's; ``finalize`` sets
    completed, the end of processing and both paths."""
    order = F.struct("at", "seq")
    e = F.col("event")
    last = lambda value, when: F.max_by(F.when(when, F.struct(value.alias("v"))), F.when(when, order))
    finalize, audio, text = e == "finalize", e == "reset_audio", e == "reset_text"
    state = F.when(finalize, COMPLETED).when(audio | text, PROCESSING).otherwise(F.col("status"))
    path = lambda c, cleared: F.when(cleared, F.lit(None).cast("string")).otherwise(F.col(c))
    changes = events.groupBy(F.col("session_id").alias("id")).agg(
        last(state, F.lit(True)).alias("_status"),
        last(F.col("at"), finalize).alias("_ended"),
        last(path("transcript_path", audio), finalize | audio).alias("_transcript"),
        last(path("summary_path", audio | text), finalize | audio | text).alias("_summary"),
    )
    new = {"status": "_status", "ended_at": "_ended", "transcript_path": "_transcript", "summary_path": "_summary"}
    pick = lambda c: F.when(F.col(new[c]).isNotNull(), F.col(new[c])["v"]).otherwise(F.col(c)).alias(c)
    return sessions.join(changes, "id", "left").select(*[pick(c) if c in new else F.col(c) for c in sessions.columns])


def reset_segment_texts(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Segments without the texts of sessions that are transcribed anew."""
    reset = events.where("event = 'reset_audio'").select("session_id").distinct().withColumn("_reset", F.lit(True))
    text = F.when(F.col("_reset").isNull(), F.col("transcript_text"))
    return segments.join(reset, "session_id", "left").withColumn("transcript_text", text).select(segments.columns)


def status_texts(guilds: DataFrame, statuses: DataFrame) -> DataFrame:
    """(guild_id, status_text): the last of (guild_id, state, session_id,
    message, updated_at, seq); a session id of 0 counts as none."""
    last = last_per_key(statuses, ["guild_id"], ["updated_at", "seq"])
    label = F.when(F.coalesce("session_id", F.lit(0)) != 0, F.concat(F.lit("Session #"), F.col("session_id").cast("string"))).otherwise("Session")
    message = F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit(". "), F.col("message"))).otherwise(".")
    text = F.when(F.col("state").isNull(), NO_STATUS).otherwise(F.concat(label, F.lit(" status: "), F.col("state"), message))
    return guilds.select("guild_id").join(last, "guild_id", "left").select("guild_id", text.alias("status_text"))


def resolved_requests(requests: DataFrame, sessions: DataFrame, active: DataFrame, with_audio: DataFrame | None = None) -> DataFrame:
    """Reprocess requests (request_id, guild_id, session_id) with
    ``resolved_id`` or ``error``. No id means the guild's latest session.
    ``active`` (guild_id, state) are guilds that record or process;
    ``with_audio`` (session_id) are sessions with recorded audio, for requests
    to transcribe anew."""
    newest = sessions.groupBy("guild_id").agg(F.max("id").alias("_latest"))
    busy = active.groupBy("guild_id").agg(F.max((F.col("state") == RECORDING).cast("int")).alias("_recording"), F.max((F.col("state") == PROCESSING).cast("int")).alias("_processing"))
    owner = sessions.select(F.col("id").alias("_id"), F.col("guild_id").alias("_owner"))
    met = requests.join(newest, "guild_id", "left").join(busy, "guild_id", "left").withColumn("_id", F.coalesce("session_id", "_latest")).join(owner, "_id", "left")
    error = F.when(F.col("_recording") == 1, BUSY_RECORDING).when(F.col("_processing") == 1, BUSY_PROCESSING).when(F.col("_owner").isNull(), NO_SESSION).when(F.col("_owner") != F.col("guild_id"), OTHER_SERVER)
    if with_audio is not None:
        met = met.join(with_audio.select(F.col("session_id").alias("_id"), F.lit(True).alias("_audio")).distinct(), "_id", "left")
        missing = F.concat(F.lit("Session #"), F.col("_id").cast("string"), F.lit(" has no recorded audio directory to reprocess."))
        error = F.coalesce(error, F.when(F.col("_audio").isNull(), missing))
    met = met.withColumn("error", error)
    return met.select("request_id", "guild_id", F.when(F.col("error").isNull(), F.col("_id")).alias("resolved_id"), "error")


def apply_transcripts(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments with the texts of results (session_id, audio_path,
    transcript_text, seq); the last result of a path wins, unmatched segments
    stay."""
    keys = ["session_id", "audio_path"]
    last = last_per_key(results.select(*keys, "transcript_text", "seq"), keys, ["seq"]).select(*keys, F.col("transcript_text").alias("_text"), F.lit(True).alias("_met"))
    return segments.join(last, keys, "left").withColumn("transcript_text", F.when(F.col("_met"), F.col("_text")).otherwise(F.col("transcript_text"))).select(segments.columns)


def outcomes(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """(session_id, mode, n_segments, n_done, n_skipped, status, error) of
    sessions (session_id, mode: audio or text) from segments (session_id,
    decodable, transcript_text). In audio mode a decoded segment with a blank
    text counts as done."""
    counts = segments.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if("decodable").alias("_decoded"), F.count_if(is_usable("transcript_text")).alias("_usable")
    )
    met = sessions.select("session_id", "mode").join(counts, "session_id", "left").fillna(0, ["n_segments", "_decoded", "_usable"])
    audio = F.col("mode") == "audio"
    done = F.when(audio, F.col("_decoded")).otherwise(F.col("_usable"))
    error = F.when(F.col("n_segments") == 0, NO_AUDIO).when((done == 0) & audio, NONE_TRANSCRIBED).when(done == 0, NO_TEXT)
    return met.select("session_id", "mode", "n_segments", done.alias("n_done"), F.when(audio, F.col("n_segments") - F.col("_decoded")).otherwise(0).alias("n_skipped"), F.when(error.isNull(), COMPLETED).otherwise(FAILED).alias("status"), error.alias("error"))
