"""Schemas of the tables. Ids are longs, times are timestamps in UTC."""

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "timestamp": TimestampType(), "binary": BinaryType(), "array<double>": ArrayType(DoubleType())}


def schema(columns: str) -> StructType:
    """A schema from "name type, ..."; needs no running session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


CHARACTERS = schema("guild_id long, user_id long, character_name string, updated_at timestamp")
SESSIONS = schema(
    "id long, guild_id long, voice_channel_id long, text_channel_id long, title string, started_at timestamp, "
    "ended_at timestamp, status string, transcript_path string, summary_path string"
)
SEGMENTS = schema(
    "id long, session_id long, user_id long, display_name string, character_name string, started_at timestamp, "
    "ended_at timestamp, audio_path string, transcript_text string"
)
NOTES = schema(
    "id long, guild_id long, note_type string, title string, content string, source_session_id long, "
    "metadata_json string, created_at timestamp, updated_at timestamp"
)
NOTE_EMBEDDINGS = schema("note_id long, embedding array<double>")
PACKETS = schema(
    "guild_id long, session_id long, user_id long, display_name string, name string, ssrc long, sequence int, "
    "rtp_timestamp long, payload binary, received_at timestamp, arrival_no long"
)
TABLES = {
    "character_registry": CHARACTERS, "sessions": SESSIONS, "transcript_segments": SEGMENTS,
    "campaign_notes": NOTES, "note_embeddings": NOTE_EMBEDDINGS, "packets": PACKETS,
}

#: The states of a session.
RECORDING, PROCESSING, COMPLETED, FAILED = "recording", "processing", "completed", "failed"
