"""Keyed notes: upserts, corrections, recent ones, listings, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.responses import corrected_metadata
from sessionlore.functions.text import WHITE_SPACE, preview, strip, titled
from sessionlore.operators.upserts import last_per_key, merged, numbered

KEYS = ["guild_id", "note_type", "title"]
# How many notes are recent, and how many are listed.
RECENT, LISTED = 200, 25
NO_NOTES, NO_PRIOR_NOTES = "No campaign notes exist yet.", "No prior campaign notes."
LIST_HEADING = "Recent campaign notes (use `!correct-note <id> <new content>` to edit):"
SNAPSHOT_HEADING = "# Campaign Notes Snapshot"
BLANK_CORRECTION = "Corrected content cannot be empty."


def prepared(batch: DataFrame) -> DataFrame:
    """A batch with stripped parts, without the rows that have a blank one."""
    rows = batch.select("guild_id", *[strip(c).alias(c) for c in ("note_type", "title", "content")], "source_session_id", "metadata_json", "seq")
    return rows.where((F.col("note_type") != "") & (F.col("title") != "") & (F.col("content") != ""))


def upsert(notes: DataFrame, batch: DataFrame, as_of: Column, last_id: int | None = None) -> DataFrame:
    """Notes after a batch (guild_id, note_type, title, content,
    source_session_id, metadata_json, seq). A known key keeps id and
    created_at; a new one gets the next id, in order of its first row in the
    batch; the last row's values stand. ``seq`` is an integer, or a struct that
    begins with one. Parts are stripped, and rows with a blank one go."""
    rows = prepared(batch)
    newest = last_per_key(rows, KEYS, ["seq"]).drop("seq")
    order = rows.groupBy(*KEYS).agg(F.min("seq").alias("seq"))
    if last_id is None:
        last_id = int(notes.agg(F.max("id")).first()[0] or 0)
    fresh = numbered(order.join(notes.select(KEYS), KEYS, "left_anti"), "seq", F.lit(last_id).cast("long")).select(*KEYS, "id")
    ready = newest.join(fresh, KEYS, "left").select(
        "id", *KEYS, "content", F.col("source_session_id").cast("long").alias("source_session_id"), "metadata_json", as_of.alias("created_at"), as_of.alias("updated_at")
    )
    return merged(notes, ready.select(notes.columns), KEYS, ["content", "source_session_id", "metadata_json", "updated_at"])


def upsert_embeddings(embeddings: DataFrame, batch: DataFrame) -> DataFrame:
    """Vectors by note_id after a batch (note_id, embedding, seq)."""
    return merged(embeddings, last_per_key(batch, ["note_id"], ["seq"]).select(embeddings.columns), ["note_id"], ["embedding"])


def by_id(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Notes of (guild_id, id) pairs; one of another guild is not found."""
    return notes.join(wanted.select("guild_id", "id").distinct(), ["guild_id", "id"], "left_semi").select(notes.columns)


def corrected(notes: DataFrame, corrections: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Notes after corrections (guild_id, note_id, content, user_id, seq), and
    the rejected corrections with ``error``. Type, title, id, source and
    created_at stay; the metadata tells who corrected."""
    rows = corrections.withColumn("content", strip(F.coalesce("content", F.lit(""))))
    known = notes.select("guild_id", F.col("id").alias("note_id"), F.lit(True).alias("_known"))
    met = rows.join(known, ["guild_id", "note_id"], "left")
    missing = F.concat(F.lit("Could not find note #"), F.col("note_id").cast("string"), F.lit(" in this server."))
    error = F.when(F.col("content") == "", BLANK_CORRECTION).when(F.col("_known").isNull(), missing)
    rejected = met.withColumn("error", error).where("error is not null").select(*corrections.columns, "error")
    last = last_per_key(rows.where("content != ''"), ["guild_id", "note_id"], ["seq"])
    last = last.select("guild_id", F.col("note_id").alias("id"), F.col("content").alias("_content"), F.col("user_id").alias("_user"), F.lit(True).alias("_in"))
    hit = F.coalesce("_in", F.lit(False))
    new = {"content": F.col("_content"), "metadata_json": corrected_metadata("metadata_json", "_user"), "updated_at": as_of}
    out = notes.join(last, ["guild_id", "id"], "left").select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in notes.columns])
    return out, rejected


def recent(notes: DataFrame, n: int = RECENT) -> DataFrame:
    """The ``n`` notes of each guild that were updated last, with ``rank``. Each
    task passes on its first ``n`` of a guild only."""
    w = Window.partitionBy("guild_id").orderBy(F.col("updated_at").desc(), F.col("created_at").desc(), "id")
    return notes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _joined(guilds: DataFrame, notes: DataFrame, n: int, line: Column, between: str) -> DataFrame:
    """(guild_id, text) of at most ``n`` notes of each of the guilds, in order of
    rank; notes of other guilds are left out before they are ranked."""
    asked = notes.join(guilds.select("guild_id").distinct(), "guild_id", "left_semi")
    rows = recent(asked, n).groupBy("guild_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("xs"))
    return rows.select("guild_id", F.array_join(F.col("xs.line"), between).alias("text"))


def listing(guilds: DataFrame, notes: DataFrame, n: int = LISTED) -> DataFrame:
    """(guild_id, listing)."""
    line = F.concat(F.lit("- #"), F.col("id").cast("string"), F.lit(" ["), F.col("note_type"), F.lit("] "), F.col("title"), F.lit(": "), preview("content"))
    rows = _joined(guilds, notes, n, line, "\n").select("guild_id", F.concat(F.lit(LIST_HEADING + "\n\n"), F.col("text")).alias("listing"))
    return guilds.select("guild_id").join(rows, "guild_id", "left").select("guild_id", F.coalesce("listing", F.lit(NO_NOTES)).alias("listing"))


def snapshots(guilds: DataFrame, notes: DataFrame, n: int = RECENT) -> DataFrame:
    """(guild_id, markdown): recent notes under a heading each."""
    part = F.concat(F.lit("## ["), F.col("note_type"), F.lit("] "), F.col("title"), F.lit("\n\n"), F.col("content"))
    rows = _joined(guilds, notes, n, part, "\n\n")
    text = F.concat(F.lit(SNAPSHOT_HEADING), F.coalesce(F.concat(F.lit("\n\n"), F.col("text")), F.lit("")))
    return guilds.select("guild_id").join(rows, "guild_id", "left").select("guild_id", F.concat(F.rtrim(text, F.lit(WHITE_SPACE)), F.lit("\n")).alias("markdown"))


def prior_contexts(guilds: DataFrame, notes: DataFrame, n: int = RECENT) -> DataFrame:
    """(guild_id, context): recent notes as text. It is for display; summaries
    must not read it, or old notes would leak into them."""
    rows = _joined(guilds, notes, n, titled("note_type", "title", "content"), "\n\n")
    return guilds.select("guild_id").join(rows, "guild_id", "left").select("guild_id", F.coalesce("text", F.lit(NO_PRIOR_NOTES)).alias("context"))
