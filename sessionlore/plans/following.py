"""Vectors that follow the notes: after an upsert or a correction only the notes whose
text is another reach the model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.functions.text import embedding_text
from sessionlore.operators import inference, notes
from sessionlore.sources import versions

#: The stream that a vector table has its notes' versions from.
NOTES = "notes"


def changed_texts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(note_id, text) of notes that are new or whose text is another; digests, not
    texts, are compared."""
    text = embedding_text("note_type", "title", "content")
    digest = F.sha2(text, 256)
    old = before.select(F.col("id").alias("note_id"), digest.alias("_digest"))
    ids = after.select(F.col("id").alias("note_id"), digest.alias("_digest")).join(old, ["note_id", "_digest"], "left_anti").select("note_id")
    return after.select(F.col("id").alias("note_id"), text.alias("text")).join(ids, "note_id", "left_semi")


def correct(spark: SparkSession, folder: str, corrections: DataFrame, as_of: Column, stream: str | None = None, number: int | None = None) -> DataFrame:
    """Apply corrections (guild_id, note_id, content, user_id, seq) to a versioned notes
    table, in the buckets of the notes that they name; returns the rejected ones."""
    current, _ = versions.read_version(spark, folder, "campaign_notes")
    _, rejected = notes.corrected(current, corrections, as_of)
    keyed = corrections.join(current.select(*notes.KEYS, F.col("id").alias("note_id")), ["guild_id", "note_id"])
    versions.merge(keyed, folder, "campaign_notes", lambda old, batch: notes.corrected(old, batch.drop("note_type", "title"), as_of)[0], notes.KEYS, stream=stream, number=number)
    return rejected


def follow(spark: SparkSession, notes_folder: str, vectors_folder: str, make_model: Callable, persist: Callable[[DataFrame, str], DataFrame], buckets: int = 64, partitions: int | None = None, missing: bool = False) -> tuple[int, DataFrame]:
    """Bring a versioned vector table up to the newest version of its notes: only
    buckets that have changed are read. A note that the model fails on loses its old
    vector, so that search does not find it by a text that is gone; it is asked for
    again when it changes, or with ``missing``, by which all notes without a vector are
    looked for. Returns the version of the notes and the failures (note_id, error). Run
    again after a crash, it begins where the vector table ends."""
    known = versions.manifest(spark, vectors_folder)
    since = known["streams"].get(NOTES, -1) if known else -1
    before, after, version = versions.read_changed(spark, notes_folder, "campaign_notes", since)
    texts = changed_texts(before, after)
    if missing:
        every, _ = versions.read_version(spark, notes_folder, "campaign_notes")
        vectors, _ = versions.read_version(spark, vectors_folder, "note_embeddings")
        lone = every.select(F.col("id").alias("note_id"), embedding_text("note_type", "title", "content").alias("text")).join(vectors, "note_id", "left_anti")
        texts = texts.unionByName(lone).dropDuplicates(["note_id"])
    replies = persist(inference.with_model(texts, "text", make_model, "embedding", kind="array<double>", partitions=partitions).drop("text"), "vectors")
    batch = replies.select("note_id", F.when(F.col("embedding_error").isNull(), F.col("embedding")).alias("embedding"), F.lit(0).alias("seq"))

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        return notes.upsert_embeddings(old, new).where("embedding is not null")

    # With ``missing`` the same version of the notes may give more vectors.
    versions.merge(batch, vectors_folder, "note_embeddings", merged, ["note_id"], buckets, NOTES, None if missing and version == since else version)
    return version, replies.where("embedding_error is not null").select("note_id", F.col("embedding_error").alias("error"))
