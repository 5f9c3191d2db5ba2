"""The library's main jobs, put together from its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.functions.text import display_label, embedding_text, summary_markdown, transcript_chunks, wav_path
from sessionlore.operators import inference, notes, packets, registry, search, slices, summaries, transcripts
from sessionlore.operators import sessions as states
from sessionlore.operators.calls import Wording, answered
from sessionlore.operators.upserts import numbered
from sessionlore.schemas import COMPLETED
from sessionlore.sources.packets import existing, write_archives
from sessionlore.sources.shared import new_path
from sessionlore.sources.tables import append_rows, read_table


def segments_of_recordings(rows: DataFrame, updates: DataFrame, session_end: DataFrame | None = None) -> DataFrame:
    """Packets to named segments: valid packets, bursts, names as of their
    start, archive paths. One shuffle by (session, user), one by name."""
    good = packets.valid_packets(rows).withColumn("label", display_label("display_name", "name", "user_id"))
    found = packets.speech_segments(good, ["guild_id", "session_id", "user_id"], session_end=session_end, names=("label",))
    named = registry.with_names_as_of(found, updates, "label").withColumnRenamed("label", "display_name")
    return packets.with_archive_path(named, F.concat(F.lit("sessions/"), F.col("session_id").cast("string"), F.lit("/audio")))


def recordings_to_transcripts(rows: DataFrame, updates: DataFrame, session_end: DataFrame | None, folder: str, make_model: Callable, persist: Callable[[DataFrame, str], DataFrame], last_id: int = 0, partitions: int | None = None, idle_us: int = packets.IDLE_US, min_speech_us: int = packets.MIN_SPEECH_US) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packets of sessions to archive files below ``folder``, segments with texts,
    outcomes (session_id, n_segments, n_done, n_skipped, status, error) and
    transcripts (session_id, markdown; only of sessions that did not fail). The model
    gets the address of each segment's wav, where one is there, or of its archive.
    ``arrival_no`` is a packet's own number in its session."""
    good = packets.valid_packets(rows).withColumn("label", display_label("display_name", "name", "user_id"))
    keys = ["guild_id", "session_id", "user_id"]
    found = packets.speech_segments(good, keys, idle_us, min_speech_us, session_end=session_end, names=("label",))
    named = registry.with_names_as_of(found, updates, "label")
    paths = packets.with_archive_path(named, F.concat(F.lit("sessions/"), F.col("session_id").cast("string"), F.lit("/audio")))
    # Times first, so that ids follow the recording.
    numbered_rows = persist(numbered(paths.withColumn("_order", F.struct(F.unix_micros("started_at").alias("us"), "session_id", "user_id")), "_order", F.lit(last_id).cast("long")).drop("_order"), "segments")
    # Payloads stay out of the sort by silence: they meet the thin rows afterwards.
    thin = slices.with_bursts(good.select(*keys, "received_at", "arrival_no"), keys, idle_us).join(numbered_rows.select(*keys, "burst", F.col("audio_path").alias("path")), [*keys, "burst"])
    placed = good.select(*keys, "arrival_no", "sequence", F.col("rtp_timestamp").alias("timestamp"), "payload").join(thin.select(*keys, "arrival_no", "path"), [*keys, "arrival_no"])
    write_archives(placed, folder)
    segments = numbered_rows.select("id", "session_id", "user_id", F.col("label").alias("display_name"), "character_name", "started_at", "ended_at", "audio_path", F.lit(None).cast("string").alias("transcript_text"))
    ways = packets.routed(segments, existing(segments.select(wav_path("audio_path").alias("path")), folder)).where("route != 'unsupported'")
    asked = ways.select("session_id", "audio_path", F.concat(F.lit(folder.rstrip("/") + "/"), F.when(F.col("route") == "ready", F.col("ready_path")).otherwise(F.col("audio_path"))).alias("address"))
    replies = persist(inference.with_model(asked, "address", make_model, "transcript_text", partitions=partitions).drop("address"), "texts")
    done = states.apply_transcripts(segments, replies.where("transcript_text_error is null").withColumn("seq", F.lit(0)))
    decoded = replies.where("transcript_text_error is null").select("session_id", "audio_path", F.lit(True).alias("decodable")).distinct()
    done = persist(done.join(decoded, ["session_id", "audio_path"], "left").withColumn("decodable", F.coalesce("decodable", F.lit(False))), "transcribed")
    every = rows.select("session_id", F.lit("audio").alias("mode")).distinct()
    outcomes = persist(states.outcomes(every, done), "outcomes")
    completed = outcomes.where(F.col("status") == COMPLETED).select("session_id")
    texts = transcripts.transcripts(completed, done.join(completed, "session_id", "left_semi"))
    return done.drop("decodable"), outcomes.drop("mode"), texts


def append_segments(rows: DataFrame, folder: str, order: str = "seq") -> None:
    """Append segments to the table in ``folder``; their ids follow the table's, in the
    rising ``order``, an integer column."""
    spark = rows.sparkSession
    last = read_table(spark, folder, "transcript_segments").agg(F.max("id")).first()[0] or 0
    append_rows(numbered(rows, order, F.lit(last).cast("long")), folder, "transcript_segments")


def model_inputs(markdown: DataFrame, single_pass: int, limit: int) -> DataFrame:
    """(session_id, stage, chunk_no, text): one row per model call."""
    rows = markdown.select("session_id", transcript_chunks("markdown", single_pass, limit).alias("chunks"))
    stage = F.when(F.size("chunks") > 1, "chunk").otherwise("single")
    return rows.select("session_id", stage.alias("stage"), F.posexplode("chunks").alias("chunk_no", "text"))


def session_summaries(sessions: DataFrame, segments: DataFrame, make_model: Callable, persist: Callable[[DataFrame, str], DataFrame], single_pass: int = 90_000, limit: int = 45_000, attempts: int = 3, partitions: int | None = None, wording: Wording = Wording("", "", ""), ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(session_id, markdown) and the final note updates. The model gets prompts in
    the caller's ``wording``; a call is repeated only if its reply was refused. Replies
    are kept in ``ledger``, a folder (a new one by default): a run over the same
    ledger asks only what is missing there. ``persist`` stores the responses of a
    stage before they are used twice."""
    spark = sessions.sparkSession
    ledger = ledger or new_path(spark, "ledger")
    calls = persist(model_inputs(transcripts.transcripts(sessions, segments), single_pass, limit), "calls")

    def replied(rows: DataFrame, name: str) -> DataFrame:
        return persist(answered(rows, make_model, ledger, wording, persist, attempts, partitions, name=name).drop("n_attempts"), name)

    first = replied(calls, "responses")
    recaps = summaries.recaps(first).select("session_id", F.lit("final").alias("stage"), F.lit(0).alias("chunk_no"), F.col("markdown").alias("text"))
    accepted = first.unionByName(replied(persist(recaps, "recaps"), "final-responses"))
    last = accepted.where("stage != 'chunk' and payload is not null")
    return last.select("session_id", summary_markdown("payload.session_notes_markdown", "payload.cinematic_summary_markdown").alias("markdown")), summaries.final_updates(accepted)


def notes_after(existing: DataFrame, updates: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Notes after the updates of sessions (id, guild_id), in session order."""
    rows = updates.join(sessions.select(F.col("id").alias("session_id"), "guild_id"), "session_id")
    seq = F.struct("session_id", "seq")
    batch = rows.select("guild_id", "note_type", "title", "content", F.col("session_id").alias("source_session_id"), F.col("metadata").alias("metadata_json"), seq.alias("seq"))
    return notes.upsert(existing, batch, as_of)


def embedded(rows: DataFrame, make_model: Callable, partitions: int | None = None) -> DataFrame:
    """(note_id, embedding) of notes; rows the model failed on are left out."""
    texts = rows.select(F.col("id").alias("note_id"), embedding_text("note_type", "title", "content").alias("text"))
    out = inference.with_model(texts, "text", make_model, "embedding", kind="array<double>", partitions=partitions)
    return out.where("embedding_error is null").select("note_id", "embedding")


def retrieval(questions: DataFrame, all_notes: DataFrame, embeddings: DataFrame, k: int = search.DEPTH) -> DataFrame:
    """(question_id, context) of questions (question_id, guild_id, embedding)."""
    return search.contexts(questions, search.with_vectors(all_notes, embeddings), k)
