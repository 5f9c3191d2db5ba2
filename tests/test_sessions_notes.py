import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import audit, notes, sessions, transcripts
from sessionlore.operators.upserts import numbered
from sessionlore.schemas import NOTES, SEGMENTS, SESSIONS, TABLES
from sessionlore.sources import tables

T0 = dt.datetime(2024, 1, 1)


def now():
    return F.lit("2024-06-01").cast("timestamp")


def note(i, guild=1, kind="npc", title="T", content="c", meta="{}", at=0):
    return (i, guild, kind, title, content, None, meta, T0 + dt.timedelta(seconds=at), T0 + dt.timedelta(seconds=at))


def test_dense_ids(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("seq")).repartition(5)
    got = numbered(rows, "seq", F.lit(10).cast("long")).orderBy("seq").collect()
    assert [r["id"] for r in got] == list(range(11, 1011))
    assert numbered(rows.limit(0), "seq", F.lit(0)).count() == 0


def test_notes_of_large_sessions_get_ids_in_order(spark):
    from sessionlore.plans.workloads import notes_after

    places = [(2**40, 1, 0, 0), (2**40, 0, 40_000, 70_000), (2**40, 0, 40_000, 65_535), (2**31 - 1, 1, 0, 3), (2**31, 0, 2, 1)]
    rows = [(s, (stage, chunk, pos), "k", f"t{i}", "c", "{}") for i, (s, stage, chunk, pos) in enumerate(places)]
    updates = spark.createDataFrame(rows, "session_id long, seq struct<stage:int,chunk_no:int,pos:int>, note_type string, title string, content string, metadata string")
    owners = spark.createDataFrame([(s, 1) for s in {p[0] for p in places}], "id long, guild_id long")
    done = notes_after(spark.createDataFrame([], NOTES), updates, owners, F.lit("2024-06-01").cast("timestamp")).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in done] == [(1, "t3"), (2, "t4"), (3, "t2"), (4, "t1"), (5, "t0")]


def test_new_sessions_and_lookup(spark):
    asked = spark.createDataFrame([(1, 2, 3, None, 5), (1, 2, 3, "x", 1)], "guild_id long, voice_channel_id long, text_channel_id long, title string, seq long")
    rows = sessions.new_sessions(asked, 7, now())
    assert [(r["id"], r["title"], r["status"]) for r in rows.orderBy("id").collect()] == [(8, "x", "recording"), (9, None, "recording")]
    assert sessions.by_id(rows, spark.createDataFrame([(9,), (9,), (77,)], "id long")).count() == 1
    assert sessions.latest(rows).first()["id"] == 9


def test_transcripts(spark):
    rows = [
        (2, 1, 1, "d", "C", T0, T0, "p", " hi "), (1, 1, 1, "d", "", T0, T0, "p", "　x\n"), (3, 1, 1, "d", None, T0, T0, "p", None), (4, 1, 1, "d", None, T0, T0, "p", " "), (5, 2, 1, "d", None, T0, T0, "p", ""),
    ]
    segments = spark.createDataFrame(rows, SEGMENTS)
    got = {r["session_id"]: r["markdown"] for r in transcripts.transcripts(spark.createDataFrame([(1,), (2,), (3,)], "session_id long"), segments).collect()}
    assert got == {1: "# Transcript\n\nd: x\n\nC: hi\n", 2: "# Transcript\n", 3: "# Transcript\n"}
    clips = spark.createDataFrame([(1, 1, " a "), (1, 2, " "), (1, 3, "b"), (2, 1, None)], "clip long, pos int, text string")
    assert {r["clip"]: r["text"] for r in transcripts.clip_texts(clips).collect()} == {1: "a  b", 2: ""}


def test_upsert(spark):
    old = spark.createDataFrame([note(5), note(9, title="Other")], NOTES)
    batch = spark.createDataFrame([(1, "npc", "t", "new", 3, "{}", 2), (1, "npc", "T ", "first", 1, "{}", 1), (1, "npc", "T", "last", None, "{}", 4), (1, "npc", " ", "blank", 1, "{}", 5), (2, "npc", "T", "g2", 1, "{}", 0)], "guild_id long, note_type string, title string, content string, source_session_id long, metadata_json string, seq long")
    rows = notes.upsert(old, batch, now())
    got = {r["id"]: r for r in rows.collect()}
    assert {i: (r["guild_id"], r["title"], r["content"], r["source_session_id"]) for i, r in got.items()} == {5: (1, "T", "last", None), 9: (1, "Other", "c", None), 10: (2, "T", "g2", 1), 11: (1, "t", "new", 3)}
    assert got[5]["created_at"] == T0 and got[5]["updated_at"] > T0 and got[9]["updated_at"] == T0
    assert sorted(map(tuple, notes.upsert(rows, batch, now()).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert notes.upsert(spark.createDataFrame([], NOTES), batch.limit(0), now()).count() == 0
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], TABLES["note_embeddings"])
    new = spark.createDataFrame([(2, [5.0], 0), (2, [6.0], 1), (3, [3.0], 0)], "note_id long, embedding array<double>, seq long")
    assert {r[0]: r[1] for r in notes.upsert_embeddings(vectors, new).collect()} == {1: [1.0], 2: [6.0], 3: [3.0]}


def test_recent_and_listing(spark):
    rows = spark.createDataFrame([note(i, title=f"t{i}", content="x" * (110 + i % 2), at=i // 2) for i in range(201)], NOTES)
    assert notes.recent(rows).count() == 200
    assert [r["id"] for r in notes.recent(rows, 3).orderBy("rank").collect()] == [200, 198, 199]
    guilds = spark.createDataFrame([(1,), (2,)], "guild_id long")
    got = {r[0]: r[1] for r in notes.listing(guilds, rows).collect()}
    lines = got[1].split("\n")
    assert len(lines) == 27 and lines[2] == "- #200 [npc] t200: " + "x" * 110 and lines[4].endswith("x" * 107 + "...") and got[2] == notes.NO_NOTES
    snap = {r[0]: r[1] for r in notes.snapshots(guilds, rows.limit(1).withColumn("content", F.lit("body \n"))).collect()}
    assert snap[1] == "# Campaign Notes Snapshot\n\n## [npc] t0\n\nbody\n" and snap[2] == "# Campaign Notes Snapshot\n"
    assert notes.by_id(rows, spark.createDataFrame([(1, 3), (2, 4)], "guild_id long, id long")).count() == 1


def test_corrections(spark):
    rows = spark.createDataFrame([note(1, meta="[]"), note(2, title="b", meta="{broken"), note(3, title="c", meta='{"k": {"z": 1}, "corrected_by_user_id": 4}'), note(4, title="d", meta=None)], NOTES)
    given = spark.createDataFrame([(1, 1, "old", 8, 0), (1, 1, " new ", 9, 1), (1, 2, " ", 9, 2), (2, 3, "x", 9, 3), (1, 3, "y", None, 4)], "guild_id long, note_id long, content string, user_id long, seq long")
    done, rejected = notes.corrected(rows, given, now())
    got = {r["id"]: r for r in done.collect()}
    assert (got[1]["content"], json.loads(got[1]["metadata_json"])) == ("new", {"manually_corrected": True, "corrected_by_user_id": 9})
    assert got[2]["content"] == "c" and got[2]["metadata_json"] == "{broken" and got[4]["updated_at"] == T0
    assert json.loads(got[3]["metadata_json"]) == {"k": {"z": 1}, "manually_corrected": True, "corrected_by_user_id": None}
    assert {(r["note_id"], r["error"]) for r in rejected.collect()} == {(2, notes.BLANK_CORRECTION), (3, "Could not find note #3 in this server.")}


def test_session_changes(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, "a", T0, None, "recording", "t", "s"), (2, 1, 1, 1, "b", T0, None, "completed", "t", "s")], SESSIONS)
    events = spark.createDataFrame([(1, "finalize", T0, 0, None, "T", "S"), (1, "reset_text", T0 + dt.timedelta(1), 1, None, None, None), (2, "reset_audio", T0, 0, None, None, None), (2, "status", T0, 1, "failed", None, None)], "session_id long, event string, at timestamp, seq long, status string, transcript_path string, summary_path string")
    got = {r["id"]: (r["status"], r["ended_at"], r["transcript_path"], r["summary_path"]) for r in sessions.updated(rows, events).collect()}
    assert got == {1: ("processing", T0, "T", None), 2: ("failed", None, None, None)}
    segments = spark.createDataFrame([(1, 1, 1, "d", "c", T0, T0, "p", "x"), (2, 2, 1, "d", "c", T0, T0, "p", "x")], SEGMENTS)
    assert {r["id"]: r["transcript_text"] for r in sessions.reset_segment_texts(segments, events).collect()} == {1: "x", 2: None}
    results = spark.createDataFrame([(1, "p", "one", 0), (1, "p", "", 1), (9, "p", "no", 0)], "session_id long, audio_path string, transcript_text string, seq long")
    assert {r["id"]: r["transcript_text"] for r in sessions.apply_transcripts(segments, results).collect()} == {1: "", 2: "x"}


def test_outcomes(spark):
    asked = spark.createDataFrame([(1, "audio"), (2, "audio"), (3, "text"), (4, "text"), (5, "text")], "session_id long, mode string")
    segments = spark.createDataFrame([(1, True, ""), (1, False, None), (2, False, "x"), (3, False, " "), (4, False, "x")], "session_id long, decodable boolean, transcript_text string")
    got = {r["session_id"]: (r["n_done"], r["n_skipped"], r["status"], r["error"]) for r in sessions.outcomes(asked, segments).collect()}
    assert got == {1: (1, 1, "completed", None), 2: (0, 1, "failed", sessions.NONE_TRANSCRIBED), 3: (0, 0, "failed", sessions.NO_TEXT), 4: (1, 0, "completed", None), 5: (0, 0, "failed", sessions.NO_AUDIO)}


def test_reprocess_and_status(spark):
    rows = spark.createDataFrame([(i, g, 1, 1, "a", T0, None, "completed", "t", "s") for i, g in ((5, 303), (7, 404), (6, 404))], SESSIONS)
    asked = spark.createDataFrame([(1, 303, None), (2, 404, None), (3, 404, 5), (4, 1, None), (5, 404, 99), (6, 303, 5)], "request_id long, guild_id long, session_id long")
    idle = spark.createDataFrame([], "guild_id long, state string")
    got = {r["request_id"]: (r["resolved_id"], r["error"]) for r in sessions.resolved_requests(asked, rows, idle).collect()}
    assert got == {1: (5, None), 2: (7, None), 3: (None, sessions.OTHER_SERVER), 4: (None, sessions.NO_SESSION), 5: (None, sessions.NO_SESSION), 6: (5, None)}
    busy = spark.createDataFrame([(303, "recording"), (404, "processing")], "guild_id long, state string")
    assert {r["error"] for r in sessions.resolved_requests(asked, rows, busy).collect()} == {sessions.BUSY_RECORDING, sessions.BUSY_PROCESSING, sessions.NO_SESSION}
    states = spark.createDataFrame([(1, "failed", 3, "why", T0, 0), (1, "recording", 3, None, T0, -1), (2, "processing", 0, "", T0, 0)], "guild_id long, state string, session_id long, message string, updated_at timestamp, seq long")
    guilds = spark.createDataFrame([(1,), (2,), (3,)], "guild_id long")
    assert {r[0]: r[1] for r in sessions.status_texts(guilds, states).collect()} == {1: "Session #3 status: failed. why", 2: "Session status: processing.", 3: sessions.NO_STATUS}


def test_tables_and_audit(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([note(1), note(2, title="b")], NOTES)
    tables.write_table(rows, folder, "campaign_notes")
    tables.append_rows(rows, folder, "campaign_notes")
    back = tables.read_table(spark, folder, "campaign_notes")
    assert back.count() == 4 and back.schema == NOTES
    vectors = spark.createDataFrame([(1, [1.0]), (8, [1.0])], TABLES["note_embeddings"])
    empty = spark.createDataFrame([], SESSIONS)
    segments = spark.createDataFrame([(3, 1, 1, "d", "c", T0, T0, "p", "x")], SEGMENTS)
    assert {tuple(r) for r in audit.orphans(empty, segments, rows, vectors).collect()} == {("segment_without_session", 3), ("embedding_without_note", 8), ("note_without_embedding", 2)}
    docs = spark.createDataFrame([(1, "summary", "# a\nb\n")], "session_id long, kind string, markdown string")
    tables.write_markdown(docs, f"{folder}/md", as_text=True)
    tables.write_markdown(docs, f"{folder}/table")
    assert next((tmp_path / "md/kind=summary/session_id=1").glob("part-*")).read_text() == "# a\nb\n"
    assert spark.read.parquet(f"{folder}/table").count() == 1


def test_text_sinks_and_back(spark, tmp_path):
    rows = [(1, "summary", "# a\nb\n"), (1, "a b/c=ü+%", "x"), (1, "summary", "second\n\n"), (None, None, ""), (2, "..", "é\n")]
    docs, folder = spark.createDataFrame(rows, "session_id long, kind string, markdown string"), f"{tmp_path}/md"
    tables.write_markdown(docs, folder, as_text=True)
    want = {(s, k, t if t.endswith("\n") else t + "\n") for s, k, t in rows}
    found = [tuple(r) for r in tables.read_markdown(spark, folder).collect()]
    assert len(found) == len(rows) and set(found) == want
    spark_own = spark.read.text(folder, wholetext=True)
    assert {(r["session_id"], r["kind"], r["value"]) for r in spark_own.collect()} == want
    with pytest.raises(FileExistsError):
        tables.write_markdown(docs, folder, as_text=True)
