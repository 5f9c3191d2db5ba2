import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import notes, packets, registry
from sessionlore.schemas import CHARACTERS, NOTES
from sessionlore.sources.tables import latest_snapshot
from sessionlore.streaming import live

T0 = dt.datetime(2024, 1, 1)


def replay(spark, rows, schema, transform, tmp_path, parts=3):
    """Run a stream over rows written as files, one file a trigger."""
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


PACKETS = "session_id long, user_id long, received_at timestamp, name string, arrival_no long, session_ended boolean"


@pytest.fixture
def stream_rows():
    rng, rows, t = random.Random(7), [], 0
    for k in range(600):
        t += rng.choice([20_000] * 30 + [1_499_999, 1_500_000, 4_000_000])
        rows.append((1, k % 2, T0 + dt.timedelta(microseconds=t), f"n{k}", k, False))
    return rows


def test_segments_equal_batch(spark, tmp_path, stream_rows):
    rows = [*stream_rows, (1, 9, T0 + dt.timedelta(hours=1), "late", 10_000, False)]
    keys = ["session_id", "user_id"]
    got = replay(spark, rows, PACKETS, lambda s: live.live_segments(s, keys, min_speech_us=200_000), tmp_path)
    want = packets.speech_segments(spark.createDataFrame(rows, PACKETS), keys, min_speech_us=200_000)
    columns = [*keys, "started_at", "ended_at", "n_packets"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_end_of_session_closes_a_short_burst(spark, tmp_path):
    at = lambda us: T0 + dt.timedelta(microseconds=us)
    rows = [(1, 1, at(i * 20_000), "n", i, False) for i in range(40)] + [(1, 1, at(5_000_000 + i * 20_000), "n", i, False) for i in range(3)]
    rows += [(1, 1, at(5_500_000), "n", 99, True), (1, 2, at(900_000_000), "n", 100, False)]
    got = replay(spark, rows, PACKETS, lambda s: live.live_segments_with_end(s, ["session_id", "user_id"]), tmp_path, parts=2).orderBy("started_at").collect()
    assert [(r["n_packets"], r["forced"]) for r in got] == [(40, False), (3, True)]


def test_quarantine_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k % 3, k, rng.choice(["error", "error", "data", "none"])) for k in range(300)]
    schema = "ssrc long, n long, outcome string"
    got = replay(spark, rows, schema, lambda s: live.live_quarantine(s, "n"), tmp_path)
    want = packets.quarantine(spark.createDataFrame(rows, schema), ["ssrc"], ["n"]).select("ssrc", "n", "outcome", "action")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_live_upserts(spark, tmp_path):
    folder = f"{tmp_path}/registry"
    write = live.snapshot_writer(folder, "character_registry", registry.register)
    schema = "guild_id long, user_id long, character_name string, updated_at timestamp, seq long"
    write(spark.createDataFrame([(1, 1, "A", T0, 0), (1, 2, "B", T0, 1)], schema), 0)
    write(spark.createDataFrame([(1, 1, "C ", T0, 0)], schema), 1)
    write(spark.createDataFrame([(1, 1, "again", T0, 0)], schema), 1)
    rows, version = latest_snapshot(spark, folder, "character_registry")
    assert version == 1 and rows.schema == CHARACTERS and {(r["user_id"], r["character_name"]) for r in rows.collect()} == {(1, "C"), (2, "B")}
    now = F.lit("2024-06-01").cast("timestamp")
    write = live.snapshot_writer(f"{tmp_path}/notes", "campaign_notes", lambda old, batch: notes.upsert(old, batch, now))
    write(spark.createDataFrame([(1, "npc", "T", "c", None, "{}", 0)], "guild_id long, note_type string, title string, content string, source_session_id long, metadata_json string, seq long"), 0)
    rows, _ = latest_snapshot(spark, f"{tmp_path}/notes", "campaign_notes")
    assert rows.schema == NOTES and rows.first()["id"] == 1
