"""Streams whose triggers are out of order give the batch results."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlore.operators import packets, registry
from sessionlore.streaming import live, ordered

T0 = dt.datetime(2024, 1, 1)
at = lambda us: T0 + dt.timedelta(microseconds=us)
#: So late that the watermark passes all other rows.
LAST = at(86_400_000_000)


def replay(spark, triggers, schema, transform, folder, last=None):
    """Run a stream, one file a trigger, and a last one."""
    for rows in [*triggers, *([last] if last else [])]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out"), [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]


def dealt(rng, rows, time, parts, jitter_us):
    """Rows in triggers, each up to ``jitter_us`` out of order."""
    late = sorted(rows, key=lambda r: (r[time] - T0).total_seconds() * 1e6 + rng.uniform(0, jitter_us))
    size = -(-len(late) // parts)
    return [late[i : i + size] for i in range(0, len(late), size)]


PACKETS = "session_id long, user_id long, received_at timestamp, name string, session_ended boolean"


def plain_segments(rows, idle, least, packet):
    out = []
    for user in {r[1] for r in rows}:
        start = last = name = None
        n = 0
        for t, end, who in sorted((r[2], r[4], r[3]) for r in rows if r[1] == user):
            if n and (t - last).total_seconds() * 1e6 >= idle:
                out += [(user, start, last, n, False, name)] * (n * packet >= least)
                n = 0
            if end:
                out += [(user, start, last, n, True, name)] * (n > 0)
                n = 0
            else:
                start, name = (start, name) if n else (t, who)
                last, n = t, n + 1
        out += [(user, start, last, n, False, name)] * (n * packet >= least and n > 0)
    return sorted(out)


def test_late_packets_within_the_watermark(spark, tmp_path):
    """Packets at 1.0, 1.5 and 2.0 s in one trigger, at 0.5 and 1.2 s in the next."""
    rows = lambda *ts: [(1, 1, at(int(t * 1e6)), f"n{t}", False) for t in ts]
    got, _ = replay(spark, [rows(1.0, 1.5, 2.0), rows(0.5, 1.2)], PACKETS, lambda s: live.live_segments_with_end(s, ["session_id", "user_id"], min_speech_us=0, names=("name",)), tmp_path, [(1, 9, LAST, "", False)])
    assert [(r["started_at"], r["ended_at"], r["n_packets"], r["name"]) for r in got.collect()] == [(at(500_000), at(2_000_000), 5, "n0.5")]


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_with_ends_out_of_order(spark, tmp_path, seed):
    rng, rows, t = random.Random(seed), [], 0
    for k in range(500):
        t += rng.choice([20_000] * 20 + [700_000, 1_499_999, 1_500_000, 4_000_000])
        rows.append((1, rng.randrange(3), at(t), f"n{k}", rng.random() < 0.03))
    got, state = replay(spark, dealt(rng, rows, 2, 6, 5_000_000), PACKETS, lambda s: live.live_segments_with_end(s, ["session_id", "user_id"], min_speech_us=100_000, names=("name",)), tmp_path, [(1, 9, LAST, "", False)])
    found = sorted((r["user_id"], r["started_at"], r["ended_at"], r["n_packets"], r["forced"], r["name"]) for r in got.collect())
    assert found == plain_segments(rows, 1_500_000, 100_000, 20_000)
    # Only the last row's key is left.
    assert state[-1] == 1 and max(state) <= 4


def test_quarantine_out_of_order_and_forgotten(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k % 4, at(k * 300_000), k, rng.choice(["error", "error", "data", "none"])) for k in range(400)]
    schema = "ssrc long, at timestamp, n long, outcome string"
    got, state = replay(spark, dealt(rng, rows, 1, 7, 8_000_000), schema, lambda s: live.live_quarantine(s, "n", at="at", forget="1 hour"), tmp_path, [(9, LAST, 9, "error")])
    want = packets.quarantine(spark.createDataFrame(rows, schema), ["ssrc"], ["n"])
    key = lambda df: sorted((r["ssrc"], r["n"], str(r["action"])) for r in df.select("ssrc", "n", "action").collect())
    assert key(got) == key(want)
    assert state[-1] == 1 and max(state) >= 4


def test_runs_of_failures_against_a_loop():
    rng = random.Random(3)
    for _ in range(200):
        outcome, failures = np.array(rng.choices(["error", "data", "none"], [3, 1, 1], k=rng.randrange(1, 20)), object), rng.randrange(3)
        count, want = failures, []
        for x in outcome:
            if x == "error":
                count += 1
                want.append("quarantine" if count == 3 else "drop")
                count %= 3
            else:
                count = 0 if x == "data" else count
                want.append("pass" if x == "data" else None)
        action, after = ordered.runs_of_failures(outcome, failures, 3)
        assert action.tolist() == want and after == count


def test_a_long_silence_forgets(spark, tmp_path):
    rows = [(1, at(0), 0, "error"), (1, at(1_000_000), 1, "error"), (1, at(7_300_000_000), 2, "error"), (1, at(7_300_000_001), 3, "error")]
    got, _ = replay(spark, [rows], "ssrc long, at timestamp, n long, outcome string", lambda s: live.live_quarantine(s, "n", at="at", forget="2 hours"), tmp_path, [(9, LAST, 9, "error")])
    assert [r["action"] for r in got.orderBy("n").collect()] == ["drop", "drop", "drop", "drop"]


def test_names_as_of_in_two_streams(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, rng.choice([0, 1, 2, None]), at(k * 100_000 + 7), f"u{k}", (1 << 60) + k) for k in range(150)]
    updates = [(1, rng.choice([0, 1, None]), rng.choice([f"N{k}", ""]), at(rng.randrange(150) * 100_000), k) for k in range(40)]
    left, right = "guild_id long, user_id long, started_at timestamp, label string, k long", "guild_id long, user_id long, character_name string, updated_at timestamp, seq long"
    for folder, triggers, schema in (("rows", dealt(rng, rows, 2, 5, 4_000_000), left), ("updates", dealt(rng, updates, 3, 4, 4_000_000), right)):
        for part in [*triggers, [(1, 77, LAST, "", 0)] if folder == "rows" else [(1, 78, "", LAST, 0)]]:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")
    stream = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{folder}")
    out = live.live_names_as_of(stream("rows", left), stream("updates", right), "label", delay="30 seconds")
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").where("started_at < '2024-01-01 12:00:00'")
    want = registry.with_names_as_of(spark.createDataFrame(rows, left), spark.createDataFrame(updates, right), "label")
    key = lambda df: sorted((r["k"], r["started_at"], r["label"], r["character_name"]) for r in df.select("k", "started_at", "label", F.col("character_name")).collect())
    assert key(got) == key(want)


def test_keys_of_a_bucket_share_a_state(spark, tmp_path):
    """Sources without and with failures, one of them null, in two buckets; numbers beyond 2^53 beside a missing one stay exact."""
    rng = random.Random(5)
    rows = [((1 << 60) + k % 40 if k % 40 else None, at(k * 50_000), None if k == 7 else (1 << 60) + k, rng.choice(["error", "error", "data", "none"])) for k in range(600)]
    schema = "ssrc long, at timestamp, n long, outcome string"
    transform = lambda s: ordered.quarantine(s, "ssrc", "at", ["n"], "outcome", 3, "10 seconds", buckets=2)
    got, state = replay(spark, dealt(rng, rows, 1, 3, 5_000_000), schema, transform, tmp_path, [(9, LAST, 9, "error")])
    want = packets.quarantine(spark.createDataFrame(rows, schema), ["ssrc"], ["at"])
    key = lambda df: sorted((str(r["ssrc"]), r["at"], str(r["n"]), str(r["action"])) for r in df.select("ssrc", "at", "n", "action").collect())
    assert key(got) == key(want)
    assert max(state) <= 2
