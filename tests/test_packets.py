import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import packets as P
from sessionlore.operators import registry
from sessionlore.plans import workloads
from sessionlore.sources.packets import HEADER_ERROR, PAYLOAD_ERROR, archives_of, packets_of, read_archives

T0 = dt.datetime(2024, 1, 1)


def at(us):
    return T0 + dt.timedelta(microseconds=us)


def bursts(spark, starts, counts, end=None, gap=20_000):
    """One user's packets: bursts that begin at ``starts`` (microseconds)."""
    rows, k = [], 0
    for s, n in zip(starts, counts, strict=True):
        for i in range(n):
            rows.append((1, 1, at(s + i * gap), k))
            k += 1
    df = spark.createDataFrame(rows, "session_id long, user_id long, received_at timestamp, arrival_no long")
    ends = spark.createDataFrame([(1, at(end))], "session_id long, end_at timestamp") if end is not None else None
    return P.speech_segments(df, ["session_id", "user_id"], session_end=ends).orderBy("burst").collect()


def test_valid_packets(spark):
    rows = spark.createDataFrame([(1, b"x", 1), (None, b"x", 1), (1, b"", 1), (1, None, 1), (1, b"x", None)], "user_id long, payload binary, sequence int")
    assert P.valid_packets(rows).count() == 1


@pytest.mark.parametrize(("silence", "n"), [(1_499_999, 1), (1_500_000, 2), (1_500_001, 2)])
def test_silence(spark, silence, n):
    assert len(bursts(spark, [0, 39 * 20_000 + silence], [40, 40])) == n


def test_least_speech_and_forced_end(spark):
    assert len(bursts(spark, [0], [37])) == 0
    got = bursts(spark, [0], [38])
    assert len(got) == 1 and got[0]["duration_s"] == 0.76
    last = 10_000_000 + 4 * 20_000
    assert [r["forced"] for r in bursts(spark, [0, 10_000_000], [40, 5], end=last + 1_499_999)] == [False, True]
    assert len(bursts(spark, [0, 10_000_000], [40, 5], end=last + 1_500_000)) == 1


def loss(sequences, limit=75):
    out, before = 0, None
    for s in sequences:
        if before is not None and 1 <= (g := (s - before - 1) % 65536) <= limit:
            out += g
        before = s
    return out


def test_loss(spark):
    rng = random.Random(1)
    runs = [[65534, 65535, 0, 1], [0, 2], [0, 76], [0, 77], [5, 3, 4], [7, 7], [65535, 3]]
    runs += [[rng.randrange(65536) if rng.random() < 0.1 else i * rng.randint(1, 3) % 65536 for i in range(100)] for _ in range(20)]
    rows = [(k, i, s) for k, r in enumerate(runs) for i, s in enumerate(r)]
    got = {r["segment"]: r for r in P.loss_profile(spark.createDataFrame(rows, "segment int, arrival_no int, sequence int"), ["segment"]).collect()}
    for k, r in enumerate(runs):
        assert got[k]["concealed"] == loss(r) and got[k]["frames"] == len(r) + loss(r)


def actions(outcomes):
    out, n = [], 0
    for o in outcomes:
        if o == "error":
            n += 1
            out.append("quarantine" if n == 3 else "drop")
            n %= 3
        else:
            n = 0 if o == "data" else n
            out.append("pass" if o == "data" else None)
    return out


def test_quarantine(spark):
    rng = random.Random(2)
    runs = [["error", "error", "data", "error", "error", "error"], ["error", "none", "error", "error"], ["error"] * 6]
    runs += [[rng.choice(["error", "error", "data", "none"]) for _ in range(50)] for _ in range(10)]
    rows = [(k, i, o) for k, r in enumerate(runs) for i, o in enumerate(r)]
    got = P.quarantine(spark.createDataFrame(rows, "ssrc int, n int, outcome string"), ["ssrc"], ["n"]).orderBy("ssrc", "n").collect()
    for k, r in enumerate(runs):
        assert [x["action"] for x in got if x["ssrc"] == k] == actions(r)


def test_archives(spark, tmp_path):
    rows = [("a", 1, 5, 9, b"two"), ("a", 0, 65535, 4294967295, b""), ("b", 0, 1, 2, b"x" * 1000)]
    files = archives_of(spark.createDataFrame(rows, "path string, arrival_no long, sequence int, timestamp long, payload binary"))
    back = packets_of(files).orderBy("path", "packet_no").collect()
    assert [(r["path"], r["sequence"], r["timestamp"], bytes(r["payload"])) for r in back] == [("a", 65535, 4294967295, b""), ("a", 5, 9, b"two"), ("b", 1, 2, b"x" * 1000)]
    whole = bytes(files.where("path = 'a'").first()["content"])
    for name, content in {"ok": whole, "empty": b"", "head": whole[:-8], "cut": whole + b"\x01", "payload": whole[:-1]}.items():
        (tmp_path / f"{name}.skopus").write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in read_archives(spark, str(tmp_path)).collect()}
    assert got == {"ok.skopus": None, "cut.skopus": HEADER_ERROR, "payload.skopus": PAYLOAD_ERROR, "head.skopus": HEADER_ERROR}


def test_names(spark):
    ups = spark.createDataFrame([(1, 1, " Ann ", at(10), 0), (1, 1, "Bea", at(20), 1), (1, 2, "", at(0), 2)], "guild_id long, user_id long, character_name string, updated_at timestamp, seq long")
    rows = spark.createDataFrame([(1, 1, at(9), "f"), (1, 1, at(10), "f"), (1, 1, at(25), "f"), (1, 2, at(5), "f"), (1, 3, at(5), "f"), (None, 1, at(30), "f")], "guild_id long, user_id long, started_at timestamp, fallback string")
    got = registry.with_names_as_of(rows, ups, "fallback").orderBy("guild_id", "user_id", "started_at").collect()
    assert [r["character_name"] for r in got] == ["f", "f", " Ann ", "Bea", "", "f"]
    now = registry.register(ups.drop("seq").limit(0), ups)
    assert {(r["user_id"], r["character_name"]) for r in now.collect()} == {(1, "Bea"), (2, "")}
    assert [r["character_name"] for r in registry.with_names(rows, now, "fallback").orderBy("user_id", F.col("guild_id")).collect()] == ["f", "Bea", "Bea", "Bea", "", "f"]


def test_recording_job(spark):
    rows = [(1, 1, 5, "", "acct", 3, i, i, b"x", at(i * 20_000), i) for i in range(50)]
    packets = spark.createDataFrame(rows, "guild_id long, session_id long, user_id long, display_name string, name string, ssrc long, sequence int, rtp_timestamp long, payload binary, received_at timestamp, arrival_no long")
    ups = spark.createDataFrame([(1, 5, "Ann", at(0))], "guild_id long, user_id long, character_name string, updated_at timestamp")
    got = workloads.segments_of_recordings(packets, ups).collect()
    assert [(r["display_name"], r["character_name"], r["n_packets"], r["audio_path"]) for r in got] == [("acct", "Ann", 50, "sessions/1/audio/1704067200000_5_Ann.skopus")]
