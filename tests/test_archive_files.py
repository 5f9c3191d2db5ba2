"""Packets to files and back, broken files, listings and routes."""

import random
import struct

import numpy as np
import pytest

from sessionlore.operators import packets as operators
from sessionlore.sources import packets

PACKETS = "path string, arrival_no long, sequence int, timestamp long, payload binary"


def plain(content):
    at, found = 0, []
    while at < len(content):
        if at + 8 > len(content):
            return [packets.HEADER_ERROR]
        sequence, timestamp, size = struct.unpack_from("<HIH", content, at)
        if at + 8 + size > len(content):
            return [packets.PAYLOAD_ERROR]
        found.append((sequence, timestamp, content[at + 8 : at + 8 + size]))
        at += 8 + size
    return found


@pytest.mark.parametrize("in_step", [0, 3, 1000])
def test_frames_against_a_loop(monkeypatch, in_step):
    import pyarrow as pa

    monkeypatch.setattr(packets, "IN_STEP", in_step)
    rng, files = random.Random(in_step), []
    for k in range(120):
        content = b"".join(struct.pack("<HIH", rng.randrange(65536), rng.randrange(1 << 32), n) + rng.randbytes(n) for n in rng.choices([0, 1, 5, 300], k=rng.randrange(8)))
        files.append(content[: len(content) - rng.choice([0, 0, 1, 3, 9])] if k % 3 else content)
    files[7] = None
    found = packets.packet_batch(pa.array([str(k) for k in range(len(files))]), pa.array(files, pa.binary()))
    got = {str(k): [] for k in range(len(files))}
    for path, no, sequence, timestamp, payload, error in zip(*[x.to_pylist() for x in found.values()], strict=True):
        assert (no is None) == (error is not None) and (error or no == len(got[path]))
        got[path].append(error or (sequence, timestamp, payload))
    assert got == {str(k): plain(f or b"") for k, f in enumerate(files)}


def test_files_and_back(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"sessions/{k % 5}/audio/{k % 5}_é {k % 3}.skopus", k, k % 65536, 4_000_000_000 + k, rng.randbytes(rng.choice([0, 3, 200]))) for k in range(900)]
    folder = f"file://{tmp_path}/store"
    packets.write_archives(spark.createDataFrame(rows, PACKETS).repartition(4), folder, partitions=3)
    register = packets.register
    register(spark)
    for size in (1, 1 << 20):
        found = spark.read.format("skopus").option("partitionBytes", size).load(folder)
        assert found.rdd.getNumPartitions() == (15 if size == 1 else 1)
        got = {}
        for r in found.orderBy("path", "packet_no").collect():
            got.setdefault(r["path"], []).append((r["sequence"], r["timestamp"], bytes(r["payload"])))
        want = {}
        for r in rows:
            want.setdefault(r[0], []).append((r[2], r[3], r[4]))
        assert got == want
    assert {r["path"] for r in packets.listing(spark, folder).collect()} == {r[0] for r in rows}
    packets.write_files(spark.createDataFrame([("cut.skopus", b"abc"), ("empty.skopus", b""), ("x.wav", b"w")], "path string, content binary"), folder)
    broken = spark.read.format("skopus").load(folder).where("error is not null").collect()
    assert [(r["path"], r["error"]) for r in broken] == [("cut.skopus", packets.HEADER_ERROR)]
    assert packets.read_archives(spark, folder).where("error is null").count() == 900


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    rows = [("good.skopus", 1, 1, 1, b"x"), ("z/../../bad.skopus", 2, 1, 1, b"x")]
    with pytest.raises(Exception, match="not a path below"):
        packets.write_archives(spark.createDataFrame(rows, PACKETS), str(tmp_path), partitions=1)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
    with pytest.raises(Exception, match="65,535"):
        packets.write_archives(spark.createDataFrame([("good.skopus", 1, 1, 1, bytes(70_000))], PACKETS), str(tmp_path))


def test_routes_by_listing(spark, tmp_path):
    files = [("a/1.skopus", b"x"), ("a/1.wav", b"x"), ("a/2.skopus", b"x"), ("a/4.wav", b"x")]
    packets.write_files(spark.createDataFrame(files, "path string, content binary"), str(tmp_path))
    segments = spark.createDataFrame([(1, "a/1.skopus"), (2, "a/2.SKOPUS"), (3, "a/3.mp3"), (4, "a/4.wav"), (5, "a/5.WAV"), (6, None)], "id int, audio_path string")
    got = {r["id"]: (r["route"], r["ready_path"]) for r in operators.routed(segments, packets.listing(spark, str(tmp_path))).collect()}
    assert got == {1: ("ready", "a/1.wav"), 2: ("decode", "a/2.wav"), 3: ("unsupported", None), 4: ("ready", "a/4.wav"), 5: ("ready", "a/5.WAV"), 6: got[6]}


def test_frames_of_nothing():
    file, at, broken = packets.frames(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(file) == len(at) == len(broken) == 0


def test_no_list_of_files_passes_the_driver(spark, tmp_path, monkeypatch):
    """Folders beyond a number are dealt to tasks, and a task's message has no paths."""
    rows = [(f"u{k % 9}/{k}.skopus", k, k, k, b"x%d" % k) for k in range(90)]
    packets.write_archives(spark.createDataFrame(rows, PACKETS), str(tmp_path), partitions=3)
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("_")] == []
    monkeypatch.setattr(packets, "LISTED", 5)
    monkeypatch.setattr(packets, "FOLDER_TASKS", 4)
    reader = packets.ArchiveReader(str(tmp_path), ".skopus", 1 << 20)
    parts = reader.partitions()
    assert all(p.folders for p in parts) and [len(p.paths) for p in parts] == [3, 3, 3]
    got = sorted(x for p in parts for batch in reader.read(p) for x in batch.column("path").to_pylist())
    assert got == sorted(r[0] for r in rows)
    assert "paths" not in packets.Written.__dataclass_fields__
    # Files that an earlier try has put in place stay there.
    writer = packets.ArchiveWriter(str(tmp_path), "_staged-again")
    import pyarrow as pa

    done = writer.write(iter([pa.record_batch({"path": ["a/1.skopus", "a/2.skopus"], "content": pa.array([b"1", b"2"], pa.binary())})]))
    for _ in range(2):
        assert packets._put(str(tmp_path), [done.staged]) == 2
    assert (tmp_path / "a/2.skopus").read_bytes() == b"2"


def test_files_that_are_asked_for(spark, tmp_path):
    packets.write_files(spark.createDataFrame([("a/1.wav", b"x"), ("a/é 2.wav", b"xy")], "path string, content binary"), str(tmp_path))
    asked = spark.createDataFrame([("a/1.wav",), ("a/é 2.wav",), ("a/1.wav",), ("a/3.wav",), ("a",), (None,), ("b/../a/1.wav",)], "path string")
    assert sorted(tuple(r) for r in packets.existing(asked, str(tmp_path)).collect()) == [("a/1.wav", 1), ("a/é 2.wav", 2)]
