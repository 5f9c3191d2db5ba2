"""Versioned tables: crashes, repeated batches, new streams, two writers, buckets."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import notes, registry
from sessionlore.sources import versions
from sessionlore.streaming import live

T0 = dt.datetime(2024, 1, 1)
NAMES = "guild_id long, user_id long, character_name string, updated_at timestamp, seq long"


def names(spark, *pairs):
    return spark.createDataFrame([(1, u, n, T0, i) for i, (u, n) in enumerate(pairs)], NAMES)


def held(spark, folder):
    rows, version = versions.read_version(spark, folder, "character_registry")
    return {r["user_id"]: r["character_name"] for r in rows.collect()}, version


def test_an_unfinished_try_is_in_nobodys_way(spark, tmp_path):
    folder = str(tmp_path)
    write = live.registry_writer(folder, buckets=4, stream="s")
    (tmp_path / "data" / "crashed" / "bucket=0").mkdir(parents=True)
    (tmp_path / "_log").mkdir()
    (tmp_path / "_log" / ".draft").write_text("{")

    def broken(old, batch):
        return registry.register(old, batch).withColumn("user_id", F.raise_error(F.lit("crash")).cast("long"))

    with pytest.raises(Exception, match="crash"):
        live.snapshot_writer(folder, "character_registry", broken, registry.KEYS, 4, "s")(names(spark, (1, "A")), 0)
    assert held(spark, folder) == ({}, -1)
    write(names(spark, (1, "A")), 0)
    write(names(spark, (1, "never")), 0)
    assert held(spark, folder) == ({1: "A"}, 0)
    assert versions.expire(spark, folder, older_than_s=-10) >= 1 and not (tmp_path / "data" / "crashed").exists() and held(spark, folder) == ({1: "A"}, 0)


def test_a_new_stream_over_an_old_table_loses_nothing(spark, tmp_path):
    folder, source = f"{tmp_path}/table", f"{tmp_path}/in"

    def run(state):
        rows = spark.readStream.schema(NAMES).parquet(source)
        rows.writeStream.foreachBatch(live.registry_writer(folder, buckets=4)).option("checkpointLocation", f"{tmp_path}/{state}").trigger(availableNow=True).start().awaitTermination()

    for user in (1, 2, 3):
        names(spark, (user, f"n{user}")).write.mode("append").parquet(source)
        run("old")
    assert held(spark, folder)[0] == {1: "n1", 2: "n2", 3: "n3"}
    names(spark, (99, "late")).write.mode("append").parquet(source)
    run("new")
    assert held(spark, folder)[0] == {1: "n1", 2: "n2", 3: "n3", 99: "late"}
    assert len(versions.manifest(spark, folder)["streams"]) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    folder = str(tmp_path)
    draft = {"version": 0, "table": "character_registry", "keys": [], "buckets": 1, "files": {}, "streams": {}, "last": 0}
    assert versions._published(spark, folder, draft) and not versions._published(spark, folder, draft | {"last": 5})
    assert versions.manifest(spark, folder)["last"] == 0
    writers = [threading.Thread(target=lambda u=u: live.registry_writer(f"{folder}/t", buckets=8, stream=f"s{u}")(names(spark, (u, f"n{u}")), 0)) for u in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert held(spark, f"{folder}/t") == ({u: f"n{u}" for u in range(6)}, 5)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    folder = str(tmp_path)
    write = live.registry_writer(folder, buckets=8, stream="s")
    write(names(spark, *[(u, f"n{u}") for u in range(200)]), 0)
    before = versions.manifest(spark, folder)["files"]
    write(names(spark, (5, "new "), (5, " newer")), 1)
    after = versions.manifest(spark, folder)["files"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert held(spark, folder)[0] == {u: f"n{u}" for u in range(200)} | {5: "newer"}
    old, _ = versions.read_version(spark, folder, "character_registry", 0)
    assert {r["user_id"]: r["character_name"] for r in old.collect()}[5] == "n5"
    write(names(spark).limit(0), 2)
    assert versions.manifest(spark, folder)["files"] == after


def test_buckets_give_the_whole_tables_notes(spark, tmp_path):
    now = F.lit("2024-06-01").cast("timestamp")
    schema = "guild_id long, note_type string, title string, content string, source_session_id long, metadata_json string, seq long"
    write = live.notes_writer(str(tmp_path), now, buckets=5, stream="s")
    whole, last, seen = spark.createDataFrame([], versions.TABLES["campaign_notes"]), 0, 0
    for k in range(3):
        rows = [(g, "npc ", f" t{((g or 3) * 7 + i + k) % 9}", f"c{k}{i}" if i % 4 else " ", k, "{}", i) for g in (1, 2, None) for i in range(6 + k)]
        batch = spark.createDataFrame([(*r[:6], n) for n, r in enumerate(rows)], schema)
        write(batch, k)
        whole = spark.createDataFrame(notes.upsert(whole, batch, now, last).collect(), versions.TABLES["campaign_notes"])
        last = max(last, whole.agg(F.max("id")).first()[0] or 0)
    found, version = versions.read_version(spark, str(tmp_path), "campaign_notes")
    key = lambda rows: sorted(map(str, rows.collect()))
    assert version == 2 and key(found) == key(whole)


def test_a_merge_must_not_move_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="does not touch"):
        versions.merge(names(spark, (1, "A")), str(tmp_path), "character_registry", lambda old, b: b.withColumn("user_id", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("seq"), registry.KEYS, 16)
