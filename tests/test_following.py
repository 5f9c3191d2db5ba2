"""Vectors after corrections: only changed texts reach the model; a search by buckets."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sessionlore.operators import search
from sessionlore.plans import following
from sessionlore.schemas import NOTES
from sessionlore.sources import versions
from sessionlore.sources.tables import write_bucketed
from sessionlore.streaming import live

T0 = dt.datetime(2024, 1, 1)
NOW = F.lit
BATCH = "guild_id long, note_type string, title string, content string, source_session_id long, metadata_json string, seq long"


@pytest.fixture
def persist(spark, tmp_path):
    names = iter(range(1000))

    def store(df, name):
        path = f"{tmp_path}/stored/{name}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def counting(log, mark, bad="never"):
    log = str(log)

    def make():
        def model(texts):
            if any(bad in t for t in texts):
                if len(texts) > 1:
                    raise ValueError("one by one")
                raise ValueError("bad")
            with open(log, "a") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            return [[float(len(t)), mark] for t in texts]

        return model

    return make


def test_vectors_follow(spark, tmp_path, persist):
    notes_at, vectors_at = f"{tmp_path}/notes", f"{tmp_path}/vectors"
    as_of = F.lit("2024-06-01").cast("timestamp")
    live.notes_writer(notes_at, as_of, buckets=8, stream="s")(spark.createDataFrame([(1, "npc", f"t{i}", f"content {i}", None, "{}", i) for i in range(40)], BATCH), 0)
    first, later = tmp_path / "first", tmp_path / "later"
    assert following.follow(spark, notes_at, vectors_at, counting(first, 1.0), persist)[0] == 0
    assert len(first.read_text().splitlines()) == 40
    fixes = spark.createDataFrame([(1, 3, "new text", 7, 0), (1, 5, "content 4", 7, 1), (1, 9, " ", 7, 2), (2, 3, "other guild", 7, 3), (1, 20, "broken", 7, 4)], "guild_id long, note_id long, content string, user_id long, seq long")
    rejected = following.correct(spark, notes_at, fixes, as_of, "fixes", 0)
    assert {r["note_id"] for r in rejected.collect()} == {9, 3}
    version, failed = following.follow(spark, notes_at, vectors_at, counting(later, 2.0, "broken"), persist)
    # Note 5 was "content 4" before: its text is the same.
    assert version == 1 and [json.loads(x) for x in later.read_text().splitlines()] == ["npc\nt2\nnew text"]
    assert [r["note_id"] for r in failed.collect()] == [20]
    vectors, _ = versions.read_version(spark, vectors_at, "note_embeddings")
    got = {r["note_id"]: list(r["embedding"]) for r in vectors.collect()}
    assert got[3] == [15.0, 2.0] and got[5][1] == 1.0 and 20 not in got and len(got) == 39
    assert following.follow(spark, notes_at, vectors_at, counting(later, 3.0), persist)[1].count() == 0
    assert len(later.read_text().splitlines()) == 1
    following.follow(spark, notes_at, vectors_at, counting(later, 3.0), persist, missing=True)
    vectors, _ = versions.read_version(spark, vectors_at, "note_embeddings")
    assert {r["note_id"]: r["embedding"][1] for r in vectors.collect()}[20] == 3.0 and len(later.read_text().splitlines()) == 2


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    rows = [(i, i % 2, "npc", f"t{i}", "c", None, "{}", T0, T0) for i in range(50)]
    write_bucketed(spark.createDataFrame(rows, NOTES), "notes_by_id", "id", 4, f"{tmp_path}/notes")
    write_bucketed(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 50, 3)], "note_id long, embedding array<double>"), "vectors_by_id", "note_id", 4, f"{tmp_path}/vectors")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = search.with_vectors(spark.table("notes_by_id"), spark.table("vectors_by_id"))
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert {r["id"] for r in both.collect()} == set(range(0, 50, 3))
        asked = spark.createDataFrame([(7, 1, [1.0, 0.0])], "question_id long, guild_id long, embedding array<double>")
        best = search.top_notes(asked, both, 3)
        assert "hashpartitioning(id" not in best._jdf.queryExecution().executedPlan().toString()
        assert [r["note_id"] for r in best.orderBy("rank").collect()] == [45, 39, 33]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE notes_by_id")
        spark.sql("DROP TABLE vectors_by_id")


def test_vectors_of_unequal_length_in_a_batch_search(spark):
    vectors = [[1.0, 2.0], [1.0], [], None, [0.0, 0.0], [1.0, 2.0, 3.0], [float("nan")], [2.0, None]]
    notes = spark.createDataFrame([(1, i, v) for i, v in enumerate(vectors)], "guild_id long, id long, embedding array<double>")
    asked = spark.createDataFrame([(1, 1, [1.0, 2.0, 9.0]), (2, 1, []), (3, 1, [1.0])], "question_id long, guild_id long, embedding array<double>")
    key = lambda df: sorted((r["question_id"], r["note_id"], round(r["score"], 9), r["rank"]) for r in df.where("score is not null and not isnan(score)").collect())
    some = notes.where("id not in (3, 6, 7)")
    assert key(search.top_notes_batch(asked, some, 8)) == key(search.top_notes(asked, some, 8))
    assert search.top_notes_batch(asked, notes, 8).count() == search.top_notes(asked, notes, 8).count()
