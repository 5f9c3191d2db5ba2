"""Chunks from lines equal chunks of whole transcripts."""

import datetime as dt
import random

import pytest

from sessionlore.operators import long_transcripts, transcripts
from sessionlore.plans import workloads
from sessionlore.schemas import SEGMENTS

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def persist(spark, tmp_path):
    names = iter(range(10_000))

    def store(df, name):
        path = f"{tmp_path}/{name}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def test_chunks_equal_those_of_whole_transcripts(spark, persist):
    rng, rows = random.Random(6), []
    for session in range(12):
        for k in range(rng.randrange(60)):
            words = "".join(rng.choice(["word", " ", "\n", "\r\n", "\r", " ", "\x0b", "é", "long" * 9]) for _ in range(rng.randrange(1, 25)))
            rows.append((k, session, 1, rng.choice(["d", "name\n"]), rng.choice(["", "C", None]), T0 + dt.timedelta(seconds=rng.randrange(20)), T0, "p", rng.choice([words, words, words, " \n", None])))
    segments = spark.createDataFrame(rows, SEGMENTS)
    sessions = spark.createDataFrame([(s,) for s in range(13)], "session_id long")
    key = lambda df: sorted((r["session_id"], r["stage"], r["chunk_no"], r["text"]) for r in df.collect())
    for single, limit in ((300, 100), (0, 37), (900, 200), (10**6, 100)):
        want = key(workloads.model_inputs(transcripts.transcripts(sessions, segments), single, limit))
        assert key(long_transcripts.chunks(sessions, segments, persist, single, limit)) == want
