"""Model calls in rounds: prompts, repeats only after a refusal, runs that go on."""

import json

import pytest

from sessionlore.operators.calls import Wording, answered

WORDING = Wording("Tell.", "AGAIN", "ALL PARTS", "Project text")
GOOD = json.dumps({"session_notes_markdown": "n" * 90, "cinematic_summary_markdown": "c" * 90})
EMPTY = json.dumps({"session_notes_markdown": "None", "cinematic_summary_markdown": "c" * 90})
CALLS = "session_id long, stage string, chunk_no int, text string"


def recording(log, reply, end_on=None):
    """A model that notes its prompts in a file."""
    log = str(log)

    def make():
        import json

        class Ended(BaseException):
            pass

        def model(prompts):
            for p in prompts:
                if end_on and end_on in p:
                    raise Ended
                with open(log, "a") as f:
                    f.write(json.dumps(p) + "\n")
            return [reply(p) for p in prompts]

        return model

    return make


def asked(log):
    return [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []


@pytest.fixture
def persist(spark, tmp_path):
    names = iter(range(1000))

    def store(df, name):
        path = f"{tmp_path}/stored/{name}-{next(names)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


def test_a_call_is_repeated_only_after_a_refusal(spark, tmp_path, persist):
    good, empty = GOOD, EMPTY

    def reply(p):
        return good if "good" in p or ("later" in p and "AGAIN" in p) else "{" if "broken" in p else empty

    calls = spark.createDataFrame([(1, "single", 0, "good"), (2, "single", 0, "later"), (3, "final", 0, "empty"), (4, "chunk", 1, "broken"), (5, "single", 0, "good")], CALLS)
    log = tmp_path / "log"
    rows = answered(calls, recording(log, reply), f"{tmp_path}/ledger", WORDING, persist).collect()
    got = {r["session_id"]: (r["attempt"], r["error"], r["n_attempts"]) for r in rows}
    assert got == {1: (1, None, 1), 2: (2, None, 2), 3: (None, "Could not generate non-empty summary", 3), 4: (None, "Could not generate summary", 3), 5: (1, None, 1)}
    prompts = asked(log)
    # Equal prompts are asked once.
    assert sum(p.endswith("good") for p in prompts) == 1 and len(prompts) == 1 + 2 + 3 + 3
    assert "Tell.\nProject text\n\nSession transcript:\ngood" in prompts
    assert "Tell.\nAGAIN\nProject text\n\nSession transcript:\nlater" in prompts
    assert sum("ALL PARTS" in p for p in prompts) == 3 and sum("AGAIN" in p for p in prompts) == 5


def test_a_run_that_was_ended_goes_on(spark, tmp_path, persist):
    calls = spark.createDataFrame([(i, "single", 0, f"t{i}") for i in range(12)], CALLS)
    log, ledger, good, empty = tmp_path / "log", f"{tmp_path}/ledger", GOOD, EMPTY
    with pytest.raises(Exception):
        answered(calls, recording(log, lambda p: empty, end_on="AGAIN"), ledger, WORDING, persist)
    assert len(asked(log)) == 12
    done = answered(calls, recording(log, lambda p: good if "AGAIN" in p else empty), ledger, WORDING, persist, slices=3)
    assert [(r["attempt"], r["n_attempts"]) for r in done.collect()] == [(2, 2)] * 12
    assert len(asked(log)) == 24
    again = answered(calls, recording(log, lambda p: "never"), ledger, WORDING, persist)
    assert again.where("attempt = 2").count() == 12 and len(asked(log)) == 24


def test_no_calls(spark, tmp_path, persist):
    assert answered(spark.createDataFrame([], CALLS), recording(tmp_path / "log", str), f"{tmp_path}/ledger", WORDING, persist).collect() == []
