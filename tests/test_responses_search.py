import json
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sessionlore.functions.responses import has_content, normalized
from sessionlore.functions.vectors import cosine
from sessionlore.operators import inference, search, summaries
from sessionlore.plans import workloads


def payloads(spark, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", normalized("raw").alias("p")).orderBy("i").collect()
    return [r["p"].asDict(recursive=True) if r["p"] else None for r in rows]


def test_normalized(spark):
    update = lambda **x: {"note_type": "npc", "title": "t", "content": "c"} | x
    raws = [
        "{broken", "[1]", "7", None, "{}", json.dumps({"session_notes_markdown": " a　", "cinematic_summary_markdown": None, "note_updates": {"x": 1}}),
        json.dumps({"note_updates": [update(title=None), update(title=7), update(title=True), update(title=" "), "x", None, update(metadata=[1]), update(metadata={"k": 1}), update(title={"a": 1})]}),
    ]
    got = payloads(spark, raws)
    assert got[:4] == [None] * 4
    assert got[4] == {"session_notes_markdown": "", "cinematic_summary_markdown": "", "note_updates": []}
    assert got[5] == {"session_notes_markdown": "a", "cinematic_summary_markdown": "None", "note_updates": []}
    assert [(u["title"], u["metadata"]) for u in got[6]["note_updates"]] == [("None", "{}"), ("7", "{}"), ("True", "{}"), ("t", "{}"), ("t", '{"k":1}')]


def test_gate(spark):
    rows = [("x" * a, "y" * b) for a, b in ((80, 80), (79, 80), (80, 79))] + [("No Session Notes Available.", "y" * 90), ("N/A", "y" * 90), ("none", "z" * 90)]
    p = F.struct(F.col("a").alias("session_notes_markdown"), F.col("b").alias("cinematic_summary_markdown"))
    got = spark.createDataFrame(rows, "a string, b string").select(has_content(p, 80).alias("ok"), has_content(p, 10).alias("low")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, False, False] and [r["low"] for r in got] == [True, True, True, False, False, False]


def reply(n, updates=()):
    return json.dumps({"session_notes_markdown": "n" * n, "cinematic_summary_markdown": "c" * n, "note_updates": list(updates)})


def test_accepted(spark):
    poor = json.dumps({"session_notes_markdown": "No session notes available.", "cinematic_summary_markdown": "No cinematic summary available."})
    rows = [
        (1, "single", 0, 1, poor, None), (1, "single", 0, 2, reply(80), None), (1, "single", 0, 3, reply(90), None),
        (2, "single", 0, 1, poor, None), (2, "single", 0, 2, poor, None), (2, "single", 0, 4, reply(90), None),
        (3, "single", 0, 1, poor, None), (3, "single", 0, 2, "{broken", None), (4, "chunk", 0, 3, reply(40), None), (5, "final", 0, 1, None, "timeout"),
    ]
    got = {r["session_id"]: (r["attempt"], r["error"]) for r in summaries.accepted_responses(spark.createDataFrame(rows, "session_id long, stage string, chunk_no int, attempt int, raw string, error string")).collect()}
    assert got == {1: (2, None), 2: (None, summaries.LOW_CONTENT), 3: (None, summaries.RAISED), 4: (3, None), 5: (None, summaries.RAISED)}


def merge_plainly(rows):
    out = {}
    for kind, title, content in rows:
        kind, title, content = kind.strip(), title.strip(), content.strip()
        key = kind.lower(), title.lower()
        if kind and title and content and (key not in out or len(content) > len(out[key][2])):
            out[key] = (kind, title, content)
    return list(out.values())


def test_merge(spark):
    rng = random.Random(5)
    rows = [[(rng.choice(["npc", "NPC ", "place", ""]), rng.choice(["A", "a", "B", " "]), "x" * rng.randint(0, 3) + rng.choice("pq ")) for _ in range(30)] for _ in range(20)]
    flat = [(s, i, *r, None) for s, group in enumerate(rows) for i, r in enumerate(group)]
    got = summaries.merged_updates(spark.createDataFrame(flat, "session_id long, seq int, note_type string, title string, content string, metadata string")).orderBy("session_id", "seq").collect()
    for s, group in enumerate(rows):
        assert [(r["note_type"], r["title"], r["content"]) for r in got if r["session_id"] == s] == merge_plainly(group)


def test_cosine_and_top(spark, monkeypatch):
    def plain(a, b):
        n = sum(x * y for x, y in zip(a, b, strict=False))
        d = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return n / d if d else 0.0

    pairs = [([], [1.0]), ([0.0], [1.0]), ([1.0, 2.0], [3.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0, 0.0], [0.0, 1.0])]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [plain(*p) for p in pairs])
    rng = np.random.default_rng(1)
    notes = [(i, int(i % 3), "k", f"t{i}", f"c{i}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    asked = [(q, q % 4, [float(x) for x in rng.integers(-2, 3, 4)]) for q in range(9)]
    n = spark.createDataFrame(notes, "id long, guild_id long, note_type string, title string, content string, embedding array<double>")
    q = spark.createDataFrame(asked, "question_id long, guild_id long, embedding array<double>")
    small = search.top_notes(q, n, 5)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search._grouped, "__defaults__", (10, 2))
    for rows in (small, search.top_notes(q, n, 5), search.top_notes_batch(q, n, 5), search.top_notes_batch(q, n, 5, group_notes=7, group_questions=1)):
        found = rows.orderBy("question_id", "rank").collect()
        for k, guild, v in asked:
            scores = {i: plain(v, w) for i, g, *_, w in notes if g == guild}
            mine = [r for r in found if r["question_id"] == k]
            assert len(mine) == min(5, len(scores))
            best = sorted(scores.values(), reverse=True)[:5]
            assert np.allclose([r["score"] for r in mine], best) and np.allclose([scores[r["note_id"]] for r in mine], best)
    texts = {r[0]: r[1] for r in search.contexts(q, n, 2).collect()}
    assert texts[3] == "I do not have any campaign notes saved yet." and texts[0].count("[k] t") == 2


def test_with_model(spark):
    def make():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [None if t == "empty" else t.upper() for t in texts]

        return model

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "empty")], "i int, text string").coalesce(1)
    got = {r["i"]: (r["out"], r["out_error"]) for r in inference.with_model(rows, "text", make, "out", attempts=2).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("", None)}


def test_summary_job(spark, tmp_path):
    import datetime as dt

    from sessionlore.schemas import NOTES, SEGMENTS

    def make():
        import json

        def one(text):
            update = {"note_type": "npc", "title": "T", "content": "x" * (len(text) % 7 + 1)}
            return json.dumps({"session_notes_markdown": "n" * 90, "cinematic_summary_markdown": "c" * 90, "note_updates": [update]})

        return lambda texts: [one(t) for t in texts]

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1 + (i == 0), 1, "d", "", t0 + dt.timedelta(seconds=i), t0, "p", "word " * 20) for i in range(12)]

    def persist(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    texts, updates = workloads.session_summaries(spark.createDataFrame([(1,), (2,)], "session_id long"), spark.createDataFrame(rows, SEGMENTS), make, persist, single_pass=300, limit=300)
    got = {r["session_id"]: r["markdown"] for r in texts.collect()}
    assert set(got) == {1, 2} and all(t.startswith("# Session Notes\n\nnnn") for t in got.values())
    assert updates.count() == 2
    sessions = spark.createDataFrame([(1, 9), (2, 9)], "id long, guild_id long")
    after = workloads.notes_after(spark.createDataFrame([], NOTES), updates, sessions, F.lit("2024-06-01").cast("timestamp"))
    assert [(r["id"], r["guild_id"], r["title"]) for r in after.collect()] == [(1, 9, "T")]
    vectors = workloads.embedded(after, lambda: lambda ts: [[1.0, 2.0] for _ in ts])
    asked = spark.createDataFrame([(1, 9, [1.0, 2.0])], "question_id long, guild_id long, embedding array<double>")
    assert workloads.retrieval(asked, after, vectors).first()["context"].startswith("[npc] T\nx")


def test_scores_are_rounded_before_the_best_are_taken(spark):
    """Of two likenesses that are equal at six digits the smaller id comes first, also
    where only one of them is taken."""
    n = spark.createDataFrame([(1, 0, [1.0, 1.00001e-4]), (2, 0, [1.0, 1e-4]), (3, 0, [0.0, 1.0]), (4, 0, [-1.0, 0.0])], "id long, guild_id long, embedding array<double>")
    q = spark.createDataFrame([(7, 0, [1.0, 0.0])], "question_id long, guild_id long, embedding array<double>")
    for k in (1, 4):
        got, want = ([tuple(r) for r in f(q, n, k, digits=6).select("note_id", "score", "rank").orderBy("rank").collect()] for f in (search.top_notes_batch, search.top_notes))
        assert got == want and got[0][0] == 1
    assert search.top_notes_batch(q, n, 1).first()["note_id"] == 2


def test_a_model_holds_the_rows_of_one_call(spark):
    """Rows come in batches as large as Spark's, and leave call by call."""
    seen = []
    rows = spark.range(200, numPartitions=1).select(F.when(F.col("id") != 5, F.col("id") + (1 << 60)).alias("id"), F.lit("a").alias("text"))

    def make():
        def model(texts):
            seen.append(len(texts))
            return [[float(len(seen)), None] for _ in texts]

        return model

    found = inference.with_model(rows, "text", make, "v", kind="array<double>", batch=64)
    got = found.collect()
    assert [r["v"][0] for r in got] == [1.0] * 64 + [2.0] * 64 + [3.0] * 64 + [4.0] * 8 and got[0]["v"][1] is None
    assert got[5]["id"] is None and got[199]["id"] == (1 << 60) + 199
    sizes = found.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
    assert sum(r["n"] for r in sizes.collect()) == 200
