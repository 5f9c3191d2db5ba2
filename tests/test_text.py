import random

from pyspark.sql import functions as F

from sessionlore.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_strip_and_usable(spark):
    for value in ["", " a ", "　a\u0085", "\u001c\t", "a b", " x  ", None]:
        assert one(spark, value, T.strip("x")) == (None if value is None else value.strip())
        assert one(spark, value, T.is_usable("x")) == bool((value or "").strip())


def test_labels(spark):
    rows = spark.createDataFrame([("", "", 7), ("d", "n", 7), (None, None, 7), (None, "n", 7)], "d string, n string, u long")
    assert [r[0] for r in rows.select(T.display_label("d", "n", "u")).collect()] == ["", "d", "7", "n"]
    rows = spark.createDataFrame([("", "d"), (None, "d"), (" ", "d")], "c string, d string")
    assert [r[0] for r in rows.select(T.speaker_label("c", "d")).collect()] == ["d", "d", " "]


def test_safe_names_and_paths(spark):
    for value, want in [("Él-ra", "Él_ra"), ("___", "speaker"), ("", "speaker"), ("漢字 7", "漢字_7"), ("a!b?", "a_b")]:
        assert one(spark, value, T.safe_name("x")) == want
    row = spark.sql("select timestamp'2024-01-01 00:00:01.9999' t").select(T.archive_name("t", F.lit(5), F.lit("A b")))
    assert row.first()[0] == "1704067201999_5_A_b.skopus"
    routes = [(p, one(spark, p, T.suffix_route("x", F.lit(False)))) for p in ("a/b.WAV", "a/b.skopus", "a.wav/b", "b.mp3")]
    assert routes == [("a/b.WAV", "ready"), ("a/b.skopus", "decode"), ("a.wav/b", "unsupported"), ("b.mp3", "unsupported")]
    assert one(spark, "b.SKOPUS", T.suffix_route("x", F.lit(True))) == "ready"


def test_preview(spark):
    assert one(spark, "a\t\nb  c ", T.preview("x")) == "a b c"
    assert one(spark, "x" * 110, T.preview("x")) == "x" * 110
    assert one(spark, "x" * 111, T.preview("x")) == "x" * 107 + "..."


def test_message_pieces(spark):
    known = {
        "": [""], "  short ": ["  short "], " " * 60: [], "x" * 61: ["x" * 30, "x" * 30, "x"], "a" * 29 + "\n\n" + "b" * 40: ["a" * 29, "b" * 30, "b" * 10],
        "a" * 28 + "\n\n" + "b" * 40: ["a" * 28, "b" * 30, "b" * 10], "one\n\ntwo\nthree" + " four" * 6: ["one", "two", "three four four four four four", "four"],
        "one\ntwo three four five six seven eight": ["one", "two three four five six seven", "eight"], "🙂" * 31: ["🙂" * 30, "🙂"],
    }
    rng = random.Random(3)
    texts = [None, *known, *("".join(rng.choice("ab \n") for _ in range(rng.randint(0, 200))) for _ in range(300))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.message_pieces("x", 30).alias("p")).collect()
    for r in rows:
        text, got = texts[r["i"]], r["p"]
        if text is None or len(text) <= 30:
            assert got == (None if text is None else [text])
            continue
        assert got == known.get(text, got)
        assert "".join("".join(got).split()) == "".join(text.split()) and all(0 < len(p) <= 30 and p == p.strip() for p in got)
        # Each cut is the last one of its kind that fits.
        at = 0
        for piece, later in zip(got, got[1:], strict=False):
            begin = text.index(piece, at)
            at = text.index(later[0], begin + len(piece))
            taken, head = text[begin:at].rstrip(), text.strip()[len(text[:begin].lstrip()) :][:30]
            blank, line = head.rfind("\n\n"), head.rfind("\n")
            assert taken == piece == head[: blank if blank > 0 else line if line > 0 else 30].strip()


def test_splits_take_linear_time(spark):
    import time

    def took(n):
        rows = spark.createDataFrame([("some words of a line\n" * n,)], "x string")
        began = time.time()
        assert rows.select(F.size(T.transcript_chunks("x", 90_000, 45_000)), F.size(T.message_pieces("x"))).first()[0] > 1
        return time.time() - began

    took(10_000)
    assert took(400_000) < 8 * took(100_000) + 2


def chunk_plainly(text, limit):
    if len(text) <= limit:
        return [text]
    lines = text.splitlines()
    lines = lines[2:] if len(lines) > 2 else lines
    out, now, size = [], [], 0
    for line in lines:
        if now and size + len(line) + 1 > limit:
            out.append(now)
            now, size = [], 0
        now.append(line)
        size += len(line) + 1
    out += [now] if now else []
    return ["# Transcript\n\n" + "\n".join(c).strip() + "\n" for c in out]


def test_transcript_chunks(spark):
    rng = random.Random(4)
    ends = ["\n", "\r\n", " ", "\x0b", "\n\n", "\x1c"]
    texts = ["# Transcript\n\n" + "\n".join(f"Speaker: line {i}" for i in range(1, 25)), "x" * 100, "a\n" + "y" * 95, "# T\n\n" + "z" * 200 + "\nshort", "", None]
    texts += ["".join(rng.choice("abc ") if rng.random() < 0.9 else rng.choice(ends) for _ in range(rng.randint(0, 400))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.transcript_chunks("x", 40, 90).alias("c")).collect()
    for r in rows:
        text = texts[r["i"]]
        assert r["c"] == (None if text is None else chunk_plainly(text, 90)), repr(text)
    assert len(next(r["c"] for r in rows if r["i"] == 0)) == 5


def test_templates(spark):
    row = spark.sql("select 42L s, 'notes' n, 'tale' c, 1 k, 0 z, repeat('e', 2000) e")
    got = row.select(T.completion_notice("s", "n", "c", "k"), T.completion_notice("s", "n", "c", "z"), T.failure_notice("e"), T.summary_markdown("n", "c"), T.answer_text("e"), T.embedding_text("n", "c", "n"), T.question_prompt("n", "c")).first()
    assert got[0] == "## Session 42\n\n### Session Notes\nnotes\n\n### Cinematic Summary\ntale\n\nUpdated 1 campaign notes."
    assert got[1].endswith("tale") and len(got[2]) == len("Session processing failed: ") + 1800
    assert got[3] == "# Session Notes\n\nnotes\n\n# Cinematic Summary\n\ntale\n" and len(got[4]) == 1900 and got[5] == "notes\ntale\nnotes"
    assert got[6] == "Question: notes\n\nRelevant campaign notes:\ntale"
    prompts = spark.sql("select 1 a, 'single' s union all select 2, 'final' order by a").select(T.prompts(F.lit("base"), "a", "s", "again", "whole")).collect()
    assert [p[0] for p in prompts] == ["base", "base\nagain\nwhole"]
