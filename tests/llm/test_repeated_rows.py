"""Repeated rows and null keys in the operators that once gathered them."""

from unittest import mock

from pyspark.sql import functions as F

from sessionlore.llm import jaccard, quotes, tokens


def test_repeated_rows_are_one_set(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 300 + [(2, text + " more")] * 300 + [(5, text)] * 20 + [(9, "another text of some words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    whole = jaccard.index_lists
    with mock.patch.object(jaccard, "index_lists", lambda sets: seen.append(sets.count()) or whole(sets)):
        got = jaccard.classes(docs).groupBy("doc_id", "component_id", "n_shingles").count().collect()
    assert seen == [3]
    assert sorted(map(tuple, got)) == [(1, 1, 56, 300), (2, 1, 57, 300), (5, 1, 56, 20), (9, 9, 2, 1)]


def test_many_rows_of_one_id_are_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"text number {i % 50}") for i in range(2000)], "doc_id long, text string").repartition(3)
    with mock.patch.object(tokens, "FILE_BYTES", 5_000):
        tokens.write_files(docs, str(tmp_path))
    shards = spark.read.parquet(f"{tmp_path}/blocks").groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(shards) > 3 and max(r["n"] for r in shards) < 1000 and sum(r["n"] for r in shards) == 2000
    back = tokens.read_files(spark, str(tmp_path), digest=True).collect()
    assert len(back) == 2000
    ends = sorted((r["start"], r["n_tokens"]) for r in back)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0


def test_null_keys_meet_nothing(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "> hello there\n\nyes"), *[(None, k % 3 or None, "user", f"> hello there\n\ntext {k}") for k in range(3000)], (1, None, "user", "lost")]
    got = quotes.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.count() == len(rows)
    assert got.where("conv_id is null and (place is not null or n_quotes != 0 or depth != 0 or not (root_turn <=> turn))").count() == 0
    assert [r["parent_turn"] for r in got.where("conv_id = 1 and turn = 1").collect()] == [0]


def test_begin_mark_is_in_no_text():
    import pyarrow as pa

    from sessionlore.llm import kneser_ney

    texts = ["abc", "\x02abc", "\U00010000abc", "퟿abc", "x\U00010000\U000103ffy"]
    gram, n = kneser_ney.grams(pa.array(texts))
    ends = n.cumsum()
    begins = [{int(g) for g in gram[e - k : e - k + 3]} for e, k in zip(ends, n, strict=True)]
    later = {int(g) for e, k in zip(ends, n, strict=True) for g in gram[e - k + 3 : e]}
    assert not set.union(*begins) & later and not begins[0] & begins[1]


def test_vectors_that_are_too_long_take_no_part(spark):
    from sessionlore.llm import topk

    rows = [(0, [1.0, 2.0]), (50, [1e307, 1.0]), (7, [float("inf"), 0.0]), (8, [2.0, 0.5]), (9, None)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 8, 512 * 256 + 128 * 512)]
