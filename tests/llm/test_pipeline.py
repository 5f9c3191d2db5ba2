"""The pipeline on the smallest tables and on hand-made ones."""

import corpus_pipeline
from sessionlore.llm import jaccard, langid, tokens
from sessionlore.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == COLUMNS
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} <= before
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    labels = {r["doc_id"]: r for r in table(spark, sf_dir, "labels").collect()}
    good = [d for d in labels if labels[d]["quality"] == 1 and labels[d]["toxic"] == 0]
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.classes(docs).collect()}
    assert sum(classes[d] in ids or d in ids for d in good) > 0.97 * len(good)
    assert all(r["component_id"] == r["doc_id"] for r in jaccard.classes(kept).collect())
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    n = {r["doc_id"]: r["n_tokens"] + 1 for r in tokens.tokenized(kept).collect()}
    found = {}
    for r in pieces:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == n


def test_quality_stage_rejects_junk(spark):
    """Held-out thresholds need more than the 200 documents of the smallest tables."""
    folder = "/root/testdata/sf0.01"
    docs = table(spark, folder, "documents")
    left = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, folder).select("doc_id").collect()}
    labels = table(spark, folder, "labels").collect()
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    assert len(bad) > 50 and sum(d in left for d in bad) < 0.2 * len(bad)
    assert sum(d in left for d in good) > 0.97 * len(good)


def test_language_stage(spark, sf_dir):
    rows = [(i, ("the thing and with " if i % 2 else "der und schön größe ") * 9, "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(100, "der und schön größe " * 9, "en", "s", 1), (101, "12 34", "en", "s", 1), (102, None, "en", "s", 1), (103, "the thing", None, "s", 1), (None, "the", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert left == {*range(40), 103, None}
    assert corpus_pipeline.language(spark, docs.limit(0), sf_dir).count() == 0
    assert langid.UNDETERMINED == "und"


def test_quality_and_packing_stages(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = table(spark, sf_dir, "documents").where("doc_id < 40")
    rows = [(None, "no id", "en", "s", 1), (90001, None, "en", "s", 1), (90002, "", None, "s", 1), (90003, "%$#@! 7#Q" * 40, "en", "s", 1)]
    docs = kept.unionByName(kept.limit(1)).unionByName(spark.createDataFrame(rows, schema))
    left = corpus_pipeline.quality(spark, docs, sf_dir)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == COLUMNS and None in ids and not {90001, 90002, 90003} & set(ids)
    assert corpus_pipeline.quality(spark, docs.limit(0), sf_dir).count() == 0
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] + 1 for r in tokens.tokenized(docs).collect())
    assert corpus_pipeline.packed(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicates_stage(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "en", "s", 1), (3, text + " more", "en", "s", 1), (9, "other", "en", "s", 1), (10, "", "en", "s", 1), (11, "", "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == {3, 9, 10, 11, None}


def test_repeated_rows_stay_once(spark, sf_dir):
    text = "some words of a text that is rather long " * 3
    rows = [(1, text, "en", "s", 1)] * 50 + [(2, text, "en", "s", 1)] * 5 + [(None, text, "en", "s", 1)] * 3 + [(7, "quite another text of seven words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert left == ["1", "7", "None", "None", "None"]
