"""The corpus pipeline: quality classifier, language identification, n-gram
Jaccard join, packing. Each stage takes (spark, docs, sf_dir); all but the
last return the columns of documents. A stage that rejects a doc_id rejects
all its rows; rows with a null doc_id stay.

Null and empty texts with an id go in the first stage (they have no perplexity). Of a group of
near copies the least doc_id stays, so there are no ties; of its rows with one and
the same text one stays, whichever, since further columns are not compared. Empty
tables give empty tables, and no sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.llm import jaccard, kneser_ney, langid, packing
from sessionlore.llm.common import dropped, once, stored, table, without

#: A document goes when another language than its own is this sure.
SURE = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the perplexity classifier rejects."""
    judged = kneser_ney.judged(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.where("not kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in no language, or surely in another than theirs.
    The model learns from all documents here that have a lang."""
    found = langid.predict(docs, langid.train(docs), keep=("lang",))
    other = F.coalesce((F.col("lang_pred") != F.col("lang")) & (F.col("score") >= SURE), F.lit(False))
    return without(docs, found.where((F.col("lang_pred") == langid.UNDETERMINED) | other))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the least id, once."""
    return once(without(docs, jaccard.classes(docs).where("component_id < doc_id")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", packed)]

#: SQL cannot express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
