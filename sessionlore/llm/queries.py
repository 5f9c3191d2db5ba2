"""The queries opN_<name> over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.llm import alignment, attention, collocations, fuzzy, jaccard, kneser_ney, langid, oracles, packing, pieces, quotes, rules, tokens, topk
from sessionlore.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), digest=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.is_held_out()))
    return langid.predict(docs, model).select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op8_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.scored(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"))


def op10_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats as mail that quotes, its links, and the conversations without quotes."""
    mail = quotes.quoting(table(spark, sf_dir, "conversations"))
    return quotes.conversations(quotes.linked_conversations(mail))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_fuzzy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.compared_with_next(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of operator 13 alone, which SQL can express."""
    return fuzzy.compared_with_next(table(spark, sf_dir, "documents"), with_prints=False).select("doc_id", "n_chars", "edited_sha256")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of operator 4 alone, which SQL can express."""
    rows = rules.statistics(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rules.base_failed(F.col("n_words"), F.col("n_repeat_words")).alias("base_failed"))


def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base score of operator 8 alone, which SQL can express."""
    rows = attention.scored(table(spark, sf_dir, "documents"), with_model=False)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return numbered | {"rule_counts": rule_counts, "word_scores": word_scores, "edited_texts": edited_texts}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
