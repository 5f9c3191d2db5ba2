"""Nearest notes of questions, and the contexts made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.functions.text import NO_NOTES_ANSWER, titled
from sessionlore.functions.vectors import cosine, norm, wide

# Fixed value: notes per question.
DEPTH = 8
#: Vectors of questions are broadcast up to this many bytes, and beyond that
#: meet the notes in groups of a bounded size.
BROADCAST_BYTES = 64 << 20
#: Notes and questions of one group of :func:`top_notes_batch`, about.
GROUP_NOTES, GROUP_QUESTIONS = 20_000, 4096


def with_vectors(notes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Notes that have a vector."""
    return notes.join(embeddings.select(F.col("note_id").alias("id"), "embedding"), "id")


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.col("score").desc(), "note_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _small(questions: DataFrame) -> bool:
    row = questions.agg(F.sum(F.size("embedding")).alias("n")).first()
    return 8 * int(row["n"] or 0) <= BROADCAST_BYTES


def top_notes(questions: DataFrame, notes: DataFrame, k: int = DEPTH, digits: int | None = None) -> DataFrame:
    """(question_id, note_id, score, rank): the ``k`` notes (guild_id, id,
    embedding) of each question's guild with the highest cosine; ties by note
    id. Expressions only, norms once a row; every task keeps its best ``k`` per
    question before the shuffle. Where the questions are too many to be
    broadcast, a guild's notes and questions are dealt to groups, as in
    :func:`top_notes_batch`. ``digits`` rounds the score first."""
    asked = questions.select("question_id", "guild_id", wide(F.col("embedding")).alias("_q"), norm(F.col("embedding")).alias("_nq"))
    rows = notes.select("guild_id", "id", wide(F.col("embedding")).alias("_v"), norm(F.col("embedding")).alias("_nv"))
    key = ["guild_id"]
    if _small(questions):
        asked = F.broadcast(asked)
    else:
        rows, asked = _grouped(rows, asked)
        key = ["guild_id", "block", "salt"]
    score = cosine(F.col("_q"), F.col("_v"), (F.col("_nq"), F.col("_nv")))
    score = F.round(score, digits) if digits is not None else score
    return _best(rows.join(asked, key).select("question_id", F.col("id").alias("note_id"), score.alias("score")), k)


def _filled(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of ``width``, zeros behind the shorter ones."""
    lengths = vectors.str.len().to_numpy(np.int64)
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < lengths[:, None]] = np.concatenate([np.asarray(x, float) for x in vectors]) if len(vectors) else 0
    return out


def _grouped(notes: DataFrame, questions: DataFrame, group_notes: int = GROUP_NOTES, group_questions: int = GROUP_QUESTIONS) -> tuple[DataFrame, DataFrame]:
    """Notes and questions with (block, salt): a guild's questions are dealt to
    blocks and its notes to salts, and each block meets each salt once. Only
    guilds of more than one block or salt are listed, so few that the list is
    broadcast: at most one for each ``group_notes`` notes or ``group_questions``
    questions."""

    def large(rows: DataFrame, size: int, name: str) -> DataFrame:
        counts = rows.groupBy("guild_id").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
        return F.broadcast(counts.where(F.col(name) > 1))

    n_salts, n_blocks = large(notes, group_notes, "_salts"), large(questions, group_questions, "_blocks")

    def dealt(rows: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        met = rows.join(n_salts, "guild_id", "left").join(n_blocks, "guild_id", "left")
        part = F.pmod(F.xxhash64(key), F.coalesce(n_own, F.lit(1).cast("long")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n_other, F.lit(1).cast("long")) - 1))
        return met.withColumn(own, part).withColumn(other, every).drop("_salts", "_blocks")

    return dealt(notes, "id", "salt", "_salts", "block", "_blocks"), dealt(questions, "question_id", "block", "_blocks", "salt", "_salts")


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as in Spark."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5), x) / 10.0**digits


def top_notes_batch(questions: DataFrame, notes: DataFrame, k: int = DEPTH, group_notes: int = GROUP_NOTES, group_questions: int = GROUP_QUESTIONS, digits: int | None = None) -> DataFrame:
    """As :func:`top_notes` for many questions: a matrix product for each group of a
    guild's notes and questions. Shorter vectors are filled up with zeros; one that is
    null or holds a null has no likeness to any. ``digits`` rounds the score before
    the best are taken, so that what is equal then goes by note id."""

    def whole(v: Column) -> Column:
        return F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(wide(v))

    asked = questions.select("guild_id", "question_id", whole(F.col("embedding")).alias("q"))
    left, right = _grouped(notes.select("guild_id", "id", whole(F.col("embedding")).alias("v")), asked, group_notes, group_questions)
    left = left.withColumnRenamed("id", "note_id")

    def best(rows: Iterator[pd.DataFrame] | pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"question_id": [], "note_id": [], "score": []}).astype({"question_id": "int64", "note_id": "int64"})
        if not len(rows) or not len(questions):
            return out
        width = int(max(rows["v"].str.len().max(), questions["q"].str.len().max()))
        ids, v, q = rows["note_id"].to_numpy(), _filled(rows["v"], width), _filled(questions["q"], width)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
        score = np.divide(q @ v.T, norms, out=np.zeros(norms.shape), where=norms != 0)
        score = score if digits is None else _rounded(score, digits)
        # What is no number comes first, as in Spark's order.
        at = np.argsort(-np.where(np.isnan(score), np.inf, score), axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"question_id": np.repeat(questions["question_id"].to_numpy(), at.shape[1]), "note_id": ids[at].reshape(-1), "score": np.take_along_axis(score, at, 1).reshape(-1)})

    key = ["guild_id", "block", "salt"]
    return _best(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(best, "question_id long, note_id long, score double"), k)


def contexts(questions: DataFrame, notes: DataFrame, k: int = DEPTH, digits: int | None = None) -> DataFrame:
    """(question_id, context): the best notes in order of rank, or the text that
    there are none. Vectors stay out of the shuffle that joins the texts."""
    best = top_notes(questions, notes, k, digits).join(notes.select(F.col("id").alias("note_id"), titled("note_type", "title", "content").alias("text")), "note_id")
    joined = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("xs"))
    text = F.coalesce(F.array_join(F.col("xs.text"), "\n\n"), F.lit(NO_NOTES_ANSWER))
    return questions.select("question_id").join(joined, "question_id", "left").select("question_id", text.alias("context"))
