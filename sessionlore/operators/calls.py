"""Model calls in rounds, with a ledger of replies.

A call is tried again only after an attempt that was refused, with the wording for
another attempt. Every reply, or error, is kept in the ledger under a digest of
stage, chunk, attempt and prompt; only prompts that the ledger does not have reach
the model. So a job that was ended in the middle goes on where its ledger ends, and
equal prompts are asked once.

The ledger is a Parquet folder that rounds append to. What a crashed append has left
of its files is either a whole file of replies or nothing that readers see.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlore.functions.responses import has_content, least_chars, normalized
from sessionlore.functions.text import prompts, transcript_prompt
from sessionlore.operators.inference import with_model
from sessionlore.operators.summaries import ATTEMPTS, CALL, accepted_responses
from sessionlore.sources.versions import _fs, _path

LEDGER = "digest string, stage string, chunk_no int, attempt int, raw string, error string"


class Wording(NamedTuple):
    """The caller's instructions: for every call, what a repeated one adds, what the
    final stage adds, and optional project text."""

    instructions: str
    retry: str
    final: str
    project: str = ""

    def prompt(self, attempt: int) -> Column:
        """Instructions and transcript of a call (stage, text)."""
        told = prompts(F.lit(self.instructions), F.lit(attempt), "stage", self.retry, self.final, F.lit(self.project))
        return F.concat(told, F.lit("\n\n"), transcript_prompt("text"))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(digest, stage, chunk_no, attempt, raw, error), one row a digest."""
    if not _fs(spark, ledger).exists(_path(spark, ledger)):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(ledger)
    # Two jobs at once may have asked the same.
    return rows.groupBy("digest").agg(F.min(F.struct("stage", "chunk_no", "attempt", "raw", "error")).alias("x")).select("digest", "x.*")


def answered(
    calls: DataFrame,
    make_model: Callable,
    ledger: str,
    wording: Wording,
    persist: Callable[[DataFrame, str], DataFrame],
    attempts: int = ATTEMPTS,
    partitions: int | None = None,
    slices: int = 1,
    name: str = "calls",
) -> DataFrame:
    """(session_id, stage, chunk_no, attempt, payload, error, n_attempts) of calls
    (session_id, stage, chunk_no, text). ``persist`` stores what a round has found, under
    names that begin with ``name``;
    ``slices`` cuts a round into appends, so that a crash loses at most one of
    these. There are as many rounds as attempts, fewer if no call is open."""
    spark = calls.sparkSession
    opened, rounds = calls, []
    for attempt in range(1, attempts + 1):
        asked = opened.withColumn("attempt", F.lit(attempt)).withColumn("prompt", wording.prompt(attempt))
        asked = asked.withColumn("digest", F.sha2(F.to_json(F.struct("stage", "chunk_no", "attempt", "prompt")), 256))
        asked = persist(asked, f"{name}-asked-{attempt}")
        if asked.isEmpty():
            break
        for k in range(slices):
            part = asked.where(F.pmod(F.xxhash64("digest"), F.lit(slices)) == k).select("digest", "stage", "chunk_no", "attempt", "prompt").dropDuplicates(["digest"])
            fresh = part.join(read_ledger(spark, ledger).select("digest"), "digest", "left_anti")
            made = with_model(fresh, "prompt", make_model, "raw", partitions=partitions)
            made.select("digest", "stage", F.col("chunk_no").cast("int").alias("chunk_no"), "attempt", "raw", F.col("raw_error").alias("error")).write.mode("append").parquet(ledger)
        replies = asked.select(*CALL, "attempt", "digest").join(read_ledger(spark, ledger).select("digest", "raw", "error"), "digest")
        accepted = F.col("error").isNull() & has_content(normalized("raw"), least_chars(F.col("stage")))
        found = persist(replies.withColumn("accepted", accepted).drop("digest"), f"{name}-replies-{attempt}")
        rounds.append(found)
        opened = opened.join(found.where("not accepted").select(*CALL), CALL, "left_semi")
    if not rounds:
        rounds = [calls.select(*CALL, F.lit(1).alias("attempt"), F.lit("").alias("raw"), F.lit("").alias("error"), F.lit(False).alias("accepted")).limit(0)]
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    tried = every.groupBy(*CALL).agg(F.count(F.lit(1)).alias("n_attempts"))
    return accepted_responses(every, attempts).join(tried, CALL)
