"""Several shards, partitions and blocks, and joins in place of broadcasts, give what one gives."""

import zlib
from functools import partial
from unittest import mock

import numpy as np
import pytest

from sessionlore.llm import attention, jaccard, kneser_ney, packing, tokens
from sessionlore.llm.subwords import Subwords, default_path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(("shard_ids", "partition_bytes"), [(3_000, 1 << 30), (50_000, 120_000), (1, 30_000)])
def test_packing_over_shards_and_partitions(docs, shard_ids, partition_bytes):
    found = packing.pack(docs, shard_ids=shard_ids, partition_bytes=partition_bytes).collect()
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    coder = Subwords.of(default_path())
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(whole)
    for doc, parts in list(pieces.items())[::7]:
        ids = [*coder.tokenizer.encode(whole[doc], add_special_tokens=False).ids, packing.END_ID]
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == packing.WINDOW or at & (at - 1) == 0
        short += at != packing.WINDOW
    partitions = len({s >> 32 for s in sequences})
    assert (partitions > 1) == (partition_bytes < 1 << 20) and short <= 12 * partitions


def test_jaccard_by_joins(docs):
    with mock.patch.object(jaccard, "BROADCAST_IDS", 1):
        by_joins = rows(jaccard.classes(docs))
    assert by_joins == rows(jaccard.classes(docs))


def test_perplexity_by_blocks(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    close = lambda df: {r["doc_id"]: (r["kept"], round(r["log_perplexity"] or 0, 6)) for r in df.collect()}
    whole = close(kneser_ney.judged(docs, labels))
    with mock.patch.object(kneser_ney, "scored", partial(kneser_ney.scored, limit=0)), mock.patch.object(kneser_ney, "BLOCK_BYTES", 60_000), mock.patch.object(kneser_ney, "BROADCAST_IDS", 0):
        assert close(kneser_ney.judged(docs, labels)) == whole


def test_word_scores_by_blocks(docs):
    close = lambda df: {r["doc_id"]: (r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()}
    whole = close(attention.scored(docs, with_model=False))
    with mock.patch.object(attention, "BLOCK_BYTES", 20_000), mock.patch.object(attention, "HEAD_WORDS", 50):
        assert close(attention.scored(docs, with_model=False)) == whole


def test_more_parts_learn_all_windows(docs):
    coded = attention.coded(docs.select("doc_id", "text", attention.is_training().alias("training")), default_path())
    train = coded.where("training").repartition(6)
    weights, vocabulary = attention.fit(train, Subwords.of(default_path()).size, part_windows=500)
    assert attention.rounds_of(1) == 2 and attention.rounds_of(6) == 8 and attention.rounds_of(10**6) == 8
    assert all(np.isfinite(x).all() for x in weights.values())


def test_files_of_several_blocks(docs, tmp_path):
    with mock.patch.object(tokens, "FILE_BYTES", 100_000):
        tokens.write_files(docs, str(tmp_path))
    spark = docs.sparkSession
    assert spark.read.parquet(f"{tmp_path}/blocks").select("shard").distinct().count() > 2
    assert rows(tokens.read_files(spark, str(tmp_path), digest=True)) == rows(tokens.token_files(docs, digest=True))
