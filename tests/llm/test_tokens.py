"""Operators 3 and 6 against the tokenizers library and plain loops."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sessionlore.llm import packing, tokens
from sessionlore.llm.subwords import Subwords, default_path

TEXTS = ["", None, "it's Don't 'stop 'S x's", "a,b.'c '.d ab12 3.5%", "ΑΣ.a Σ é, é. İX", "a b c", "<|endoftext|> x",
         "’s — ,é. ñ!", "̸ < ̸", "ab\x00c\x1cd", "<|startoftext|>Ab.c<|endoftext|>d'S x<|ENDOFTEXT|>y Q", "<|endoftext|", "|>a <|endoftext|><|endoftext|>", "endoftext|> b.C", "word " * 9000, "word " * 9000, "same text", "same text"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a repeated id", "y"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_subwords_equal_the_library(reference):
    ids, n = Subwords.of(default_path()).encode(pa.array(TEXTS))
    ends = np.cumsum(n)
    for i, text in enumerate(TEXTS):
        assert ids[ends[i] - n[i] : ends[i]].tolist() == reference(text), text


def test_code_round_trip():
    rng = np.random.default_rng(5)
    n = np.array([0, 1, 3, 4, 5, 1000])
    ranks = (2 ** rng.uniform(0, 32, n.sum())).astype(np.uint32)
    control, data, groups, sizes = tokens.encoded(ranks, n)
    assert len(control) == groups.sum() and len(data) == sizes.sum()
    assert (tokens.decoded(control, data, n) == ranks).all()


def test_token_files(docs, reference):
    got = sorted(tokens.token_files(docs, digest=True).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:]) and len(ids) == len(TEXTS) + 2
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = sorted((i, len(reference(t)) + 1, crc([*reference(t), 1])) for i, t in [*enumerate(TEXTS), (3, "a repeated id")])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got[1:]) == want
    whole = {(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4"))) for r in tokens.token_files(docs).collect()}
    assert whole == {(i, (*reference(t), 1)) for i, t in [*enumerate(TEXTS), (3, "a repeated id"), (None, "no id")]}


def test_packing(docs, reference):
    rows = packing.pack(docs).collect()
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for doc_id, text in texts.items():
        want = [*reference(text), 2]
        mine = sorted(pieces[doc_id, len(want)], key=lambda r: r["start"])
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == crc(want[at : at + r["length"]])
            at += r["length"]
        assert at == len(want)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & at - 1 == 0


def test_neighbours_share_a_window(spark):
    rows = [(i, f"common words in every text and then {'alpha beta gamma' if i % 2 else 'delta epsilon zeta'} " * 60) for i in range(16)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    first = {r["doc_id"] % 2 for r in got if r["sequence_id"] & 0xFFFFFFFF == 0}
    assert len(first) == 1


def plain_order(texts, window):
    """BM25 over all terms, a loop over documents for each seed."""
    import math

    n = [len(t) for t in texts]
    mean, df = max(1.0, sum(n) / len(n)), collections.Counter(x for t in texts for x in set(t))
    idf = lambda x: math.log1p((len(texts) - df[x] + 0.5) / (df[x] + 0.5))
    w = [{x: idf(x) * c * (packing.K1 + 1) / (c + packing.K1 * (1 - packing.B + packing.B * len(t) / mean)) for x, c in collections.Counter(t).items()} for t in texts]
    left, order, room, queue = [i for i in range(len(texts)) if n[i]], [], window, []
    while left:
        queue = [i for i in queue if i in left]
        seed = not queue
        doc = (queue or left)[0]
        left.remove(doc)
        order.append(doc)
        if n[doc] + 1 >= room:
            room, seed = window - (n[doc] + 1 - room) % window, True
        else:
            room -= n[doc] + 1
        if seed:
            score = {i: sum(w[i].get(x, 0) for x in set(texts[doc])) for i in left}
            queue = sorted((i for i in left if score[i] > 0), key=lambda i: (-round(score[i], 4), i))
    return order + [i for i in range(len(texts)) if not n[i]]


@pytest.mark.parametrize("seed", range(4))
def test_retrieval_order_is_plain_bm25(seed, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 64)
    rng = np.random.default_rng(seed)
    texts = [rng.integers(0, 400, rng.integers(0, 40)).tolist() for _ in range(150)]
    n = np.array([len(t) for t in texts])
    df = np.bincount([x for t in texts for x in set(t)], minlength=400)
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    got = packing.retrieval_order(np.array([x for t in texts for x in t]), n, idf, max(1.0, n.mean()))
    assert got == plain_order(texts, 64)


def test_many_empty_and_lonely_texts_take_linear_time():
    import time

    idf = np.ones(40_000)

    def took(n):
        began = time.process_time()
        assert len(packing.retrieval_order(np.zeros(0, np.uint16), np.zeros(n, np.int64), idf, 1.0)) == n
        assert len(packing.retrieval_order(np.arange(n // 10) % 40_000, np.ones(n // 10, np.int64), idf, 1.0)) == n // 10
        return time.process_time() - began

    took(1000)
    assert took(400_000) < 12 * took(100_000) + 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none).count() == 0
    assert tokens.token_files(none).count() == 0
