"""Operator 11 against whole texts, one by one, in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sessionlore.llm import alignment

ODD = [
    None, "", " ", "  ", "a", " a", "  a", "a ", "a  ", "\n", "a\n", "\na", " \na", "\n\na", "a \nb", "a\n\nb", "a \n \n b", "a\r\nb;\r\n", "x▁y", "▁", "<|endoftext|> and <|endoftext|>", "<s> </s>", "don't we'll I'd've", "a b  c",
    "a　b 　 c", "日本語のテキスト 日本 語", "naïve café — “x” … ½ №", "tab\tand\x0bvt\x0cff\x1cfs", "NUL\x00x", "é ́x", "😀😀 😀👩‍👩‍👧 x", "    indented\n        more\n\ttab", "a" * 3000, "ab " * 900, "1234567 89,000.50", "  x  y", "﻿x", "\x85y z\x85",
    "if (x) {\r\n  y();\r\n}\r\n", "..." * 400 + " " * 300 + "x",
]


def plain(texts, paths):
    pair = alignment.Pair(*paths)
    rows, links = [], []
    for text in texts:
        whole = " " + (text or "")
        a = pair.a.encode(whole, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        back = b"".join(pair.bytes_b[i] for i in b)
        if text and (back != whole.encode() or int(pair.width_a[a].sum()) != len(whole.encode())):
            a, b = [], []
        end_a, end_b = np.cumsum(pair.width_a[a]).tolist(), np.cumsum(pair.width_b[b]).tolist()
        both = sorted({*end_a} & {*end_b})
        parts, found = [], Counter()
        begin = 0
        for end in both:
            x = [i for i, e in zip(a, end_a) if begin < e <= end]
            y = [i for i, e in zip(b, end_b) if begin < e <= end]
            parts.append((x, y))
            found.update((i, j) for i in x for j in y)
            begin = end
        rows.append((len(a), len(b), len(parts), sum(found.values()), hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts).encode()).hexdigest() if a else ""))
        links.append(found)
    count = Counter(p for found in links for p in found)
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [(*r[:4], sum(n for p, n in f.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in f.items()), r[4]) for r, f in zip(rows, links)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    some = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]
    alphabet = " \n\t\r 　▁aeiouxyz.,;'!?0189éß語😀 "
    drawn = ["".join(rng.choices(alphabet.replace("▁", "") if k % 4 else alphabet, k=rng.randrange(1, 200))) for k in range(150)]
    return ODD + some + drawn + ["twice the same text"] * 3


def values(rows):
    return sorted((r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows)


def test_alignment_equals_the_plain_one(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, pair long").repartition(3)
    want = plain(texts, alignment.default_paths())
    got = alignment.aligned(docs).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_small_pieces_and_blocks_give_the_same(spark, texts):
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(None, "twice the same text")] * 40, "doc_id long, text string").repartition(4)
    one = alignment.aligned(docs).collect()
    for more in ({"work": 7}, {"work": 1}, {"broadcast_pairs": 0, "block_bytes": 4000}, {"broadcast_pairs": 0, "block_bytes": 100, "work": 11}):
        assert values(alignment.aligned(docs, **more).collect()) == values(one)


def test_diagonals_deal_equal_work():
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 10_000, 3000)), np.unique(rng.integers(0, 10_000, 500))
    i, j = alignment.diagonals(a, b, 64)
    assert (np.diff(i + j) <= 65).all() and i[-1] == len(a) and j[-1] == len(b)
    for x, y in zip(i, j):
        assert not (x and y < len(b) and a[x - 1] >= b[y]) and not (y and x < len(a) and b[y - 1] >= a[x])


def test_large_groups_and_full_tables(monkeypatch):
    pair = alignment.Pair(*alignment.default_paths())
    texts = pa.array(["many small words, and 1234567 numbers " * 5, "other words"])
    want = alignment.Aligned(pair, texts)
    doc, ids, n = want.links()
    monkeypatch.setattr(alignment, "LARGE_GROUP", 0)
    monkeypatch.setattr(alignment, "TABLE_UNITS", 1)
    doc2, ids2, n2 = alignment.Aligned(pair, texts).links()
    sums = lambda d, p, k: Counter({(x, y): int(k[(d == x) & (p == y)].sum()) for x, y in zip(d.tolist(), p.tolist())})
    assert sums(doc, ids, n) == sums(doc2, ids2, n2)


def test_an_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []
