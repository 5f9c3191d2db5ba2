"""Operator 12 against a plain counter, at borders of tries, runs and partitions."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sessionlore.llm import collocations as op

DOCS = "doc_id long, text string, lang string, phrase string, n long"


def plain(docs, least, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(2 * b >= a for (l2, x), b in f.items() if l2 == lang and len(x) == 3 and b >= least and w in (x[:2], x[1:])):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    words = ["The", "the", "old", "inn", "at", "a", "b", "ä", "Ä", "x y", "日本", "naïve", "o'clock", "1"]
    made = [("".join(rng.choices(words, [9, 9, 6, 6, 4, 3, 3, 1, 1, 1, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!\r"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(120)]
    return made + [(None, "en"), ("", "fr"), (" .,\n", "fr"), ("same same same same " * 30, "en"), ("word " * 3000, "de")] + [("the very same row, the very same row", "en")] * 15


def test_equals_the_plain_one(spark, docs):
    table = spark.createDataFrame([(i, t, lang, "clash", i) for i, (t, lang) in enumerate(docs)], DOCS).repartition(4)
    want = plain(docs, 10, 2000)
    assert rows_of(op.collocations(table)) == want and len(want) > 50
    assert rows_of(op.collocations(table, top=3)) == plain(docs, 10, 3)


@pytest.mark.parametrize("options", [{"burst": 4, "limit": 64, "partition_bytes": 2000}, {"burst": 1, "limit": 1}, {"partition_bytes": 100}])
def test_small_containers_runs_and_partitions(spark, docs, options):
    table = spark.createDataFrame([(i, t, lang, "clash", i) for i, (t, lang) in enumerate(docs)], DOCS).repartition(3)
    assert rows_of(op.collocations(table, least=3, top=40, **options)) == plain(docs, 3, 40)


def test_exact_beyond_64_bits():
    rng = np.random.default_rng(2)
    node = op.Node(0, 8)
    want = Counter()
    for _ in range(40):
        keys, counts = op.counted(rng.integers(1, 5, 50) << 42 | rng.integers(0, 5, 50) << 21 | rng.integers(0, 60, 50))
        node.add(keys, counts * 10**11)
        want.update(dict(zip(keys.tolist(), (counts * 10**11).tolist(), strict=True)))
    got = Counter()
    depths = set()

    def walk(child):
        if isinstance(child, op.Node):
            depths.add(child.depth)
            assert (np.diff(child.bounds.astype(float)) > 0).all()
            for c in child.children:
                walk(c)
        else:
            child.settle()
            got.update(dict(zip(child.keys.tolist(), child.counts.tolist(), strict=True)))

    walk(node)
    assert got == want and depths == {0, 1, 2}


def test_scores_are_exact(spark):
    """A billion of one phrase: the square times a million passes 64 bits."""
    import unittest.mock

    big = spark.createDataFrame([("en", "a b", 2, 2_999_999_999), ("en", "a", 1, 4_000_000_001), ("en", "b", 1, 3_000_000_007), ("en", None, 0, 9_000_000_000)], op.TOTALS)
    with unittest.mock.patch.object(op, "phrase_counts", lambda *a: big):
        row = op.collocations(big).first()
    assert row["score"] == 1_000_000 * 2_999_999_999**2 // (4_000_000_001 * 3_000_000_007) and row["n"] == 9_000_000_000


def test_empty_tables(spark):
    assert op.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert op.collocations(spark.createDataFrame([(1, None, None, "", 1)], DOCS)).collect() == []


def test_words_of_a_batch():
    words, joined = op.phrase_words(pa.array(["A b.c", None, "", " d  e\tf\x0bg"]))
    assert [words.text(i) for i in range(len(words))] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"] and joined.tolist() == [True, False, False, True, True, False, False]
