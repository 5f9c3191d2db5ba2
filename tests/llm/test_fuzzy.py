"""Operator 13: chunks, fingerprints and likenesses against plain loops; edits."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sessionlore.llm import fuzzy


def plain_fingerprint(text):
    data = (text or "").encode()
    if not data:
        return "0::"
    full = [int(x) + 1 for x in fuzzy.rolling(np.frombuffer(data, np.uint8), np.array([0, len(data)]))]
    # The rolling hash of a byte depends on the last WINDOW bytes only.
    for i in random.Random(1).sample(range(len(data)), min(5, len(data))):
        part = data[max(0, i - fuzzy.WINDOW + 1) : i + 1]
        assert int(fuzzy.rolling(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[-1]) + 1 == full[i]
    cuts = lambda k: [i + 1 for i, v in enumerate(full) if v < 1 << 32 and v % (3 << k) == 0]
    k = 0
    while 3 * fuzzy.SPREAD << k < len(data):
        k += 1
    while k and len(cuts(k)) + 1 < fuzzy.LEAST:
        k -= 1

    def letters(k):
        ends = [*cuts(k)[: fuzzy.SPREAD - 1], len(data)]
        begins = [0, *ends[:-1]]
        from sessionlore.llm.textvec import ranges_hash

        raw = np.frombuffer(data, np.uint8)
        return "".join(chr(fuzzy.LETTERS[int(ranges_hash(raw, np.array([b]), np.array([e]))[0]) & 63]) for b, e in zip(begins, ends) if e > b)

    return f"{k}:{letters(k)}:{letters(k + 1)}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[j - 1]))
        row = new
    return row[-1]


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (k, *a), (m, *b) = x.split(":"), y.split(":")
    best = 0.0
    for p, q in [(a[i], b[j]) for i in (0, 1) for j in (0, 1) if int(k) + i == int(m) + j]:
        if any(p[i : i + fuzzy.RUN] in q for i in range(len(p) - fuzzy.RUN + 1)):
            best = max(best, 1 - distance(p, q) / (len(p) + len(q)))
    return best


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:80]
    near = [t[: len(t) // 3] + "an edit " + t[len(t) // 3 :] for t in some[:30]]
    odd = [None, "", "a", "é", "ab", "same line\n" * 400, "x" * 20_000, "日本語" * 50, "".join(rng.choices("abc ", k=7)), " "]
    return some + near + odd + ["twice the same row, rather long to be cut into chunks"] * 3


def test_fingerprints_are_the_plain_ones(texts):
    got = fuzzy.as_texts(fuzzy.fingerprints(pa.array(texts)))
    assert got == [plain_fingerprint(t) for t in texts]
    assert fuzzy.as_texts(fuzzy.parsed(got)) == got


def test_likeness_is_the_plain_one(texts):
    prints = fuzzy.fingerprints(pa.array(texts))
    names = fuzzy.as_texts(prints)
    left, right = np.repeat(np.arange(len(texts)), 12), np.tile([0, 1, 2, 30, 80, 81, 82, 83, 110, 111, 112, 113], len(texts))
    got = fuzzy.likeness(prints[left], prints[right])
    assert got.tolist() == pytest.approx([plain_likeness(names[i], names[j]) for i, j in zip(left, right)])
    # An edit in the middle leaves documents alike, and others are not.
    long = [i for i in range(30) if len(texts[i]) > 300]
    assert np.median(fuzzy.likeness(prints[long], prints[[80 + i for i in long]])) > 0.7
    assert np.mean(fuzzy.likeness(prints[long], prints[[i + 1 for i in long]]) > 0.3) < 0.2


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, other, following = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, following)))
    return out


def rounded(rows):
    return sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in rows)


@pytest.mark.parametrize("partition_bytes", [500, 20_000, 1 << 30])
def test_compared_with_next(spark, texts, partition_bytes):
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fingerprint string, part long").repartition(5)
    got = fuzzy.compared_with_next(docs, partition_bytes).collect()
    assert rounded(map(tuple, got)) == rounded(plain(rows))


def test_repeated_rows_and_null_ids(spark):
    same = [(7, "a rather long text that is the same in every row of these")] * 200
    got = fuzzy.compared_with_next(spark.createDataFrame(same, "doc_id long, text string"), 1000).collect()
    assert len(got) == 200 and all(r["near_next"] == 1.0 for r in got)
    rows = [(None, "only null"), (3, None), (1, "first text of all")]
    got = fuzzy.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert rounded(map(tuple, got)) == rounded(plain(rows))
    one = fuzzy.compared_with_next(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()
    assert [(r["near_next"], r["near_edited"] > 0) for r in one] == [(1.0, True)]
    assert fuzzy.compared_with_next(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_equal_rows(spark):
    rows = spark.range(100_000).selectExpr("cast(null as bigint) AS doc_id", "'equal' AS text")
    found = fuzzy.compared_with_next(rows, 50_000)
    assert found.where("doc_id is null and near_next = 1").count() == 100_000
