"""Importance resampling against a plain version, for one word and for runs of words."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loamwork.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    def cells(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in cells(text)[1]:
                side[b] += 1
    all_s, all_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n, found = cells(text)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fits = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    top = fits[: percent * len(fits) // 100]
    return rows, [(r[0], r[3], i + 1) for i, r in enumerate(top)]


def corpus():
    rng = random.Random(3)
    vocabulary = ["Apple", "été", "x1y", "z", "数据", "_under_", "word-part", "don't", "7", "LONG" * 40, "\x00", "ÀB"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 19, 20, 21, 60, 300])))) for i in range(240)]
    docs += [(300, None), (301, ""), (None, " ".join(vocabulary * 2)), (5, docs[5][1]), (5, docs[5][1]), (302, "a" * 300_000 + " b" * 60_000), (303, "!? 12 \n")]
    return docs, [" ".join(rng.choices(vocabulary[:30], k=40)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 500)])
def test_against_a_plain_version(spark, docs_of, longest, buckets):
    docs, target = corpus()
    given = docs_of(docs).repartition(5)
    for name in ("ids", "words", "upto", "bucket", "rank", "weight", "_salt", "_nth"):
        given = given.withColumn(name, F.lit("clash"))
    out = importance.resampled(given, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets).collect()
    rows, top = plain(docs, target, longest, buckets)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in out), key=key) == sorted((r[:4] for r in rows), key=key)
    assert sorted(((r.doc_id, r.score, r.rank) for r in out if r.rank), key=lambda r: r[2]) == top and len(top) > 10


def test_empty_sides(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert importance.resampled(docs_of([]), none).count() == 0
    out = importance.resampled(docs_of([(1, "one two"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_features) for r in out) == [(1, 2), (2, 0)] and all(r["rank"] is None for r in out)


def test_blocks_hold_the_counts(spark, docs_of):
    """The stored matrix is the operator's own output: entries ascend within a document and add up to its words."""
    docs, _ = corpus()
    blocks = importance.count_matrix(docs_of(docs), buckets=50).collect()
    seen = 0
    for b in blocks:
        upto = [0, *b.upto]
        for i, n in enumerate(b.words):
            part = slice(upto[i], upto[i + 1])
            assert b.columns[part] == sorted(set(b.columns[part])) and sum(b.counts[part]) == n
        seen += len(b.ids)
    assert seen == len(docs)


def test_a_block_is_no_larger_than_a_document(spark, docs_of):
    """Readers hold thousands of rows together, so that blocks of a megabyte of text each filled an executor."""
    rows = importance.count_matrix(docs_of([(i, f"word{i} and word{i + 1}" if i % 7 else None) for i in range(200)]), buckets=500).collect()
    assert sorted(r.ids[0] for r in rows) == list(range(200)) and {len(r.ids) for r in rows} == {1}
    assert max(len(r.columns) for r in rows) == 3
