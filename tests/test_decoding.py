"""Viterbi decoding against all tag sequences; long records take linear time."""

import itertools
import random
import time

import numpy as np

from loamwork.operators import decoding

TAGS = ("O", "B", "I")
CHAIN = decoding.Chain(TAGS, {"I": -50, "B": 0.25}, {("O", "I"): -50, ("B", "I"): 0.5, ("I", "I"): 0.25, ("O", "O"): 0.125}, {"B": -0.5})


def plain(emissions):
    if not emissions:
        return [], None
    best = None
    for seq in itertools.product(range(3), repeat=len(emissions)):
        score = CHAIN.start[seq[0]] + CHAIN.end[seq[-1]] + sum(e[t] for e, t in zip(emissions, seq, strict=True)) + sum(CHAIN.step[a, b] for a, b in itertools.pairwise(seq))
        rank = (-score, seq[::-1])
        if best is None or rank < best[0]:
            best = (rank, seq, score)
    return [TAGS[t] for t in best[1]], best[2]


def test_best_tags_against_all_sequences(spark, monkeypatch):
    rng = random.Random(2)
    score = lambda: rng.randrange(-8, 9) / 4  # noqa: E731 - quarters add up without rounding, and tie
    rows = [(i, [[score() for _ in TAGS] for _ in range(rng.randrange(7))]) for i in range(80)] + [(None, [[1.0, 0.0, 0.0]]), (7, None), (7, [])]
    for block in (1 << 18, 9):
        monkeypatch.setattr(decoding, "BLOCK", block)
        got = decoding.best_tags(spark.createDataFrame(rows, "id long, emissions array<array<double>>").repartition(3), CHAIN, "id").collect()
        key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)
        assert sorted(((r.id, list(r.tags), r.score) for r in got), key=key) == sorted(((i, *plain(e or [])) for i, e in rows), key=key)


def test_missing_scores_count_as_zero(spark):
    rows = [(1, [[None, 1.0], [2.0], None])]
    (out,) = decoding.best_tags(spark.createDataFrame(rows, "id long, emissions array<array<double>>"), CHAIN, "id").collect()
    assert (list(out.tags), out.score) == plain([[0.0, 1.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def test_long_records_are_linear():
    random = np.random.default_rng(1)
    took = []
    for n in (20_000, 200_000):
        began = time.time()
        tags, score = decoding.decoded(CHAIN, random.normal(size=(n, 3)), np.array([n]))
        took.append(time.time() - began)
        assert len(tags) == n and np.isfinite(score[0])
    assert took[1] < 40 * took[0]
