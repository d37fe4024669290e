"""The best donor against a search over all pairs, with several blocks, tiers, ties, nulls and odd texts."""

import math
import random

import pytest

from loamwork.operators import donors

TIERS = (("relation", "kind"), ("relation",), ())


def pairs(text):
    t = "".join((text or "").split())
    return {t[i : i + 2] for i in range(len(t) - 1)} if len(t) > 1 else {t} - {""}


def plain(items, others):
    out = {}
    for i in items:
        for tier, on in enumerate(((1, 2), (1,), ()), 1):
            fits = [d for d in others if d[0] != i[0] and all(d[k] == i[k] for k in on)]
            if not fits:
                continue
            best = None
            for d in sorted(fits):
                a, b, text, target = pairs(i[3]), pairs(d[3]), d[3] or "", max(1, len(i[3] or ""))
                score = len(a & b) / len(a | b) if a | b else 0.0
                score += 0.2 * math.exp(-abs(len(text) - target) / target)
                score += 0.15 * any(e is not None and e in text for e in i[4:])
                if best is None or round(score, 12) > best[1]:
                    best = (d[0], round(score, 12))
            out[i[0]] = (best[0], tier, best[1])
            break
    return out


def rows(seed, n, start, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.choice([2, 4, 7]))) for _ in range(40)]
    out = []
    for i in range(n):
        text = rng.choice([None, "", "x", " "] + [" ".join(rng.choices(words, k=rng.choice([1, 3, 10, 40])))] * 12)
        out.append((start + i, rng.choice(["r1", "r1", "r1", "r2", None]), rng.choice(["k1", "k2", "k3"]), text, rng.choice([None, "", *words]), rng.choice([None, *words])))
    return out


@pytest.mark.parametrize(("seed", "alphabet", "block"), [(1, "abcdefghij", 16), (2, "数据分析é😀ab", 16), (3, "ab", 128)])
def test_best_donor_against_all_pairs(spark, monkeypatch, seed, alphabet, block):
    monkeypatch.setattr(donors, "BLOCK", block)
    monkeypatch.setattr(donors, "ITEMS_A_TASK", 40)
    items, others = rows(seed, 120, 0, alphabet), rows(seed, 200, 60, alphabet)  # ids 60 to 119 are on both sides
    items += [(900, "only", "here", "abab cdcd", "ab", None), (901, "r2", "none", "abcdabcd", None, None)]
    schema = "item_id long, relation string, kind string, text string, head_text string, tail_text string"
    got = donors.best_donor(spark.createDataFrame(items, schema).repartition(3), spark.createDataFrame(others, schema).repartition(3), TIERS)
    want = plain(items, others)
    found = {r.item_id: (r.donor, r.tier, r.score) for r in got.collect()}
    assert found.keys() == want.keys() and {t for _, t, _ in want.values()} == {1, 2, 3}
    for i, (donor, tier, score) in want.items():
        assert found[i][:2] == (donor, tier) and abs(found[i][2] - score) < 1e-9, i


def test_an_item_alone_has_no_donor(spark):
    schema = "item_id long, relation string, kind string, text string, head_text string, tail_text string"
    one = spark.createDataFrame([(1, "r", "k", "text", "a", "b")], schema)
    assert donors.best_donor(one, one, TIERS).count() == 0 and donors.best_donor(one.limit(0), one, TIERS).count() == 0 and donors.best_donor(one, one.limit(0), TIERS).count() == 0


def test_pairs_leave_python_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    class Rows:
        schema = spark.range(1).selectExpr("'k' AS tkey", "0L AS block", "binary('') AS pairs").schema

        def select(self, *names):
            return self

        def mapInArrow(self, spread, schema):  # noqa: N802
            batch = pa.record_batch([pa.array(["k"] * 1000), pa.array(range(1000)), pa.array([donors.pair_codes("abcd").tobytes()] * 1000, pa.binary())], names=["tkey", "block", "pairs"])
            return list(spread(iter([batch])))

    out = donors._exploded(Rows(), "tkey", "block")
    assert sum(b.num_rows for b in out) == 3000 and max(b.num_rows for b in out) <= 3 * donors.ROWS_AT_ONCE
    assert [x for b in out for x in b.column("block").to_pylist()][::3] == list(range(1000))


@pytest.mark.parametrize("alphabet", ["abcdefghij", "数据分析é😀ab"])
def test_tiles_compare_whole_blocks(monkeypatch, alphabet):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(donors, "PIECE", 7)
    monkeypatch.setattr(donors, "WIDTH", 11)
    monkeypatch.setattr(donors, "DENSE", 9)  # most pairs of characters go through the index
    items, others = ([(*r[:1], "r", "k", *r[3:]) for r in rows(seed, 90, start, alphabet)] for seed, start in ((5, 0), (6, 50)))
    said = lambda r: r[3] or ""
    ends = {e for r in items for e in r[4:] if e}
    slim = lambda t: {"id": [r[0] for r in t], "length": [len(said(r)) for r in t], "pairs": [donors.pair_codes("".join(said(r).split())).tobytes() for r in t], "n": [len(pairs(r[3])) for r in t]}
    theirs = pa.table(slim(others) | {"held": donors.ends_held([said(r) for r in others], sorted(ends))})
    mine = lambda got: pa.table(slim(items) | {"ends": [list(r[4:]) for r in items], "got": got})
    want = {i: (d, s) for i, (d, _, s) in plain(items, others).items()}
    place, chosen, scores = donors.tile_best(mine([0.0] * 90), theirs)
    assert len(want) == 90 and {items[p][0]: (d, s) for p, d, s in zip(place, chosen, scores, strict=True)} == want
    # a score that is reached elsewhere is only met by its equals
    got = [want[r[0]][1] + (1e-6 if k % 3 == 0 else 0.0) for k, r in enumerate(items)]
    place, chosen, _ = donors.tile_best(mine(got), theirs)
    assert {items[p][0]: d for p, d in zip(place, chosen, strict=True)} == {r[0]: want[r[0]][0] for k, r in enumerate(items) if k % 3}
    assert len(donors.tile_best(mine(np.zeros(90)), theirs.slice(0, 0))[0]) == 0


def test_ends_are_looked_up_alike_whatever_their_number():
    texts, few = ["abcabd", "", "xyz", "aab"], ["ab", "abd", "z", "q"]
    many = few + [f"{k:02d}" for k in range(60)] + [f"{k:03d}" for k in range(60)]
    want = [sorted(e for e in few if e in t) for t in texts]
    assert [sorted(h) for h in donors.ends_held(texts, few)] == want == [sorted(h) for h in donors.ends_held(texts, many)]


def test_no_row_an_item_and_pair_is_made(spark, monkeypatch):
    names = []
    keep = donors.staged
    monkeypatch.setattr(donors, "staged", lambda df, name: names.append(name) or keep(df, name))
    schema = "item_id long, relation string, kind string, text string, head_text string, tail_text string"
    items, others = rows(9, 40, 0, "abcdef"), rows(10, 60, 40, "abcdef")
    found = {r.item_id: r.donor for r in donors.best_donor(spark.createDataFrame(items, schema), spark.createDataFrame(others, schema), TIERS).collect()}
    assert found == {i: d for i, (d, _, _) in plain(items, others).items()}
    assert not {"donor-index", "donor-order", "donor-wanted"} & set(names) and "donor-tiles" in names
