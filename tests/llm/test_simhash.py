"""SimHash classes against brute force, and the trees' pairs on random, clustered and very dense points."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamwork.llm import simhash
from test_graph import labels_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = (text or "").translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_labels(points, most=2):
    points = sorted(set(points))
    edges = [(p, q) for i, p in enumerate(points) for q in points[i + 1 :] if (p ^ q).bit_count() <= most]
    return {p: p for p in points} | labels_of(edges)


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["Été", "ÀB", "xY"]
    docs = []
    for _ in range(150):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 30, 200]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            if len(copy) > 20 and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(rng.choice([" ", "\n", "  \t"]).join(copy))
    rows = [(i * 3, t) for i, t in enumerate(docs)] + [(5000, None), (5001, ""), (5002, " \n "), (None, docs[0]), (7, docs[0]), (7, docs[0]), (None, "only null has this"), (-4, "A" * 200_000), (9000, "no-break space stays")]
    rng.shuffle(rows)
    return rows


def test_classes_against_brute_force(docs_of):
    rows = corpus()
    docs = docs_of(rows).repartition(5)
    for name in ("fingerprint", "shard", "least", "n", "label", "component_id", "node", "a"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = simhash.simhash_classes(docs).collect()
    prints = {t: plain_fingerprint(t) for _, t in rows}
    label, least = plain_labels(prints.values()), {}
    for i, t in rows:
        if i is not None:
            least[label[prints[t]]] = min(i, least.get(label[prints[t]], i))
    want = [(i, f"{prints[t]:016x}", least.get(label[prints[t]])) for i, t in rows]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in out), key=key) == sorted(want, key=key)
    assert len({r.component_id for r in out}) < len(prints) - 20


def test_empty_table(docs_of):
    assert simhash.simhash_classes(docs_of([])).count() == 0


def flipped(rng, point, bits):
    for b in rng.sample(range(64), bits):
        point ^= 1 << b
    return point


def clustered(seed, n, spread):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        out += [flipped(rng, centre, rng.randrange(spread + 1)) for _ in range(rng.choice([1, 2, 30]))]
    return sorted(set(out))


@pytest.mark.parametrize("points", [clustered(1, 3000, 3), clustered(2, 3000, 0), [flipped(random.Random(i), 0, i % 3) for i in range(2000)]])
def test_forests_connect_what_pairs_connect(points):
    points = sorted(set(points))
    a, b = simhash.shard_forest(np.array(points, np.uint64))
    assert len(a) < len(points) and all((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))
    want = plain_labels(points)
    got = {p: p for p in points} | labels_of(list(zip(a.tolist(), b.tolist(), strict=True)))
    assert got == want


def test_every_pair_meets_in_a_shard(spark, monkeypatch):
    """The tree's shape comes from a few points; all others still meet those within two bits."""
    points = clustered(3, 4000, 2)
    tree = simhash.Tree(np.array(points[::17], np.uint64), 16)
    assert tree.shards > 8
    at, shard = tree.dealt(np.array(points, np.uint64))
    places = {}
    for i, s in zip(at.tolist(), shard.tolist(), strict=True):
        places.setdefault(points[i], set()).add(s)
    assert len(places) == len(points) and len(at) < 6 * len(points)
    for i, p in enumerate(points):
        assert all(places[p] & places[q] for q in points[i + 1 : i + 200] if (p ^ q).bit_count() <= 2)
    monkeypatch.setattr(simhash, "SHARD_POINTS", 300)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()]
    whole = lambda pairs: labels_of([(x % (1 << 64), y % (1 << 64)) for x, y in pairs])
    assert {p: p for p in points} | whole(edges) == plain_labels(points)


def test_dense_points_are_looked_up():
    points = sorted({flipped(random.Random(i), 12345, i % 3) for i in range(1500)})
    a, b = simhash.looked_up(np.array(points, np.uint64), 2)
    assert {p: p for p in points} | labels_of(list(zip(a.tolist(), b.tolist(), strict=True))) == plain_labels(points)
