"""Connected components in a number of rounds that grows with the logarithm of the nodes."""

import random

import pytest
from pyspark.sql import functions as F

from loamwork.llm import graph, jaccard_join


def labels_of(edges):
    label = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            label[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in label}


def same_parts(found, want):
    assert len(found) == len({n for n, _ in found}) and {n for n, _ in found} == set(want)
    pairs = {(label, want[node]) for node, label in found}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_chains_stars_and_random_graphs(spark):
    random.seed(2)
    chain = [(i, i + 1) for i in range(5000)]
    star = [(9000, i) for i in range(9001, 9300)]
    loose = [(random.randint(20_000, 20_400), random.randint(20_000, 20_400)) for _ in range(300)] + [(1, 1), (7, 6), (6, 7)]
    edges = chain + star + loose
    rounds = []
    found = [(r.node, r.label) for r in graph.components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()]
    same_parts(found, labels_of(edges))
    assert len(rounds) <= 24  # 12.3 halvings
    assert graph.components(spark.createDataFrame([(3, 3), (None, 4)], "a long, b long")).count() == 0


def test_a_chain_of_near_copies_is_one_class(docs_of):
    words = [f"w{i}" for i in range(100 + 9 * 70)]
    rows = [(1000 - i, " ".join(words[9 * i : 9 * i + 100])) for i in range(70)]
    out = jaccard_join.similarity_classes(docs_of(rows)).collect()
    assert {r.class_id for r in out} == {931} and sorted(r.n_links for r in out) == [1, 1] + [2] * 68


def words(rng, k):
    return [f"w{rng.randrange(10**6)}" for _ in range(k)]


@pytest.fixture(scope="module")
def half_shared():
    """3,000 texts that share half their words, similarity about 1/3, some with a near copy."""
    rng = random.Random(8)
    shared = words(rng, 60)
    rows = []
    for i in range(3000):
        own = words(rng, 60)
        rows.append((2 * i, " ".join(shared + own)))
        if i % 10 == 0:
            own[-1] = f"v{i}"
            rows.append((2 * i + 1, " ".join(shared + own)))
    return rows


def test_boilerplate_ties_no_large_component(docs_of, half_shared):
    docs = docs_of(half_shared)
    units = jaccard_join.signed_rows(docs, "doc_id", "text").select("rid", "marks", "doc_id")
    near = graph.components(jaccard_join.candidate_edges(units.select("rid", "marks"))).join(units.select(F.col("rid").alias("node"), "doc_id"), "node").collect()
    sizes, label = {}, {}
    for r in near:
        sizes[r.label] = sizes.get(r.label, 0) + 1
        label[r.doc_id] = r.label
    assert max(sizes.values()) <= 64
    copies = [i for i, _ in half_shared if i % 2]
    assert sum(label.get(i) == label.get(i - 1, -1) for i in copies) >= 0.99 * len(copies)


def test_a_large_bucket_of_two_families_keeps_all_links(docs_of):
    """300 near copies and 300 texts that only share their opening: every link of either is found."""
    rng = random.Random(9)
    base, rows = words(rng, 200), []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(150, 200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
        rows.append((1000 + i, " ".join(base[:100] + words(rng, 100))))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs_of(rows)).collect()}
    assert {got[i][0] for i in range(300)} == {0} and all(got[1000 + i] == (1000 + i, 0) for i in range(300))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows[::2]]
    for i in range(0, 300, 7):
        assert got[i][1] == sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for s in sets) - 1


def test_tiles_are_dealt_by_bytes(docs_of, monkeypatch):
    """Few but long near copies make several tiles, whose links are the same."""
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 20_000)
    base = words(random.Random(10), 1000)
    rows = [(i, " ".join(base[:-1] + [f"y{i}"])) for i in range(20)]
    out = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs_of(rows)).collect()}
    assert out == {i: (0, 19) for i in range(20)}
