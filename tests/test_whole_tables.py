"""Queries over whole tables against brute force on a small fixture."""

import itertools

import pytest

from loamwork.operators import rules
from loamwork.plans import registry
from loamwork.plans.bindings import edges

NATIONS = [(0, 0), (1, 0), (2, 0), (3, 1)]
SUPPLIERS = [(1, 0), (2, 1), (3, 3)]
CUSTOMERS = [(1, 0, 10.0), (2, 3, -5.0), (3, 1, 700.0)]
PARTS = [(1, "Brand#11", "TIN", 1), (2, "Brand#12", "STEEL", 3), (4, "Brand#11", "TIN", 7)]
ORDERS = [(10, 1), (11, 2), (12, 3), (13, 1)]
# order, line, part, supplier, quantity, discount, flag
LINES = [
    (10, 1, 1, 1, 1.0, 0.0, "R"), (10, 2, 2, 2, 50.0, 0.10, "N"), (11, 1, 1, 2, 20.0, 0.05, "R"), (11, 2, 4, 3, 3.0, 0.01, "A"),
    (12, 1, 2, 1, 49.0, 0.02, "R"), (12, 2, 4, 1, 7.0, 0.09, "N"), (13, 1, 4, 2, 30.0, 0.00, "R"), (13, 2, 1, 1, 50.0, 0.04, "A"),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    tables = {
        "nation": (NATIONS, "n_nationkey int, n_regionkey int"), "supplier": (SUPPLIERS, "s_suppkey long, s_nationkey int"), "customer": (CUSTOMERS, "c_custkey long, c_nationkey int, c_acctbal double"),
        "part": (PARTS, "p_partkey long, p_brand string, p_type string, p_size int"), "orders": (ORDERS, "o_orderkey long, o_custkey long"),
        "lineitem": (LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def relations():
    region, of_supplier, buyer = dict(NATIONS), dict(SUPPLIERS), dict(ORDERS)
    nation = {c: n for c, n, _ in CUSTOMERS}
    of = lambda flag: {(str(x[2]), f"d{nation[buyer[x[0]]]}") for x in LINES if x[6] == flag}
    return {
        "entersmeridian": {(str(x[2]), str(of_supplier[x[3]])) for x in LINES}, "containsIngredient": {(str(buyer[x[0]]), str(x[2])) for x in LINES}, "treats": of("R"), "contraindicates": of("A"),
        "affectsOrgan": {(f"d{n}", str(region[n])) for _, n, _ in CUSTOMERS}, "correspondsToOrgan": {(str(n), str(r)) for n, r in NATIONS}, "treatedByRecipe": {(f"d{nation[c]}", str(c)) for _, c in ORDERS},
        "hasNature": {(str(p[0]), p[1]) for p in PARTS}, "hasFlavor": {(str(p[0]), p[2]) for p in PARTS},
    }


def counted(pairs, asserted):
    pairs = [p for p in pairs if p not in asserted]
    return {(*p, pairs.count(p)) for p in pairs}


def test_rules(spark, small):
    r = relations()
    run = lambda name: registry.QUERIES[name](spark, small).collect()
    open_ = lambda name: {(x.head, x["tail"], x.path_count) for x in run(name)}
    b1 = [(i, d) for i, m in r["entersmeridian"] for m2, o in r["correspondsToOrgan"] for d, o2 in r["affectsOrgan"] if m == m2 and o == o2]
    b2 = [(c, d) for c, i in r["containsIngredient"] for i2, d in r["treats"] if i == i2]
    b3 = [(i, d) for d, c in r["treatedByRecipe"] for c2, i in r["containsIngredient"] if c == c2]
    for name, pairs in (("rule_b1", b1), ("rule_b2", b2), ("rule_b3", b3)):
        want = counted(pairs, r["treats"])
        assert want and open_(name) == want, name
    kinds = {"A1": "hasNature", "A2": "hasFlavor", "A3": "entersmeridian"}
    want = {(k, c, t) for k, rel in kinds.items() for c, i in r["containsIngredient"] for i2, t in r[rel] if i == i2}
    assert {(x.rule, x.head, x["tail"]) for x in run("rule_a")} == {x for x in want if x[0] == "A3"}  # no word has a dozen parts
    got = rules.inherited(edges(spark, small, ("containsIngredient", "hasNature", "hasFlavor", "entersmeridian")))
    assert {(x.rule, x.head, x["tail"]) for x in got.collect()} == want
    want = {("C1", i, n, d) for i, n in r["hasNature"] for i2, d in r["treats"] if i == i2 and n[-1] in d}
    want |= {("C2", i, m, d) for i, m in r["entersmeridian"] for i2, d in r["treats"] if i == i2 and m[-1] not in d}
    want |= {("C3", i, "contraindicates", d) for i, d in r["treats"] & r["contraindicates"]}
    assert {tuple(x) for x in run("rule_c")} == want
    best = {(x.relation, x.head, x["tail"]) for x in run("best_edge")}
    assert best == {(k, *p) for k in ("entersmeridian", "containsIngredient", "treats") for p in r[k]}
    views = {(x.role, x.relation): x.n_edges for x in run("role_views")}
    assert views["researcher", "entersmeridian"] == len(LINES) and views["researcher", "affectsOrgan"] == len(CUSTOMERS)


def test_paths(spark, small):
    region, of_supplier = dict(NATIONS), dict(SUPPLIERS)
    sells = {(f"N{of_supplier[x[3]]}", f"P{x[2]}") for x in LINES}
    graph = {(f"N{n}", "inRegion", f"R{r}") for n, r in NATIONS} | {(n, "sells", p) for n, p in sells}
    steps = {(a, t, b, t) for a, t, b in graph} | {(b, f"inverse::{t}", a, t) for a, t, b in graph}
    want = set()
    for x, y in itertools.product(region, region):
        if x < y and region[x] == region[y]:
            head, tail = f"N{x}", f"R{region[x]}" if (x + y) % 2 == 0 else f"N{y}"
            touched = {head, tail} | {p for n, p in sells if n == head}
            near = steps | {(n, "mentioned_in", "__PASSAGE__", None) for n in touched} | {("__PASSAGE__", "mentions", n, None) for n in touched}
            front = [((head,), ())]
            for _ in range(3):
                front = [(ns + (b,), ts + (t,)) for ns, ts in front for a, t, b, rel in near if a == ns[-1] and a != tail and b not in ns and not (rel == "inRegion" and {a, b} == {head, tail})]
                want |= {(x * 100 + y, ">".join(ns), ">".join(ts)) for ns, ts in front if ns[-1] == tail and not set(ts) <= {"mentioned_in", "mentions"}}
    run = lambda name: registry.QUERIES[name](spark, small).collect()
    got = {(r.item_id, r.nodes, r.edges) for r in run("target_deleted_paths")}
    assert got == want
    count = {i: sum(w[0] == i for w in want) for i, _, _ in want}
    assert {r.item_id: r.path_count for r in run("path_coverage")} == count
    assert {r.item_id: r.value for r in run("path_features") if r.feature == "paths"} == count
    assert {r.item_id for r in run("path_relevance")} == set(count)
    assert {(r.item_id, r.nodes, r.edges) for r in run("selected_paths")} <= want


def test_lexicon_of_every_length_in_documents(spark, tmp_path):
    items = ["Al met Christopher near considerable hills"] * 3 + ["rare considerably"]
    docs = [(1, "Al saw considerable hills; Christopher, inconsiderable Al"), (2, ""), (3, None), (4, "nothing here")]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    entries = {"Al": "NAME", "Christopher": "NAME", "considerable": "WORD", "hills": "WORD"}
    want = {(i, k, k + len(w), label, w, 3) for i, t in docs for w, label in entries.items() for k in range(len(t or "")) if t.startswith(w, k)}
    assert {tuple(r) for r in run("lexicon_matches")} == want and len(want) == 6
    assert {tuple(r) for r in run("longest_matches")} == {(i, a, b, label) for i, a, b, label, _, _ in want}
