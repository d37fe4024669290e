"""What goes through the driver or one task stays bounded, whatever the sizes."""

import random

from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.functions import vectors as V
from loamwork.operators import calibration, paths, resample, rules, spans
from loamwork.sources.staging import staged


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_are_not_broadcast(spark):
    rows = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 3).alias("stratum"), (F.col("id") % 2).alias("ok"))
    for out, on in ((resample.bootstrap_mean(rows, "ok", "key", 5, 1), "unit"), (resample.bootstrap_strata(rows, "stratum", "key", "ok", 5, 1), "stratum")):
        joins = [line for line in _plan(out).splitlines() if f"Join [{on}#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins if "unit#" in line)
        assert out.count() == 5


def test_bootstrap_draws_are_spread_over_tasks(spark, monkeypatch):
    units = spark.createDataFrame([(1000,)], "n long")
    whole = {(r.replicate, r.unit): r.weight for r in resample.draws(spark, 3, units, 7).collect()}
    monkeypatch.setattr(resample, "DRAWS_A_ROW", 64)
    cut = resample.draws(spark, 3, units, 7)
    assert {(r.replicate, r.unit): r.weight for r in cut.collect()} == whole
    assert sum(whole.values()) == 3000
    assert resample.draws(spark, 3, spark.createDataFrame([(0,)], "n long"), 7).count() == 0


def test_vectors_of_sum_one_keep_their_bin(spark):
    found = [(a / t, b / t, c / t, d / t) for a in range(40, 90) for b in range(1, 12) for c in range(1, 6) for d in range(1, 6) if (t := float(a + b + c + d))]
    off = [p for p in found if ((0.0 + p[0] + p[1]) + p[2]) + p[3] != 1.0]
    assert off  # sums that rounding leaves beside one
    rows = spark.createDataFrame([("x", list(p)) for p in off], "gold string, probs array<double>")
    assert rows.where(V.normalised(F.col("probs")) != F.col("probs")).count() == 0
    wanted = {}
    for p in off:
        k = min(int(max(p) * 15), 14)
        wanted[k] = wanted.get(k, 0) + 1
    assert {r.bin: r.n for r in calibration.bins(rows, "gold", "probs", ["x", "y", "z", "w"]).collect()} == wanted
    scaled = spark.range(1).select(V.normalised(F.array(F.lit(0.50001), F.lit(0.5))).alias("p")).first().p
    assert abs(sum(scaled) - 1) < 1e-15


def test_tag_runs_are_cut_without_a_row_a_character(spark):
    tags = spark.createDataFrame([(1, ["O", "B-X", "I-X", "I-Y", "B-Y", "B-Y", "I-Y", "O", "I-Y"]), (2, []), (3, None), (4, ["B-X"])], "record_id long, tags array<string>")
    out = spans.spans_from_tags(tags)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 3, "X"), (1, 4, 5, "Y"), (1, 5, 7, "Y"), (4, 0, 1, "X")]
    assert "Exchange" not in _plan(out) and "Window" not in _plan(out)


def test_paths_of_unlike_items_are_not_compared(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "s", "c"), ("a", "t", "c"), ("d", "s", "c")], "head string, relation string, tail string")
    mentions = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (1, "b")], "item_id long, node string")
    one = spark.createDataFrame([(1, "a", "t", "c")] * 2, "item_id long, head string, relation string, tail string")
    out = paths.enumerate_paths(one, edges, mentions)
    found = sorted((tuple(r.nodes), tuple(r.edges)) for r in out.collect())
    assert found == sorted(set(found)) and (("a", "b", "c"), ("r", "s")) in found and (("a", "c"), ("t",)) not in found
    assert not [line for line in _plan(out).splitlines() if "Aggregate(keys=[item_id" in line and "nodes#" in line]
    two = one.unionByName(one.withColumn("relation", F.lit("z")))
    twice = sorted((tuple(r.nodes), tuple(r.edges)) for r in paths.enumerate_paths(two, edges, mentions).collect())
    assert twice == sorted({*found, (("a", "c"), ("t",)), *twice})


def test_units_are_found_once_where_evidence_is_left_out(spark):
    d = spark.createDataFrame([(1, "One two. Three four five! Six.")], "doc_id long, text string")
    out = d.select(X.omitted(F.col("text"), X.segments(F.col("text")), F.lit(0), F.lit(3), F.lit(15), F.lit(19)).alias("t"))
    assert out.first().t == "One □□□□ □□□□□ four □□□□□ Six."
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_recipes_meet_words_of_properties(spark):
    of = lambda relation, pairs: [(relation, h, t) for h, t in pairs]
    rows = of("containsIngredient", [("r1", "i1"), ("r1", "i2"), ("r1", "i2"), ("r2", "i2"), ("r3", "i9")]) + of("hasNature", [("i1", None), ("i2", "n")])
    rows += of("entersmeridian", [("i1", f"m{k:03}") for k in range(200)] + [("i2", "m007")] * 2)
    e = spark.createDataFrame(rows, "relation string, head string, tail string")
    wanted = {("A3", "r1", f"m{k:03}") for k in range(200)} | {("A3", "r2", "m007"), ("A1", "r1", "n"), ("A1", "r2", "n")}
    out = rules.inherited(e)
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted | {("A1", "r1", None)}
    assert "keys=[recipe#" in _plan(out) and not [line for line in _plan(out).splitlines() if "Aggregate(keys=[" in line and "recipe#" in line and "tail#" in line]
    valid = spark.createDataFrame([("A1", None), ("A1", "n"), ("A3", "m007"), ("A2", "m008")], "rule string, tail string")
    assert set(map(tuple, rules.inherited(e, valid).collect())) == {("A1", "r1", "n"), ("A1", "r2", "n"), ("A3", "r1", "m007"), ("A3", "r2", "m007")}


def test_paths_read_mentions_and_fronts_as_staged(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "s", "c"), ("c", "u", "d"), ("a", "t", "d"), ("b", "t", "d")], "head string, relation string, tail string")
    items = spark.createDataFrame([(1, "a", "t", "d")], "item_id long, head string, relation string, tail string")
    mentions = spark.range(8).selectExpr("1L AS item_id", "element_at(array('a', 'b', 'c', 'd'), cast(id % 4 AS int) + 1) AS node")
    for hops, wanted in ((1, set()), (2, {"a>b>d"}), (3, {"a>b>d", "a>b>c>d"}), (4, {"a>b>d", "a>b>c>d"})):
        names = []
        monkeypatch.setattr(paths, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
        out = paths.enumerate_paths(items, edges, mentions, hops)
        assert {">".join(r.nodes) for r in out.collect() if not r.passage_conditioned} == wanted
        assert "paths-local" in names and names.count("paths-front") == hops // 2
        assert "Range (" not in _plan(out)


def _edge_rows(spark):
    rows = [("containsIngredient", "Recipe", r, "Ingredient", i) for r, i in (("r1", "i1"), ("r1", "i2"), ("r1", "i2"), ("r2", "i2"))]
    rows += [("treats", "Ingredient", i, "Disease", d) for i, d in (("i1", "d1"), ("i2", "d1"), ("i2", "d2"))] + [("treatedByRecipe", "Disease", "d3", "Recipe", "r1")]
    return spark.createDataFrame([(k, *r, 1, 1, k, 0.5) for k, r in enumerate(rows)], "edge_id long, relation string, head_type string, head string, tail_type string, tail string, authority_rank int, books int, support int, confidence double")


def test_rule_sets_unite_bits(spark):
    out = rules.propagated(_edge_rows(spark))
    wanted = {("B2", r, d) for r in ("r1", "r2") for d in ("d1", "d2")} | {("B3", "i1", "d3"), ("B3", "i2", "d3")}
    found = [tuple(r) for r in out.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    assert _plan(out).count("bit_or(bits#") > 0 and "keys=[rule#" not in _plan(out)


def test_best_edges_share_the_exchange_of_the_join(spark):
    for rule, wanted in ((rules.b2, {("r1", "d1", 2), ("r1", "d2", 1), ("r2", "d1", 1), ("r2", "d2", 1)}), (rules.b3, {("i1", "d3", 1), ("i2", "d3", 1)})):
        out = rule(_edge_rows(spark))
        assert {tuple(r)[:3] for r in out.collect()} == wanted
        assert "REPARTITION_BY_COL" in _plan(out)


def test_recipes_count_paths_and_keep_those_that_lead(spark, monkeypatch):
    import collections

    import pyarrow as pa

    draw = random.Random(8)
    score = lambda: (draw.choice([1, 2, 3, None]), draw.choice([1, 2]), draw.choice([-2, 0, 5]), draw.choice([0.1, 0.25]))
    contains = {(draw.choice(["r1", "r2", "r3", "hub", "hub", None]), f"i{draw.randrange(60)}"): score() for _ in range(220)}
    treats = {(f"i{draw.randrange(60)}", draw.choice([None, *(f"d{d}" for d in range(1500))]) if draw.random() < 0.9 else "r1"): score() for _ in range(2600)}
    treats |= {(f"i{i}", f"d{d}"): score() for i in range(60) for d in range(3)} | {("r1", "d0"): score(), ("hub", "d1"): score()}
    rows = [("containsIngredient", "Recipe", r, "Ingredient", i, *v) for (r, i), v in contains.items()] + [("treats", "Ingredient", i, "Disease", d, *v) for (i, d), v in treats.items()]
    rows += [("treats", "Recipe", "r2", "Disease", "d2", 1, 1, 1, 0.1)]  # asserted, but no edge of a path
    edges = spark.createDataFrame([(k % 700, *r) for k, r in enumerate(rows)], "edge_id long, relation string, head_type string, head string, tail_type string, tail string, authority_rank int, books int, support int, confidence double")
    ids = {r[1:3] + r[3:5]: k % 700 for k, r in enumerate(rows)}
    low = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    paths_of, by = collections.defaultdict(list), collections.defaultdict(list)
    for (i, d), y in treats.items():
        by[i].append((d, y))
    for (r, i), x in contains.items():
        for d, y in by[i]:
            ranks = [v for v in (x[0], y[0]) if v is not None]
            whole = (min(ranks, default=None), None if len(ranks) < 2 else sum(ranks), x[1] + y[1], x[2] + y[2], round(x[3] + y[3], 9))
            paths_of[r, d].append((low(whole), [ids["Recipe", r, "Ingredient", i], ids["Ingredient", i, "Disease", d]], whole))
    asserted = {*treats, ("r2", "d2")}
    wanted = {k: (len(p), *max(p)[2], max(p)[1]) for k, p in paths_of.items() if k not in asserted or None in k}
    out = rules.b2(edges)
    got = {(x.head, x["tail"]): tuple(x)[2:] for x in out.collect()}
    assert len(wanted) > 2000 and got == wanted and "MapInArrow" in _plan(out)

    # recipes that go on over batches, and rows of several lists
    monkeypatch.setattr(rules, "_ROWS_AT_ONCE", 3)
    fields, cells = [("a_authority_rank", 10, 3, 1), ("a_books", 13, 2, 1)], []
    for r in [None, *sorted(["a"] * 2 + ["b"] * 11 + ["c"] + ["d"] * 9)]:
        cells.append((r, draw.choice([1, 2, 3, None]), draw.choice([1, 2]), draw.randrange(2), [draw.randrange(4) | draw.randrange(4) << 10 | draw.randrange(1, 3) << 13 for _ in range(draw.randrange(4))]))
    batch = pa.record_batch([pa.array(c) for c in zip(*[c[:4] for c in cells], strict=True)] + [pa.array([c[4] for c in cells], pa.list_(pa.int32()))], names=["recipe", "a_authority_rank", "a_books", "word", "codes"])
    want = collections.defaultdict(list)
    for r, rank, books, word, codes in cells:
        for code in codes:
            y, b = (code >> 10 & 7) or None, (code >> 13 & 3)
            both = [v for v in (rank, y) if v is not None]
            want[r, word << 10 | code & 1023].append((low((min(both, default=None), None if len(both) < 2 else sum(both), books + b)), (rank, books)))
    want = sorted((str(r), n, len(p), *map(str, x)) for (r, n), p in want.items() for k, x in p if k == max(p)[0])
    got = [x for out in rules._leading(iter([batch.slice(0, 10), batch.slice(10)]), fields) for x in out.to_pylist()]
    assert sorted((str(x["recipe"]), x["number"], x["paths"], str(x["a_authority_rank"]), str(x["a_books"])) for x in got) == want


def _walks(items, edges, mentions, hops):
    steps = {(a, r, b, r) for a, r, b in edges} | {(b, f"inverse::{r}", a, r) for a, r, b in edges}
    out = []
    for item, head, relation, tail in items:
        touched = {n for i, n in mentions if i == item}
        near = steps | {(n, "mentioned_in", paths.PASSAGE, None) for n in touched} | {(paths.PASSAGE, "mentions", n, None) for n in touched}
        front, found = [((head,), ())], set()
        for _ in range(hops):
            front = [(ns + (b,), ts + (t,)) for ns, ts in front for a, t, b, r in near if a == ns[-1] and a != tail and b not in ns and not (r == relation and {a, b} == {head, tail})]
            found |= {(ns, ts) for ns, ts in front if ns[-1] == tail and not set(ts) <= {"mentioned_in", "mentions"}}
        out += [(item, *f) for f in found]
    return sorted(out)


def _path_case():
    draw = random.Random(3)
    edges = [(f"h{draw.randrange(4)}", "sells", f"p{draw.randrange(8)}") for _ in range(30)] + [(f"h{k}", "in", f"r{k % 2}") for k in range(4)] + [("p1", "sells", "p1"), ("p1", "like", "p2"), ("p2", "inverse::like", "p1")]
    items = [(k, f"h{k % 4}", "in" if k % 5 else "like", f"r{k % 4 // 2}" if k % 3 else f"h{(k + 1) % 4}") for k in range(70)] + [(70, "h0", "in", "h0")]
    mentions = [(k, n) for k, h, _, t in items for n in (h, t, *(b for a, _, b in edges if a == h and (k + len(b)) % 5))]
    return items, edges, mentions


def _path_tables(spark, items, edges, mentions):
    return spark.createDataFrame(items, "item_id long, head string, relation string, tail string"), spark.createDataFrame(edges, "head string, relation string, tail string"), spark.createDataFrame(mentions, "item_id long, node string")


def test_items_that_reach_a_node_alike_share_a_row(spark, monkeypatch):
    case, sizes = _path_case(), {}

    def sized(df, name):
        out = staged(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(paths, "staged", sized)
    for hops in (1, 4, 3):
        sizes.clear()
        found = sorted((r.item_id, tuple(r.nodes), tuple(r.edges)) for r in paths.enumerate_paths(*_path_tables(spark, *case), hops).collect())
        assert found == _walks(*case, hops) and found
    reached = {(h, n) for k, h, _, _ in case[0] for a, _, n in case[1] if a == h}
    assert sizes["paths-front"] <= 2 * (len({n for _, n in reached}) + 7) < len(case[0])  # two words of items


def test_relevance_counts_are_those_of_whole_paths(spark):
    case = _path_case()
    tables, passage = _path_tables(spark, *case), F.lit("p1 p2 h3")
    ways, index, repeated = paths.shared_paths(*tables)
    shared = paths.counted(ways, index, F.round(paths.relevance(passage, ends=False), 6).alias("score")).groupBy("item_id", "score").agg(F.sum("n").alias("n"))
    whole = paths.enumerate_paths(*tables).groupBy("item_id", F.round(paths.relevance(passage), 6).alias("score")).count()
    assert not repeated and sorted(map(tuple, shared.collect())) == sorted(map(tuple, whole.collect()))


def test_paths_are_cut_to_the_best_of_a_kind_before_an_exchange(spark):
    case = _path_case()
    tables = _path_tables(spark, *case)
    ways, index, _ = paths.shared_paths(*tables)
    rank = lambda ns, ts: (len(ts), -sum(not t.startswith("mention") for t in ts), ts, ns)
    kind = lambda f: paths.PASSAGE in f[0]
    wanted = set()
    for item in {i for i, *_ in case[0]}:
        found = sorted(((ns, ts) for i, ns, ts in _walks([x for x in case[0] if x[0] == item], case[1], case[2], 3)), key=lambda f: rank(*f))
        first = [f for k in (True, False) for f in [x for x in found if kind(x) == k][: 3 if k else 2]]
        kept = (sorted(first, key=lambda f: rank(*f)) + [f for f in found if f not in first])[:4]
        wanted |= {(item, n, *f) for n, f in enumerate(sorted(kept, key=lambda f: (len(f[1]), not kind(f), f[1], f[0])), 1)}
    whole, shared = paths.select_paths(paths.enumerate_paths(*tables), 4, 3, 2), paths.select_shared(ways, index, 4, 3, 2)
    for out in (whole, shared):
        assert {(r.item_id, r["rank"], tuple(r.nodes), tuple(r.edges)) for r in out.collect()} == wanted
        assert "WindowGroupLimit" in _plan(out)
