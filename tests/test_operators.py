"""Operators on small tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from loamwork.functions import distributions, vectors
from loamwork.operators import agreement, calibration, decide, metrics, ordering, passages, paths, resample, rules, spans, splits, study
from loamwork.sources import contracts, files
from loamwork.streaming import log

LABELS = decide.LABELS


def test_metrics_average_over_the_fixed_domain(spark):
    pairs = spark.createDataFrame([("SUPPORTED", "SUPPORTED")] * 4 + [("NOT_SUPPORTED", "SUPPORTED")] * 4, "g string, p string")
    r = metrics.macro(pairs, "g", "p", LABELS).first()
    assert r.n == 8 and r.accuracy == 0.5 and math.isclose(r.macro_f1, (8 / 12) / 4)
    cells = {(c.gold, c.pred): c.n for c in metrics.confusion(pairs, "g", "p", LABELS).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 8 and cells["NOT_SUPPORTED", "SUPPORTED"] == 4
    perfect = spark.createDataFrame([(x, x) for x in LABELS], "g string, p string")
    assert metrics.macro(perfect, "g", "p", LABELS).first().macro_f1 == 1.0


def test_unknown_label_stops(spark):
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("?",)], "x string").select(metrics.decision(F.col("x"))).collect()


def test_abstention_is_null_without_support(spark):
    r = metrics.abstention(spark.createDataFrame([("SUPPORTED", "SUPPORTED")], "g string, p string"), "g", "p").first()
    assert r.coverage == 1.0 and r.any_abstention_recall is None


def test_probabilities(spark):
    rows = spark.createDataFrame([([0.7, 0.1, 0.1, 0.1],), ([0.7, 0.1, 0.1, 0.3],), ([float("nan"), 0.5, 0.25, 0.25],), ([0.4, 0.4, 0.1, 0.1],)], "p array<double>")
    got = rows.select(vectors.valid(F.col("p"), 4).alias("v"), vectors.argmax(F.col("p"), LABELS).alias("a")).collect()
    assert [r.v for r in got] == [True, False, False, True] and got[3].a == "SUPPORTED"
    sure = spark.createDataFrame([("SUPPORTED", [1.0, 0.0, 0.0, 0.0])], "g string, p array<double>")
    assert calibration.bins(sure, "g", "p", LABELS).first().bin == 14


def test_kappa(spark):
    rate = lambda pairs: agreement.kappa(spark.createDataFrame(pairs, "a string, b string"), "a", "b").first().kappa
    assert rate([("y", "y"), ("n", "n")]) == 1.0 and rate([("y", "y")] * 3) == 1.0
    assert math.isclose(rate([("y", "y"), ("y", "n"), ("n", "y"), ("n", "n")]), 0.0, abs_tol=1e-12)


def test_adjudication_needs_a_third_label(spark):
    rows = spark.createDataFrame([("a", "a", None), ("a", "b", "b")], "x string, y string, z string")
    assert [r.final for r in agreement.adjudicated(rows, "x", "y", "z").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="missing"):
        agreement.adjudicated(spark.createDataFrame([("a", "b", None)], rows.schema), "x", "y", "z").collect()


def test_two_stage_weights_keep_cluster_sizes(spark):
    rows = spark.createDataFrame([(i, f"c{i % 3}") for i in range(12)], "k int, c string")
    weights = resample.two_stage_weights(rows, "c", "k", 9, 5)
    assert {r.s for r in weights.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()} == {12}


def test_ranks(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "k int, v double")
    got = {r.k: r["rank"] for r in ordering.ranked(rows, "v", "k", descending=True, ranges=8).collect()}
    want = {k: n for n, (_, k) in enumerate(sorted((-(i % 7), i) for i in range(500)), 1)}
    assert got == want


def test_distributions():
    assert math.isclose(distributions.t_two_sided(2.0, 10), 0.0733880, abs_tol=1e-6)
    assert math.isclose(distributions.t_quantile(0.975, 99), 1.9842170, abs_tol=1e-6)
    assert math.isclose(distributions.f_upper(4.0, 2, 10), 1.8**-5, rel_tol=1e-12)  # closed form for two degrees of freedom
    assert math.isclose(distributions.binomial_two_sided(73, 100), 4.7e-6, rel_tol=0.05)


def test_paired_study(spark):
    rows = spark.createDataFrame([(p, s, float(v)) for p, a, b in ((1, 3, 1), (2, 4, 3), (3, 5, 2), (4, 2, 2), (5, 9, None)) for s, v in (("x", a), ("y", b)) if v is not None], "p int, s string, v double")
    r = study.paired_statistics(study.paired(rows, "p", "s", "v", ("x", "y"))).first()
    assert r.n == 4 and r["mean"] == 1.5 and math.isclose(r.t, 1.5 / (math.sqrt(5 / 3) / 2))
    tested = study.with_tests(study.paired_statistics(study.paired(rows, "p", "s", "v", ("x", "y")))).first()
    assert tested.low < 1.5 < tested.high and 0 < tested.p_value < 1


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r.name: round(r.adjusted, 9) for r in study.holm(rows).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_folds_and_samples(spark):
    rows = spark.createDataFrame([(i, f"g{i % 12}", LABELS[i % 4]) for i in range(240)], "k int, g string, l string")
    folds = splits.group_folds(rows, "g", "l", LABELS, 5)
    assert folds.count() == 240 and folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert splits.fixed_per_stratum(rows, "l", "k", 7, 1).count() == 28
    alloc = splits.root_allocation(rows.groupBy("g").agg(F.count("*").alias("n")), "g", "n", 30).agg(F.sum("allocated")).first()[0]
    assert alloc == 30
    moved = splits.derangement(rows, "k", "k", 3).collect()
    assert {r.next_k for r in moved} == set(range(240)) and all(r.k != r.next_k for r in moved)


EDGES = [("A", "r", "B"), ("A", "q", "B"), ("A", "s", "C"), ("C", "s", "B"), ("C", "t", "D"), ("D", "t", "B"), ("B", "r", "E"), ("A", "s", "C")]


def test_paths_never_use_the_blocked_edge(spark):
    edges = spark.createDataFrame(EDGES, "head string, relation string, tail string")
    items = spark.createDataFrame([("i", "A", "r", "B")], "item_id string, head string, relation string, tail string")
    mentions = spark.createDataFrame([("i", "A"), ("i", "B"), ("i", "C")], "item_id string, node string")
    found = paths.enumerate_paths(items, edges, mentions).collect()
    seen = {(tuple(r.nodes), tuple(r.edges)) for r in found}
    assert (("A", "B"), ("q",)) in seen and (("A", "B"), ("r",)) not in seen
    assert (("A", "C", "D", "B"), ("s", "t", "t")) in seen and (("A", "C", paths.PASSAGE, "B"), ("s", "mentioned_in", "mentions")) in seen
    assert all(len(set(r.nodes)) == len(r.nodes) and r.hops <= 3 and r.semantic_edges > 0 for r in found) and len(found) == len(seen)
    picked = paths.select_paths(paths.enumerate_paths(items, edges, mentions), 3, 1, 1).orderBy("rank").collect()
    assert len(picked) == 3 and sum(r.passage_conditioned for r in picked) >= 1


def test_rules_count_best_edges_once(spark):
    rows = [(1, "containsIngredient", "Recipe", "r", "Ingredient", "i", 1, 1, 1, 0.1), (2, "containsIngredient", "Recipe", "r", "Ingredient", "i", 3, 1, 1, 0.1), (3, "containsIngredient", "Recipe", "r", "Ingredient", "j", 2, 1, 1, 0.1),
            (4, "treats", "Ingredient", "i", "Disease", "d", 2, 1, 1, 0.2), (5, "treats", "Ingredient", "j", "Disease", "d", 4, 1, 1, 0.2), (6, "treats", "Ingredient", "j", "Disease", "e", 4, 1, 1, 0.2), (7, "treats", "Recipe", "r", "Disease", "e", 1, 1, 1, 0.1)]
    e = spark.createDataFrame(rows, "edge_id long, relation string, head_type string, head string, tail_type string, tail string, authority_rank int, books int, support int, confidence double")
    (only,) = rules.b2(e).collect()
    assert (only.head, only.tail, only.path_count, only.path) == ("r", "d", 2, [3, 5])  # 2 + 4 beats 3 + 2 at equal least rank
    assert rules.role_view(e, "general").count() == 5


def test_guard(spark):
    rows = spark.createDataFrame([("treats", "I", "D", [0.7, 0.1, 0.1, 0.1]), ("treats", "D", "I", [0.7, 0.1, 0.1, 0.1]), ("new", "D", "I", [0.7, 0.1, 0.1, 0.1])], "relation string, head_type string, tail_type string, probs array<double>")
    signatures = spark.createDataFrame([("treats", "I", "D")], "relation string, head_type string, tail_type string")
    got = {(r.relation, r.head_type): r.probs for r in decide.guarded(rows, signatures).collect()}
    assert got["treats", "D"] == [0, 0, 0, 1] and got["treats", "I"][0] == got["new", "D"][0] == 0.7


def test_bio_round_trip(spark):
    docs = spark.createDataFrame([("a", "甘草甘温"), ("b", "x")], "record_id string, text string")
    found = spark.createDataFrame([("a", 0, 2, "H"), ("a", 2, 4, "H"), ("a", 1, 3, "Z"), ("a", 3, 9, "Q")], "record_id string, start int, end int, label string")
    tags = spans.bio_tags(docs, found)
    assert {r.record_id: r.tags for r in tags.collect()} == {"a": ["B-H", "I-H", "B-H", "I-H"], "b": ["O"]}
    assert {tuple(r) for r in spans.spans_from_tags(tags).collect()} == {("a", 0, 2, "H"), ("a", 2, 4, "H")}
    loose = spark.createDataFrame([("c", ["I-H", "B-H", "I-Z", "I-H", "B-Z", "I-Z"])], "record_id string, tags array<string>")
    assert {tuple(r) for r in spans.spans_from_tags(loose).collect()} == {("c", 1, 2, "H"), ("c", 4, 6, "Z")}


def test_longest_match(spark):
    docs = spark.createDataFrame([("a", "abcab")], "record_id string, text string")
    words = spark.createDataFrame([("ab", "P", 5), ("abc", "Q", 1), ("b", "R", 9)], "text string, label string, n long")
    kept = spans.without_overlap(spans.occurrences(docs, words)).collect()
    assert {(r.start, r.end, r.label) for r in kept} == {(0, 3, "Q"), (3, 5, "P")}


def test_many_to_one_and_errors(spark):
    left, twice = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        passages.many_to_one(left, twice, "k").collect()
    pair = spark.createDataFrame([("甘温无毒", "甘寒毒")], "reference string, raw string")
    assert passages.error_rates(pair).first().distance == 2


def test_contracts(spark):
    free = spark.createDataFrame([("a", False)], "item_id string, label_fields_present boolean")
    assert contracts.label_free(free).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.label_free(free.withColumn("gold", F.lit(1)))
    with pytest.raises(contracts.ContractError):
        contracts.labelled_split("test")
    with pytest.raises(Exception, match="must be false"):
        contracts.label_free(free.withColumn("label_fields_present", F.lit(True))).collect()
    with pytest.raises(contracts.ContractError):
        contracts.same_keys(free, free.where("false"), ["item_id"])
    with pytest.raises(contracts.ContractError):
        contracts.unique(free.unionByName(free), ["item_id"])


def test_files(spark, tmp_path):
    import gzip
    import hashlib

    (tmp_path / "a.jsonl.gz").write_bytes(gzip.compress(b'{"text": "x", "label": "L"}\n\n'))
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl.gz"), "text string, label string").count() == 1
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    (tmp_path / "b.csv").write_bytes('﻿k,v\n1,"two\nlines"\n'.encode())
    assert files.read_csv(spark, str(tmp_path / "b.csv")).collect()[0].asDict() == {"k": "1", "v": "two\nlines"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.txt").write_bytes(b"a\r\nb\n")
    row = files.manifest(spark, str(tmp_path / "m")).first()
    assert row.bytes == 5 and row.sha256 == hashlib.sha256(b"a\r\nb\n").hexdigest() and row.sha256_text == hashlib.sha256(b"a\nb\n").hexdigest()
    tagged = spark.createDataFrame([("ab", ["O", "B-H"])], "text string, tags array<string>")
    files.write_bio(tagged.coalesce(1), str(tmp_path / "bio"))
    assert files.read_bio(spark, str(tmp_path / "bio")).first().tags == ["O", "B-H"]
    files.write_csv(tagged.select("text", F.lit(1).alias("other")), str(tmp_path / "csv"), ["text"])
    assert files.read_csv(spark, str(tmp_path / "csv")).columns == ["text"]
    assert "a\\|b" in files.markdown(spark.createDataFrame([("a|b",)], "c string"))


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("batch_digest"), "ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    log.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("batch_digest").distinct().count()
