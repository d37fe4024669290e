"""Policies, scores, donors, numbering and models against plain versions, and helpers that no query runs."""

import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loamwork.functions import arrays
from loamwork.functions import text as X
from loamwork.functions import vectors as V
from loamwork.operators import decide, learning, metrics, ordering, passages, rules, spans, splits, study
from loamwork.sources import contracts, files

LABELS = decide.LABELS


def test_numbering_is_a_global_order(spark):
    random.seed(1)
    rows = [("".join(random.choice("abé日") for _ in range(random.randint(0, 9))), i) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, i int")
    got = {r.i: r.rank for r in ordering.numbered(df, ordering.text_place(F.col("s")), ["s", "i"], ranges=7).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [i for _, i in sorted(rows, key=lambda r: (r[0].encode(), r[1]))]
    blocks = splits.derangement(df.withColumn("b", F.col("i") % 3), "i", "i", 5, "b").collect()
    for b in range(3):
        after = {r.i: r.next_i for r in blocks if r.b == b}
        seen, at = set(), b
        while at not in seen:
            seen.add(at)
            at = after[at]
        assert len(seen) == len(after) == 100


def test_closest_donor_is_the_best_pair(spark):
    random.seed(2)
    make = lambda n, k0: [(k0 + i, random.choice("xyz"), random.choice("pq"), random.randint(0, 60)) for i in range(n)]
    items, donors = make(80, 0), make(40, 1000) + [(2000, "w", "p", 30)]
    tiers = (("a", "b"), ("a",), ("b",))
    schema = "item_id long, a string, b string, v long"
    got = {r.item_id: (r.donor, r.tier, r.score) for r in passages.closest_donor(spark.createDataFrame(items, schema), spark.createDataFrame(donors, schema), tiers, "v").collect()}
    for i, a, b, v in items:
        for tier, same in enumerate((lambda d: d[1:3] == (a, b), lambda d: d[1] == a, lambda d: d[2] == b), 1):
            some = [(-abs(d[3] - v), -d[0]) for d in donors if same(d)]
            if some:
                assert got[i] == (-max(some)[1], tier, max(some)[0])
                break


def test_folds_keep_groups_whole_however_many(spark, monkeypatch):
    monkeypatch.setattr(splits, "UNITS", 20)
    random.seed(3)
    rows = [(f"g{random.randint(0, 300)}" if i % 3 else "big", random.choice(LABELS)) for i in range(1500)] + [(None, LABELS[0])]
    out = splits.group_folds(spark.createDataFrame(rows, "g string, label string"), "g", "label", LABELS, 4).collect()
    assert len(out) == len(rows) and {r.fold for r in out} == {0, 1, 2, 3}
    assert all(len({r.fold for r in part}) == 1 for _, part in itertools.groupby(sorted(out, key=lambda r: str(r.g)), key=lambda r: r.g))


def test_models(spark):
    rows = spark.createDataFrame([(LABELS[i % 4], f"t{i % 4}" if i % 7 else None, float(i % 4), f"s{i % 6}") for i in range(120)], "label string, kind string, x double, source string")
    filled = learning.with_frequent(rows, rows, ["kind"])
    assert filled.where("kind IS NULL").count() == 0
    ready = learning.fit_frame(filled, ["kind"], ["x"]).transform(filled)
    for out in (learning.forest_ensemble(ready, ready, "label", LABELS, (1, 2), 5, 4), learning.cascade(ready, ready, "label", LABELS, omitted=ready.where(F.lit(False)))):
        for r in out.select("label", "probs").collect():
            assert abs(sum(r.probs) - 1) < 1e-9 and LABELS[r.probs.index(max(r.probs))] == r.label
    more = learning.cascade(ready, ready, "label", LABELS, omitted=ready.where(F.col("label") == LABELS[0]), omitted_weight=5.0)
    share = lambda df: df.where(F.col("label") == LABELS[0]).agg(F.avg(F.get("probs", F.lit(2)))).first()[0]
    assert share(more) > share(learning.cascade(ready, ready, "label", LABELS))
    chosen = learning.selected_penalty(ready.withColumn("fold", (F.col("x") * 0 + F.substring("source", 2, 1).cast("int") % 2).cast("int")), "label", LABELS, "fold", (0.001, 1.0)).collect()
    assert len(chosen) == 2 and (-chosen[0].macro_f1, chosen[0].c) < (-chosen[1].macro_f1, chosen[1].c)


def test_routers_and_selection(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], [0.0, 1.0], 0.25), ("b", [1.0, 0.0], [0.5, 0.5], 1.0)], "g string, p array<double>, q array<double>, w double")
    out = df.select(decide.routed(F.col("g"), {"a": F.col("q")}, F.col("p")).alias("r"), decide.soft_routed(F.col("w"), F.col("p"), F.col("q")).alias("s")).collect()
    assert [r.r for r in out] == [[0.0, 1.0], [1.0, 0.0]] and [r.s for r in out] == [[0.25, 0.75], [1.0, 0.0]]
    results = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.8, 0.1), (3, 0.7, 0.05)], "k int, f double, risk double")
    assert decide.safest(results, F.col("risk") <= 0.2, [F.desc("f")]).first().k == 2 and decide.safest(results, F.col("risk") < 0, [F.desc("f")]).first().k == 1
    scored = spark.createDataFrame([("r", 0.4, 0.9, 0.6), ("s", 0.4, 0.1, 0.6)], "relation string, local_score double, comparator_score double, llm_score double")
    limits = spark.createDataFrame([("s", 0.3)], "relation string, threshold double")
    take = lambda family, **o: [r.accepted for r in decide.accepted(scored, family, **o).orderBy("relation").collect()]
    assert take("local", relation_thresholds=limits) == [False, True] and take("comparator") == [True, False] and take("blend") == [True, True] and take("both") == [False, False] and take("llm") == [True, True]


def test_best_epoch(spark):
    log = [("a", e, s) for e, s in enumerate((0.1, 0.3, 0.3, 0.3 + 1e-9, 0.9))] + [("b", 0, 0.2), ("b", 1, 0.4), ("c", 0, None)]
    out = {r.run: tuple(r)[1:] for r in decide.best_epoch(spark.createDataFrame(log, "run string, epoch int, score double"), ["run"], "epoch", "score", 2).collect()}
    assert out == {"a": (1, 0.3, 3), "b": (1, 0.4, 1), "c": (None, None, 0)}


def test_vectors_and_texts(spark):
    one = spark.range(1)
    value = lambda e: one.select(e.alias("x")).first().x
    array = lambda *v: F.array(*map(F.lit, v))
    assert value(V.stage_view(array(0.2, 0.2, 0.5, 0.1))) == pytest.approx([0.5, 0.5, 0.1])
    assert sum(value(V.normalised(array(0.5, 1.5, 0.0)))) == pytest.approx(1)
    assert value(V.checked(array(0.5, 0.5), 2)) == pytest.approx([0.5, 0.5])
    with pytest.raises(Exception, match="invalid probability"):
        value(V.checked(array(0.5, 0.9), 2))
    assert value(X.coded(F.lit(7), "OCR")) == "OCR-0007"
    assert value(X.spaced(F.lit("　a \n b  "))) == "a b"
    assert value(X.query_text({"head_text": F.lit("h"), "relation": F.lit("r")})) == " h r    "
    assert value(X.structured_text({"tail_text": F.lit("t")}, F.lit(None).cast("string"))).endswith("[TAIL] t [PASSAGE] ")
    assert value(arrays.running(F.array().cast("array<long>"), lambda a, b: a + b, F.lit(0).cast("long"))) == []
    long = "甲。" * 200_000
    assert len(value(X.segments(F.lit(long)))) == 200_000


def test_long_documents_of_spans(spark):
    n = 20_000
    docs = spark.createDataFrame([("d", "ab " * n)], "record_id string, text string")
    found = spans.occurrences(docs, spark.createDataFrame([("ab", "X", 1), ("b a", "Y", 1)], "text string, label string, n long"))
    kept = spans.without_overlap(found, order="first")
    tags = spans.bio_tags(docs, found)
    assert kept.count() == n and spans.spans_from_tags(tags).count() == n


def test_segments_pages_ratings(spark):
    rows = spark.createDataFrame([("i", k, s, k == 4) for k, s in enumerate((0.1, 0.9, 0.3, 0.2, 0.05, 0.0))], "item_id string, idx int, similarity double, holds_endpoint boolean")
    assert sorted(r.idx for r in passages.selected_segments(rows, 1).collect()) == [1, 3, 4, 5]
    pages = spark.createDataFrame([("文" * 100,), ("文" * 10,), ("x" * 100,), (None,)], "text string")
    assert passages.eligible_pages(pages).count() == 1
    edges = spark.createDataFrame([(1, "a", 1, 1, 0.5), (2, "a", 3, 1, 0.1)], "edge_id int, relation string, support int, books int, confidence double")
    assert [r.edge_id for r in rules.by_support(edges).collect()] == [2, 1]
    own = spark.createDataFrame([("r", 1, True), ("r", 2, False)], "record_id string, window int, owned boolean")
    inside = spark.createDataFrame([("r", 1, 5, 7, "X"), ("r", 2, 5, 7, "X")], "record_id string, window int, start int, end int, label string")
    assert spans.stitched(inside, own).count() == 1
    study_rows = spark.createDataFrame([("3", "x")], "a string, b string").select(study.number(F.col("a")).alias("a"), study.number(F.col("b")).alias("b")).first()
    assert study_rows.a == 3.0 and study_rows.b is None


def test_selection_score_without_unseen_sources(spark):
    rows = spark.createDataFrame([(LABELS[0], LABELS[0], "a"), (LABELS[2], LABELS[3], "a")], "gold string, pred string, source string")
    out = metrics.selection_score(rows, "gold", "pred", "source", rows, LABELS).first()
    assert out.unseen_items == 0 and out.three_decision == out.unseen_three_decision == out.harmonic == pytest.approx(2 / 3)


def test_files_and_contracts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "label": "x", "split": "train"}\n\n{"id": 2, "label": "y", "split": "train"}\n', encoding="utf-8")
    assert files.count_lines(spark, str(tmp_path / "a.jsonl")) == 2
    (tmp_path / "t.csv").write_text("﻿a,b\n1,2\n3,4\n", encoding="utf-8")
    assert files.csv_shape(spark, str(tmp_path / "t.csv")) == (2, ["a", "b"])
    df = spark.createDataFrame([(1, "é", "no")], "a int, b string, c string")
    files.write_csv(df, str(tmp_path / "out"), ["b", "a"], mark=True)
    part = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf") and part.decode("utf-8-sig").splitlines()[0] == "b,a"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/one.txt", "1")
        z.writestr("two.txt", "22")
    members = {(r.member, r.bytes) for r in files.zip_members(spark, str(tmp_path / "z.zip")).collect()}
    assert members == {("in/one.txt", 1), ("two.txt", 2)}
    items = spark.createDataFrame([(1,), (2,)], "item_id int")
    contracts.same_keys(items, items, ["item_id"])
    contracts.disjoint_and_whole([items.where("item_id = 1"), items.where("item_id = 2")], items, "item_id")
    with pytest.raises(contracts.ContractError):
        contracts.disjoint_and_whole([items, items.where("item_id = 2")], items, "item_id")
    with pytest.raises(contracts.ContractError):
        contracts.same_keys(items, items.where("item_id = 1"), ["item_id"])
    files.write_jsonl(items, str(tmp_path / "log"), "gzip")
    files.append_log(items, str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), items.schema).count() == 4
    (tmp_path / "d.json").write_text('{"a": {"b": 2}}', encoding="utf-8")
    assert files.read_json(spark, str(tmp_path / "d.json")).first().a.b == 2
    folder = tmp_path / "tree" / "deep"
    folder.mkdir(parents=True)
    (folder / "x.txt").write_text("one\ntwo", encoding="utf-8")
    assert [r.text for r in files.read_texts(spark, str(tmp_path / "tree")).collect()] == ["one\ntwo"]
    (tmp_path / "hashes").write_text("abc  deep/x.txt\n\n", encoding="utf-8")
    expected = files.read_hash_list(spark, str(tmp_path / "hashes"))
    assert [tuple(r) for r in expected.collect()] == [("abc", "deep/x.txt")]
    assert files.mismatches(expected, files.manifest(spark, str(tmp_path / "tree"))).count() == 1


def test_structures_and_run_manifest(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.jsonl").write_text('{"x": 1}\n\n[2]\n{broken\n', encoding="utf-8")
    (tmp_path / "b.json").write_text('[1,\n 2]', encoding="utf-8")
    found = {r.path.rsplit("/", 1)[1]: (r.records, r.damaged) for r in files.structures(spark, str(tmp_path)).collect()}
    assert found == {"a.jsonl": (3, 2), "b.json": (1, 0)}
    row = files.run_manifest(spark, {"t": spark.range(3)}, files.manifest(spark, str(tmp_path)), {"draws": 7}).first()
    assert row["rows"] == {"t": 3} and row.seeds == {"draws": 7} and len(row.sha256) == 2
