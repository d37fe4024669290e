"""Codec, classifiers, decontamination and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loamwork.llm import decontamination, language_id, quality_classifier, registry, sentencepiece_codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lattice():
    return sentencepiece_codec.Lattice(sentencepiece_codec.load_vocabulary())


def every_path(lattice, segment, n):
    edges, out = lattice.edges(segment), []

    def walk(end, tail, score):
        if end == 0:
            out.append((score, tuple(reversed(tail))))
        for start, s, piece in edges[end] if end else ():
            walk(start, [*tail, piece], score + s)

    walk(len(segment), [], 0.0)
    return sorted(out, key=lambda x: -x[0])[:n]


def test_n_best_is_exact(lattice):
    random.seed(1)
    texts = ["".join(random.choice("abthe ing日▁é.\n😀") for _ in range(random.randint(0, 11))) for _ in range(120)] + ["", None, " ", "▁▁", "a  b   c"]
    _, _, ids, scores, others, same = (c.to_pylist() for c in sentencepiece_codec.encode_block(lattice, pa.array(texts, pa.string()), 4))
    assert all(same)
    for i, text in enumerate(texts):
        if not text:
            assert (ids[i] is None) == (text is None)
            continue
        best = every_path(lattice, b" " + text.encode(), 4)
        assert np.allclose([s for s, _ in best], scores[i])
        found = [ids[i], *(sentencepiece_codec.apply_edits(ids[i], e) for e in others[i])]
        assert len({tuple(x) for x in found}) == len(found) and all(lattice.decode(x).decode() == text for x in found)


def test_codec_round_trip(spark, docs_of):
    rows = [(1, "Hello  world\n▁x"), (2, None), (3, ""), (None, "é" * 3000), (1, "Hello  world\n▁x")]
    encoded = sentencepiece_codec.encode(docs_of(rows))
    back = sorted(((r.doc_id, r.text) for r in sentencepiece_codec.decode(encoded).collect()), key=str)
    assert back == sorted(rows, key=str)


def test_quality_classifier_held_out(spark):
    out = registry.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all() and out.score.between(0, 1).all()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9


def test_quality_classifier_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(docs_of([(1, None), (2, "")]), none).collect()
    assert [r.score for r in out] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs_of([(1, "abc"), (2, "abc")]), one).first().predicted == 1


def test_gradients_match_differences():
    random = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_id.initial(3, 4).items()}
    spans, target = random.integers(0, 256, (6, 5)), np.array([0, 1, 2, 1, 0])
    real = (np.arange(6)[:, None] < np.array([6, 4, 6, 1, 5])[None, :]).astype(np.float64)
    _, grads = language_id.gradients({k: v.astype(np.float32) for k, v in p.items()}, spans, real, target)
    for name in ("gates_f", "cand_b", "out_f", "bias"):
        at = tuple(random.integers(0, n) for n in p[name].shape)
        sides = []
        for step in (1e-2, -1e-2):
            q = {k: v.astype(np.float32) for k, v in p.items()}
            q[name][at] += step
            sides.append(language_id.gradients(q, spans, real, target)[0])
        assert abs((sides[0] - sides[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_language_id(spark, docs_of):
    out = registry.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = out[out.held_out].merge(docs, on="doc_id")
    assert (held.lang_pred == held.lang).mean() > 0.95 and out.score.between(0, 1).all()
    odd = language_id.predictions(docs_of([(1, None), (2, ""), (3, "12 -- !"), (4, "é")]), None, [])
    assert {r.lang_pred for r in odd.collect()} == {"und"}


def test_decontamination(spark, docs_of):
    item = "In the morning Anna bought 12 apples and then Anna sold 3 pears for 5 dollars and kept all of the rest"
    other = "In the morning Paul bought 40 apples and then Paul sold 7 pears for 9 dollars and kept all of the rest"
    mixed = other.replace("then Paul", "then Mary")
    benchmark = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "only four words here")], "item_id long, text string")
    rows = [(1, "Some words. " + item), (2, other), (3, mixed), (4, None), (5, ""), (6, "Nothing of it"), (7, "These are only four words here, you see"), (1, item)]
    out = {(r.doc_id, r.item_id): r for r in decontamination.matches(docs_of(rows), benchmark).collect()}
    assert not out[1, 1].reparameterised and out[2, 1].reparameterised and (7, 4) in out
    assert out[3, 1].covered < out[2, 1].covered  # windows where the name changes are no match
    assert {d for d, _ in out} == {1, 2, 3, 7}
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs_of(rows), benchmark, most=1).collect()} == set(out)
    assert decontamination.matches(docs_of(rows), benchmark.where("false")).count() == 0


def test_decontamination_of_names_at_sentence_starts_and_of_short_items(spark, docs_of):
    tom = "Tom has 5 apples. Tom buys 3 more. How many apples does he have now?"
    city, price = "What is the largest city of the northern island?", "the price of 1,250.75 dollars"
    benchmark = spark.createDataFrame([(1, tom), (2, city), (3, price)], "item_id long, text string")
    anna = tom.replace("Tom", "Anna").replace("5", "7").replace("3", "4")
    rows = [
        (1, anna), (2, "They said: " + anna), (3, tom.lower()), (4, anna.replace("Anna buys", "Mary buys")),
        (5, "so it goes on, " + city), (6, "so it goes on and " + city + " And more"), (7, "so it is. " + city), (8, city.lower()),
        (9, "the price of 99 dollars"), (10, "the price of 3.50 dollars"), (11, "Anna Has Many Apples And Paul Has None Of Them But Who Knows"),
    ]
    for most in (decontamination.BROADCAST_WINDOWS, 1):
        out = {(r.doc_id, r.item_id): r for r in decontamination.matches(docs_of(rows), benchmark, most=most).collect()}
        assert set(out) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 2), (9, 3), (10, 3)}
        assert out[4, 1].covered < out[1, 1].covered == 1  # its first window holds both names
        assert out[1, 1].reparameterised and not out[3, 1].reparameterised and out[5, 2].covered == out[9, 3].covered == 1


def test_decontamination_finds_planted_passages(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 12):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    want = {(d, k) for d, t in docs.items() for w in [words(t)] for i in range(len(w) - 12) for k in windows.get(tuple(w[i : i + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op10_decontamination"](spark, SF).collect()}
    assert want and got == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] == kept[4] > 0
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert len(rows) == kept[4] and all(r.round_trip for r in rows)
    plain = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(out).collect()} == plain
