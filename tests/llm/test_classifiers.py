"""Bounds of the samples, plain versions of scores, and odd tables, for both classifiers."""

import random
import zlib

import numpy as np

from loamwork.llm import language_id, quality_classifier


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_samples_are_bounded_whatever_repeats(spark, docs_of):
    rows = [(i % 8, f"text number {j} of id {i % 8} and some more") for i in range(160) for j in (i // 40, i // 40)]
    docs, labels = docs_of(rows), labelled(spark, [(i % 8, i % 2, 0) for i in range(400)])
    for limit in (1, 5, 1000):
        found, marks = quality_classifier.training_rows(docs, labels, limit)
        assert len(found) == len(marks) <= limit
        spans = language_id.training_spans(docs, limit)
        assert len(spans[0]) <= limit  # each text is shorter than a span
        assert len(language_id.training_spans(docs, limit, 3)[0]) <= 3
    kept = [i for i in range(8) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(found) == 4 * len(kept)  # four different texts an id, one label each


def plain_margin(model, text):
    raw = (text or "").encode()
    codes = {((((raw[i] << 16) | (raw[i + 1] << 8) | raw[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)}
    square = sum(float(np.float32(model.square[c])) for c in codes)
    return sum(float(np.float32(model.weight[c])) for c in codes) / (square**0.5 or 1.0) + model.bias


def test_scores_are_those_of_a_plain_version(spark, docs_of):
    random.seed(4)
    good, bad = "the house of the river and a garden".split(), "zx!! qq## vv%% buy9 win7".split()
    rows = [(i, " ".join(random.choice(good if i % 2 else bad) for _ in range(random.randint(3, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "ab"), (503, "the " * 200_000)]
    docs, labels = docs_of(rows), labelled(spark, [(i, i % 2, 0) for i in range(120)])
    model = quality_classifier.trained_model(docs, labels)
    out = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    for i, text in rows:
        p = 1 / (1 + np.exp(-np.clip(model.slope * plain_margin(model, text) + model.offset, -30, 30)))
        assert abs(out[i].score - p) < 1e-4 and out[i].predicted == int(out[i].score >= 0.7), i
    assert all(out[i].predicted == i % 2 for i in range(120))


def plain_forward(p, raw):
    """Class probabilities at every byte of one text, byte by byte."""
    hidden = p["cand_f"].shape[0]
    sig = lambda x: 1 / (1 + np.exp(-x))
    out = []
    for a in range(0, len(raw), language_id.SPAN):
        part, h = raw[a : a + language_id.SPAN], {}
        for d in "fb":
            state, seen = np.zeros(hidden), []
            for b in part if d == "f" else part[::-1]:
                x = p[f"in_{d}"][b].astype(float)
                gates = sig(x[: 2 * hidden] + state @ p[f"gates_{d}"])
                cand = np.tanh(x[2 * hidden :] + (gates[hidden:] * state) @ p[f"cand_{d}"])
                state = state + gates[:hidden] * (cand - state)
                seen.append(state)
            h[d] = seen if d == "f" else seen[::-1]
        for f, b in zip(h["f"], h["b"], strict=True):
            z = f @ p["out_f"] + b @ p["out_b"] + p["bias"]
            e = np.exp(z - z.max())
            out.append(e / e.sum())
    return np.array(out)


def test_predictions_are_those_of_a_plain_network(docs_of):
    random.seed(6)
    p, names = language_id.initial(3, 8), ["aa", "bb", "cc"]
    rows = [(i, "".join(random.choice("abc dé€x") for _ in range(random.choice([1, 5, 95, 96, 97, 300])))) for i in range(30)] + [(90, "y" * 200_000)]
    out = {r.doc_id: r for r in language_id.predictions(docs_of(rows), p, names).collect()}
    for i, text in rows[:-1]:
        if not language_id.has_letter(text):
            assert out[i].lang_pred == "und"
            continue
        mean = plain_forward(p, text.encode()).mean(axis=0)
        assert abs(out[i].score - mean.max()) < 1e-3 and out[i].lang_pred == names[int(mean.argmax())], i
    assert out[90].lang_pred in names


def test_odd_tables(spark, docs_of):
    docs = docs_of([(1, "some words here"), (1, "some words here"), (None, "no id"), (2, None), (3, ""), (4, "12 --")])
    for name in ("key", "bits", "nth", "span", "quality", "score"):
        docs = docs.withColumn(name, docs.lang)
    labels = labelled(spark, [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)])
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert quality_classifier.classify(docs_of([]), labels).count() == 0
    langs = language_id.identify(docs).collect()
    assert len(langs) == 6 and {r.lang_pred for r in langs if r.doc_id in (2, 3, 4)} == {"und"}
    assert language_id.identify(docs_of([])).count() == 0


def test_spans_are_drawn_from_all_of_a_long_text(docs_of):
    """No part of a training text is left out: spans are numbered over the whole of it and drawn by their hashes."""
    long = "".join(chr(97 + i % 26) for i in range(960_000))
    a, b = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    spans, lengths, _, names = language_id.training_spans(docs_of([(a, long), (b, "short text")]), spans_limit=2000)
    assert len(spans) == 2000 and names == ["en"] and (lengths <= language_id.SPAN).all()
    first = {(s[0] - 97) % 26 for s in spans if s[0] >= 97}
    assert len(first) == 13  # 96 letters on, a span begins an even number of letters further: all starts occur


def test_language_of_a_long_text_is_that_of_its_bulk(spark):
    rows = [(i, text * 6, lang) for i in range(60) for text, lang in (("the river and the house of stone ", "en"), ("der fluss und das haus aus stein ", "de"))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(900, "der fluss und das haus aus stein " * 60_000, None), (901, "x" * 500_000, None), (902, "1" * 300_000, None), (902, "1" * 300_000, None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert out[900].lang_pred == "de" and out[901].lang_pred in ("de", "en") and out[902].lang_pred == "und" and out[902].score == 0


def test_quality_of_long_and_unbroken_texts(spark, docs_of):
    good, bad = "the house of the river and a garden ", "zx!! qq## vv%% buy9 win7 "
    rows = [(i, (good if i % 2 else bad) * 5) for i in range(80)] + [(900, good * 50_000), (901, bad * 80_000), (902, "a" * 3_000_000)]
    out = {r.doc_id: r for r in quality_classifier.classify(docs_of(rows), labelled(spark, [(i, i % 2, 0) for i in range(80)])).collect()}
    assert out[900].predicted == 1 and out[901].predicted == 0 and 0 <= out[902].score <= 1 and len(out) == len(rows)
