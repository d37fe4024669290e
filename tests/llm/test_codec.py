"""Codec: long unbroken segments, one form against the other, odd tables."""

import random
import time

import pyarrow as pa

from loamwork.llm import sentencepiece_codec


def test_segments_alone_and_together_agree(monkeypatch):
    lattice = sentencepiece_codec.Lattice(sentencepiece_codec.load_vocabulary())
    random.seed(2)
    texts = ["".join(random.choice("abthe ing日▁é.\n😀-") for _ in range(random.randint(0, 60))) for _ in range(200)] + ["", None, " ", "a" * 300]
    together = [c.to_pylist() for c in sentencepiece_codec.encode_block(lattice, pa.array(texts, pa.string()), 4)]
    monkeypatch.setattr(sentencepiece_codec, "LONG", 0)
    alone = [c.to_pylist() for c in sentencepiece_codec.encode_block(lattice, pa.array(texts, pa.string()), 4)]
    for k in (0, 1, 2, 3, 5):
        assert together[k] == alone[k], k


def test_long_unbroken_texts_take_time_in_proportion():
    lattice = sentencepiece_codec.Lattice(sentencepiece_codec.load_vocabulary())
    for text in ("a", "-", "ab", "日", " "):
        took = []
        for n in (10_000, 160_000):
            began = time.time()
            _, score, ids, best, others, same = (c.to_pylist()[0] for c in sentencepiece_codec.encode_block(lattice, pa.array([text * n]), 4))
            took.append(time.time() - began)
            assert same and best == sorted(best, reverse=True) and best[0] == score
            assert all(lattice.decode(sentencepiece_codec.apply_edits(ids, e)).decode() == text * n for e in others)
        assert took[1] < 40 * took[0] + 2, text


def test_odd_tables(docs_of):
    rows = [(None, "x"), (1, "same text"), (1, "same text"), (2, None), (3, ""), (4, "y" * 20_000)]
    docs = docs_of(rows)
    for name in ("ids", "score", "n_pieces"):
        docs = docs.withColumn(name, docs.lang)
    encoded = sentencepiece_codec.encode(docs)
    assert sorted(((r.doc_id, r.text) for r in sentencepiece_codec.decode(encoded).collect()), key=str) == sorted(rows, key=str)
    assert sentencepiece_codec.encode(docs_of([])).count() == 0
