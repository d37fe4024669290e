"""Very long texts, empty tables, repeated rows and clashing columns for the rule table and the similarity join."""

import time

from loamwork.llm import jaccard_join, quality_rules

LONG = {
    1: "a" * 1_000_000, 2: "word " * 200_000, 3: " ".join(f"w{i}" for i in range(150_000)), 4: "\n".join(["same line here"] * 60_000), 5: "# " * 300_000, 6: " " * 1_000_000, 7: "é😀 " * 100_000,
}


def clashing(docs, *names):
    for name in names:
        docs = docs.withColumn(name, docs.lang)
    return docs


def test_quality_rules_of_long_texts(docs_of):
    began = time.time()
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs_of(list(LONG.items()))).collect()}
    assert time.time() - began < 120
    assert out[1].n_words == 1 and out[2].n_repeat_words == out[2].n_words == 200_000 and out[3].n_repeat_words == 0
    assert out[4].n_dup_lines == 59_999 and out[4].n_repeat_words == 180_000 and out[5].n_symbols == 300_000 and out[6].n_words == 0 and out[7].word_chars == 200_000


def test_quality_rules_of_odd_tables(docs_of):
    rows = [(1, "the same text of some words " * 3), (1, "the same text of some words " * 3), (None, None), (2, "")]
    docs = clashing(docs_of(rows), "n_words", "_t", "_w", "_h", "_s", "_p", "broken", "kept", "_l", "_c")
    out = quality_rules.apply_rules(docs).collect()
    assert len(out) == 4 and len({(r.n_words, r.n_repeat_words) for r in out if r.doc_id == 1}) == 1
    assert all(r.base_failed and not r.kept for r in out if r.doc_id != 1)
    assert quality_rules.apply_rules(docs_of([])).count() == 0


def test_similarity_classes_of_long_and_odd_texts(docs_of):
    rows = [*LONG.items(), (11, LONG[3] + " end"), (12, LONG[1]), (None, LONG[4]), (13, None), (13, None), (14, "")]
    docs = clashing(docs_of(rows), "key", "rid", "class_id", "n_links", "marks", "label", "component", "copies")
    out = sorted(((r.doc_id or 0), r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs).collect())
    assert [x for x in out if x[0] in (3, 11)] == [(3, 3, 1), (11, 3, 1)]
    assert [x for x in out if x[0] in (1, 12)] == [(1, 1, 1), (12, 1, 1)]
    assert [x for x in out if x[0] in (13, 14)] == [(13, 13, 0), (13, 13, 0), (14, 14, 0)]
    assert (4, None, 1) in out and (0, None, 1) in out
    assert jaccard_join.similarity_classes(docs_of([])).count() == 0 and jaccard_join.one_of_each(docs_of([])).count() == 0
