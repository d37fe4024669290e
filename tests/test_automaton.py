"""Lexicon places by the automaton against plain search: nested entries, long texts, other planes, split lexicons."""

import random

import numpy as np
import pytest

from loamwork.operators import automaton, spans


def plain(texts, entries):
    out = []
    for row, text in enumerate(texts):
        for e in entries:
            at = (text or "").find(e)
            while at >= 0:
                out.append((row, at + len(e), e))
                at = text.find(e, at + 1)
    return sorted(out)


def corpus(seed, alphabet="abc😀数"):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices(alphabet, k=n))
    entries = sorted({word(rng.choice([1, 2, 3, 5, 9])) for _ in range(60)} | {"aaaa", "a" * 30})
    texts = [word(rng.randrange(60)) for _ in range(80)] + [None, "", "a" * 3000, word(5000)]
    return texts, entries


@pytest.mark.parametrize("seed", range(4))
def test_places_equal_plain_search(seed):
    texts, entries = corpus(seed)
    a = automaton.Automaton(entries)
    row, end, entry = a.places(texts)
    assert sorted(zip(row.tolist(), end.tolist(), (entries[e] for e in entry), strict=True)) == plain(texts, entries)


def test_no_entries_and_an_entry_longer_than_a_piece():
    assert len(automaton.Automaton([]).places(["abc"])[0]) == 0
    long = "xy" * 700
    a = automaton.Automaton([long, "yx"])
    row, end, entry = a.places(["zz" + long + "q" + long, "x"])
    assert sorted(end[entry == 0].tolist()) == [1402, 2803] and (entry == 1).sum() == 2 * 699


def test_time_does_not_depend_on_the_number_of_lengths():
    """The states visited are the text's characters, not those times the entries' lengths."""
    text = "".join(random.Random(1).choices("abcdef", k=20_000))
    steps = []
    for lengths in ([6], range(2, 40)):
        a = automaton.Automaton(sorted({text[i : i + n] for n in lengths for i in range(0, 3000, 97)}))
        count = 0
        step = a.step

        def counted(state, char, step=step):
            nonlocal count
            count += len(state)
            return step(state, char)

        a.step = counted
        a.places([text])
        steps.append(count)
    assert steps[1] < 1.2 * steps[0]


@pytest.mark.parametrize("most", [100_000, 7])
def test_occurrences_of_whole_and_split_lexicons(spark, most):
    texts, entries = corpus(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string").repartition(3)
    words = spark.createDataFrame([(e, "L" + str(len(e)), i) for i, e in enumerate(entries)] + [(entries[0], "other", 5), ("", "empty", 1), (None, "null", 1)], "text string, label string, n long")
    out = spans.occurrences(docs, words, most=most).collect()
    assert {(r.record_id, r.start, r.end, r.text) for r in out} == {(row, end - len(e), end, e) for row, end, e in plain(texts, entries)}
    assert len(out) == sum(2 if e == entries[0] else 1 for _, _, e in plain(texts, entries))
    assert spans.occurrences(docs, words.where("n < 0"), most=most).count() == 0
    assert np.all([r.label == "other" or r.label == f"L{len(r.text)}" for r in out])
