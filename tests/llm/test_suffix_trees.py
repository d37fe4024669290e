"""Repeats within a block come from the nodes of its own subtrees; null ids are told from the least id."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loamwork.llm import substring_dedup


def packed(rows):
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "known": pa.array([True] * len(rows)), "text": pa.array([t for _, t in rows], pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(9)}" for _ in range(rng.choice([20, 21, 25, 60]))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [f"u{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i, " ".join(words)))
    return [*rows, (70, "same " * 90), (71, ""), (72, "x " * 19), (73, "same " * 21)]


def plain(rows):
    """Places, in words of the whole block, of the first and of the later windows of each sequence."""
    seen, first, later, base = set(), [], [], 0
    for _, text in rows:
        words = text.split()
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            (later if key in seen else first).append(base + k)
            seen.add(key)
        base += len(words)
    return first, later


@pytest.mark.parametrize("seed", range(5))
def test_leaves_of_a_block_against_brute_force(seed):
    rows = corpus(seed)
    first, later = substring_dedup.Block(packed(rows)).leaves()
    assert (first.tolist(), later.tolist()) == plain(rows) and len(later) > 100


def test_without_nodes_a_block_has_no_repeats(monkeypatch):
    """Nothing but the subtrees' nodes makes repeats."""
    real = substring_dedup.deep_nodes

    def no_nodes(words, size):
        at, node = real(words, size)
        return at, np.full(len(node), -1)

    monkeypatch.setattr(substring_dedup, "deep_nodes", no_nodes)
    assert len(substring_dedup.Block(packed(corpus(1))).leaves()[1]) == 0


def test_a_null_id_and_the_least_id(docs_of):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (-(1 << 63), text), (-(1 << 63), "short"), (5, text)]
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs_of(rows).coalesce(1)).collect()))
    assert out == [(False, 0, 30, 0), (True, -(1 << 63), 1, 0), (True, -(1 << 63), 30, 30), (True, 5, 30, 30)]
