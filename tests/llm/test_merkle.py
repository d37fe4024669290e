"""The manifest against a plain tree, with a hot group, groups of one leaf, nulls, copies and several superblocks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loamwork.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fanout):
    """The root, and each node's runs on the way up as (digests, place)."""
    ways, row, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(row) > 1:
        above, above_owners = [], []
        for a in range(0, len(row), fanout):
            run = row[a : a + fanout]
            for k, owner in enumerate(owners[a : a + fanout]):
                for i in owner:
                    ways[i].append((run, k))
            above.append(h(*run))
            above_owners.append([i for owner in owners[a : a + fanout] for i in owner])
        row, owners = above, above_owners
    return (row[0] if row else None), ways


def plain(rows, fanout):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    root, upper = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, upper, strict=True):
        for (_, _, leaf, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            way = way + up
            proof = "".join(d for run, k in way for j, d in enumerate(run) if j != k)
            doc_id, source, lang, n_chars, text = r
            changed = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
            node = plain_leaf(doc_id, source, lang, n_chars, changed)
            for run, k in way:
                node = h(*run[:k], node, *run[k + 1 :])
            out.append((doc_id, leaf, trees[g][0], root, h(proof), node, node == root))
    return out


def documents(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["é", "a", "Z", "", None])
        text = rng.choice([None, "", "plain", "two\nlines\n", "ü\n" * (i % 9), "\n"])
        rows.append((i - 20, source, rng.choice(["en", None]), None if i % 11 == 0 else len(text or ""), text))
    return rows + [(1, "lone", "en", 3, "a\nb"), (7, "hot", "en", 1, "x"), (7, "hot", "en", 1, "x"), (None, "hot", "en", 2, "q\n"), (None, None, None, None, None)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10, 400])
def test_query_against_a_plain_tree(spark, tmp_path, n):
    rows = documents(n) if n > 3 else documents(40)[-n:] if n else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("group", "idx", "node", "_part", "top", "block", "_s", "_nth"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs.repartition(5, "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain(rows, 3), key=key)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 2), (4, 3)])
def test_superblocks_of_any_size_give_the_same_tree(spark, fanout, levels):
    """Small superblocks need several rounds; what comes out doesn't depend on them."""
    rows = documents(300)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    out = merkle.manifest(docs, F.col("source"), [F.col("doc_id")], merkle.leaf(*(F.col(f) for f in merkle.FIELDS)), fanout, levels, doc_id=F.col("doc_id"), other=F.lit(None))
    got = merkle.checked(out, "other").collect()
    want = plain(rows, fanout)
    assert sorted(r.proof_sha256 for r in got) == sorted(w[4] for w in want)
    assert {(r.subroot, r.root) for r in got} == {(w[2], w[3]) for w in want} and all(r.verified for r in got)
    idx = {}
    for r in got:
        idx.setdefault(r.group, []).append(r.idx)
    assert all(sorted(v) == list(range(len(v))) for v in idx.values()) and set(idx) == {r[1] for r in rows}


def test_a_very_long_text_and_a_fanout_out_of_range(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3_000_000, "ab\n" * 1_000_000)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.manifest(docs, F.col("source"), [F.col("doc_id")], merkle.leaf(*(F.col(f) for f in merkle.FIELDS))).first()
    assert row.root == row.subroot == row.node == plain_leaf(1, "s", "en", 3_000_000, "ab\n" * 1_000_000) and bytes(row.siblings) == b""
    with pytest.raises(ValueError, match="fanout"):
        merkle.manifest(docs, F.col("source"), [F.col("doc_id")], F.lit("x"), fanout=1)
