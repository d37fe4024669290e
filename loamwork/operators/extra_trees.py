"""Extremely randomised trees, grown level by level over the whole training table.

At a node, features are tried in a random order until ``share`` of them have been found that vary in the node; each gets one cut
drawn between its least and greatest value there, and the cut with the purest sides (Gini) splits the node. Orders and
cuts come from generators seeded by (seed, tree, node), so trees depend on no partitioning.

A level takes two passes. The first gives each open node's class counts and its features' ranges, the second the class counts
left of every candidate cut. Tasks add up their rows before anything is shuffled. Trees are grown ``TOGETHER`` at a time;
the driver holds these, and of a level's sums at most one row a tree, open node and candidate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trees that are grown in one pair of passes a level.
TOGETHER = 40


@dataclass
class Tree:
    """Inner nodes by number (children of i are 2i + 1 and 2i + 2): feature and cut; leaves: class shares."""

    split: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaf: dict[int, list[float]] = field(default_factory=dict)

    def nodes(self, x: np.ndarray, open_: set[int] | None = None) -> np.ndarray:
        """The node each row ends in: a leaf, or one of ``open_``; rows that a finished tree's leaf holds give -1 if ``open_`` is given."""
        at = np.zeros(len(x), np.int64)
        top = max(self.split, default=-1)
        feature, cut = np.full(top + 2, -1), np.zeros(top + 2)
        for i, (f, c) in self.split.items():
            feature[i], cut[i] = f, c
        while True:
            inner = np.flatnonzero(feature[np.minimum(at, top + 1)] >= 0)
            if not len(inner):
                break
            i = at[inner]
            at[inner] = 2 * i + 1 + (x[inner, feature[i]] > cut[i])
        return at if open_ is None else np.where(np.isin(at, list(open_)), at, -1)


def plan_of(seed: int, tree: int, node: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a node tries its features and where in their ranges the cuts lie."""
    key = hashlib.sha256(f"{seed}|{tree}|{node}".encode()).hexdigest()[:32]
    u = np.random.Generator(np.random.Philox(int(key, 16))).random(2 * width)
    return np.argsort(u[:width], kind="stable"), u[width:]


def candidates(order: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, float]]:
    """(feature, cut) of the first ``most`` features in order that vary."""
    out = []
    for f in order[low[order] < high[order]][:most].tolist():
        cut = float(low[f] + place[f] * (high[f] - low[f]))
        out.append((f, cut if cut < high[f] else float(low[f])))
    return out


def purity(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of squared class weights over their sum: the greater over both sides, the less their Gini impurity."""
    w = counts * weight
    return (w**2).sum(axis=-1) / np.maximum(w.sum(axis=-1), 1e-300)


def best_cut(total: np.ndarray, left: np.ndarray, weight: np.ndarray, least: int) -> int:
    """Which candidate splits best, the first of equals; -1 if none leaves ``least`` rows on either side."""
    right = total - left
    fits = (left.sum(axis=1) >= least) & (right.sum(axis=1) >= least)
    score = np.where(fits, np.round(purity(left, weight) + purity(right, weight), 9), -1.0)
    return int(np.argmax(score)) if fits.any() else -1


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column("y").to_numpy()


def _ranges(trees: dict[int, Tree], open_: dict[int, set[int]], width: int, classes: int):
    """Rows (tree, node, numbers): class counts, then least and greatest values, of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            x, y = _arrays(batch, width)
            for t, tree in trees.items():
                at = tree.nodes(x, open_[t])
                for node in np.unique(at[at >= 0]).tolist():
                    rows = np.flatnonzero(at == node)
                    counts = np.bincount(y[rows], minlength=classes)
                    low, high = x[rows].min(axis=0), x[rows].max(axis=0)
                    if (t, node) in held:
                        c, a, b = held[t, node]
                        held[t, node] = [c + counts, np.minimum(a, low), np.maximum(b, high)]
                    else:
                        held[t, node] = [counts, low, high]
        keys = list(held)
        listed = lambda k, kind: pa.array([held[key][k].tolist() for key in keys], pa.list_(kind))
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), listed(0, pa.int64()), listed(1, pa.float64()), listed(2, pa.float64())], names=["tree", "node", "counts", "low", "high"])

    return run


def _lefts(trees: dict[int, Tree], cuts: dict[tuple[int, int], list[tuple[int, float]]], width: int, classes: int):
    """Rows (tree, node, lefts): class counts left of each candidate cut, of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        open_ = {t: {n for s, n in cuts if s == t} for t in trees}
        for batch in batches:
            x, y = _arrays(batch, width)
            for t, tree in trees.items():
                at = tree.nodes(x, open_[t])
                for node in np.unique(at[at >= 0]).tolist():
                    rows = np.flatnonzero(at == node)
                    features, values = zip(*cuts[t, node], strict=True)
                    left = x[np.ix_(rows, list(features))] <= np.array(values)
                    counts = np.stack([left[y[rows] == k].sum(axis=0) for k in range(classes)], axis=1)
                    held[t, node] = held.get((t, node), 0) + counts
        keys = list(held)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([held[k].ravel().tolist() for k in keys], pa.list_(pa.int64()))], names=["tree", "node", "lefts"])

    return run


def _summed(rows: DataFrame, sums: Sequence[str] = (), least: Sequence[str] = (), greatest: Sequence[str] = ()) -> list:
    """Tasks' arrays put together place by place, a row a (tree, node)."""
    long = rows.select("tree", "node", F.posexplode(F.arrays_zip(*sums, *least, *greatest)).alias("at", "v"))
    by_place = long.groupBy("tree", "node", "at").agg(*(F.sum(f"v.{c}").alias(c) for c in sums), *(F.min(f"v.{c}").alias(c) for c in least), *(F.max(f"v.{c}").alias(c) for c in greatest))
    names = [*sums, *least, *greatest]
    packed = F.sort_array(F.collect_list(F.struct("at", *names)))
    return by_place.groupBy("tree", "node").agg(packed.alias("p")).select("tree", "node", *(F.col(f"p.{c}").alias(c) for c in names)).collect()


def grown(train: DataFrame, classes: int, width: int, seed: int, trees: Sequence[int], depth: int, least: int, share: float, weight: np.ndarray) -> dict[int, Tree]:
    """``trees`` over ``train`` (x: array<double> of ``width``, y: class from 0)."""
    most = max(1, int(share * width))
    forest, open_ = {t: Tree() for t in trees}, {t: {0} for t in trees}
    for level in range(depth + 1):
        stats = _summed(train.mapInArrow(_ranges(forest, open_, width, classes), "tree int, node long, counts array<long>, low array<double>, high array<double>"), ["counts"], ["low"], ["high"])
        cuts, totals = {}, {}
        for r in stats:
            counts = np.array(r["counts"][:classes], np.int64)
            totals[r.tree, r.node] = counts
            if level < depth and counts.sum() >= 2 * least and (counts > 0).sum() > 1:
                order, place = plan_of(seed, r.tree, r.node, width)
                found = candidates(order, place, np.array(r["low"][:width]), np.array(r["high"][:width]), most)
                if found:
                    cuts[r.tree, r.node] = found
        chosen = {}
        if cuts:
            for r in _summed(train.mapInArrow(_lefts(forest, cuts, width, classes), "tree int, node long, lefts array<long>"), ["lefts"]):
                left = np.array(r["lefts"], np.int64).reshape(-1, classes)
                best = best_cut(totals[r.tree, r.node], left, weight, least)
                if best >= 0:
                    chosen[r.tree, r.node] = cuts[r.tree, r.node][best]
        open_ = {t: set() for t in trees}
        for (t, node), counts in totals.items():
            if (t, node) in chosen:
                forest[t].split[node] = chosen[t, node]
                open_[t] |= {2 * node + 1, 2 * node + 2}
            else:
                w = counts * weight
                forest[t].leaf[node] = (w / w.sum()).tolist()
        if not any(open_.values()):
            break
    return forest


def extra_trees(train: DataFrame, rows: DataFrame, label: str, labels: Sequence[str], seeds: Sequence[int] = (11, 23, 37, 53, 71), trees: int = 600, depth: int = 8, least: int = 2, share: float = 0.5, balanced: bool = True, features: str = "features") -> DataFrame:
    """``rows`` with ``probs``: the mean over seeds and trees of the class shares of a row's leaves.

    ``features``: an array of numbers, as many in every row, without nulls. ``balanced``: classes weigh the same in sum;
    labels that do not occur have probability 0. Rows of ``train`` with other labels are left out. ``train`` is read twice a
    level and ``TOGETHER`` trees, so store it first where it is costly. Without training rows ``probs`` is null.
    """
    index = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
    ready = train.select(F.col(features).cast("array<double>").alias("x"), index.alias("y")).where("y >= 0")
    shape = ready.groupBy("y").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).collect()
    if not shape:
        return rows.withColumn("probs", F.lit(None).cast("array<double>"))
    width, classes = max(r.width for r in shape), len(labels)
    weight = np.ones(classes)
    if balanced:
        for r in shape:
            weight[r.y] = sum(s.n for s in shape) / (len(shape) * r.n)
    forest = []
    for seed in seeds:
        for a in range(0, trees, TOGETHER):
            forest += grown(ready, classes, width, seed, range(a, min(a + TOGETHER, trees)), depth, least, share, weight).values()
    held = rows.sparkSession.sparkContext.broadcast(forest)  # at most 2 ** depth leaves a tree

    @F.pandas_udf("array<double>")
    def mean(x):
        values = np.array(x.tolist(), float).reshape(len(x), -1)
        total = np.zeros((len(values), classes))
        for tree in held.value:
            leaves = tree.nodes(values)
            names, at = np.unique(leaves, return_inverse=True)
            total += np.array([tree.leaf[n] for n in names.tolist()])[at]
        import pandas as pd

        return pd.Series((total / len(held.value)).tolist())

    return rows.withColumn("probs", mean(F.col(features).cast("array<double>")))
