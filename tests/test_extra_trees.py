"""Trees grown over a table against trees grown row by row in plain Python, node by node."""

import numpy as np

from loamwork.operators import extra_trees as E


def table_of(seed=3, n=160):
    random = np.random.default_rng(seed)
    x = np.round(random.normal(size=(n, 6)), 3)
    x[:, 4] = 1.0  # never varies
    x[:, 5] = random.integers(0, 2, n)
    y = (x[:, 0] + 0.5 * x[:, 5] > 0.3).astype(int) + (x[:, 1] > 0.8)
    return x, y


def plain_tree(x, y, seed, tree, depth, least, share, weight, node=0):
    counts = [int((y == k).sum()) for k in range(3)]
    shares = np.array(counts) * weight
    leaf = {node: shares / shares.sum()}
    level = (node + 1).bit_length() - 1
    if level == depth or len(y) < 2 * least or sum(c > 0 for c in counts) < 2:
        return {}, leaf
    order, place = E.plan_of(seed, tree, node, x.shape[1])
    best, tried = None, 0
    for f in order.tolist():
        low, high = x[:, f].min(), x[:, f].max()
        if low == high or tried == max(1, int(share * x.shape[1])):
            continue
        tried += 1
        cut = low + place[f] * (high - low)
        cut = cut if cut < high else low
        left = x[:, f] <= cut
        if min(left.sum(), (~left).sum()) < least:
            continue
        gini = 0.0
        for side in (left, ~left):
            w = np.array([(y[side] == k).sum() for k in range(3)]) * weight
            gini += w.sum() * (1 - ((w / w.sum()) ** 2).sum())
        if best is None or gini < best[0] - 1e-7:
            best = (gini, f, cut, left)
    if best is None:
        return {}, leaf
    _, f, cut, left = best
    split, leaves = {node: (f, cut)}, {}
    for side, child in ((left, 2 * node + 1), (~left, 2 * node + 2)):
        s, v = plain_tree(x[side], y[side], seed, tree, depth, least, share, weight, child)
        split |= s
        leaves |= v
    return split, leaves


def test_trees_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(E, "TOGETHER", 2)
    x, y = table_of()
    labels = ("a", "b", "c", "never")
    rows = spark.createDataFrame([(i, v.tolist(), labels[k]) for i, (v, k) in enumerate(zip(x, y, strict=True))] + [(900, x[0].tolist(), "other")], "id long, features array<double>, label string").repartition(4)
    counts = np.bincount(y, minlength=3)
    weight = len(y) / (3 * counts)
    ready = rows.where("id < 900").selectExpr("features as x", "array_position(array('a', 'b', 'c'), label) - 1 as y")
    ready = ready.withColumn("y", ready.y.cast("int"))
    forest = E.grown(ready, 3, 6, 11, range(3), 4, 2, 0.5, weight)
    plain = [plain_tree(x, y, 11, t, 4, 2, 0.5, weight) for t in range(3)]
    for t, (split, leaves) in enumerate(plain):
        assert {k: (f, round(c, 9)) for k, (f, c) in forest[t].split.items()} == {k: (f, round(c, 9)) for k, (f, c) in split.items()} and len(split) > 3
        assert forest[t].leaf.keys() == leaves.keys() and all(np.allclose(forest[t].leaf[k], leaves[k]) for k in leaves)
    out = {r.id: r.probs for r in E.extra_trees(rows, rows, "label", labels, (11,), 3, 4).collect()}
    for i in range(0, len(x), 13):
        want = np.zeros(3)
        for split, leaves in plain:
            node = 0
            while node in split:
                node = 2 * node + 1 + int(x[i, split[node][0]] > split[node][1])
            want += leaves[node] / 3
        assert np.allclose(out[i], [*want, 0.0])
    assert sum(np.argmax(out[i]) == y[i] for i in range(len(x))) > len(x) / 2  # three shallow trees


def test_no_training_rows(spark):
    rows = spark.createDataFrame([(1, [1.0], "a")], "id long, features array<double>, label string")
    assert E.extra_trees(rows.limit(0), rows, "label", ("a",), trees=1).first().probs is None
    assert E.extra_trees(rows, rows, "label", ("a", "b"), (1,), 1, 2).first().probs == [1.0, 0.0]
