"""Coefficients against a plain Newton solver on the same problem."""

import numpy as np

from loamwork.operators import logistic

LABELS = ("a", "b", "c", "never")


def table_of(n=220, d=7, seed=2):
    random = np.random.default_rng(seed)
    x = np.where(random.random((n, d)) < 0.6, random.normal(size=(n, d)).round(3), 0.0)
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * random.normal(size=n) > 0.2).astype(int) + (x[:, 2] > 1)
    return x, y


def plain(x, y, k, c):
    one = np.column_stack([x, np.ones(len(x))])
    sign, n = np.where(y == k, 1.0, -1.0), len(y)
    weight = np.where(y == k, n / (2 * (y == k).sum()), n / (2 * (y != k).sum()))
    w = np.zeros(one.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(sign * (one @ w)))
        gradient = w - c * one.T @ (weight * sign * p)
        w = w - np.linalg.solve(np.eye(len(w)) + c * (one.T * (weight * p * (1 - p))) @ one, gradient)
    return w


def test_coefficients_equal_a_plain_solver(spark):
    x, y = table_of()
    rows = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist(), LABELS[k]) for i, (v, k) in enumerate(zip(x, y, strict=True))] + [(900, [0], [1.0], "other"), (901, None, None, "a")]
    df = spark.createDataFrame(rows, "id long, at array<int>, x array<double>, label string").repartition(3)
    passes = []
    got = logistic.fitted(df, "label", LABELS, 2.0, passes=passes)
    for k in range(3):
        assert np.abs(got[k] - plain(x, y, k, 2.0)).max() < 1e-6
    assert not got[3].any() and max(passes) == 3 and len(passes) < 150
    out = {r.id: r.probs for r in logistic.probabilities(df.where("at is not null"), got).collect()}
    for i in range(0, 220, 17):
        q = 1 / (1 + np.exp(-(got[:, :-1] @ x[i] + got[:, -1])))
        assert np.allclose(out[i], q / q.sum())


def test_a_single_label_has_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, [0], [1.0], "a"), (2, [], [], "a")], "id long, at array<int>, x array<double>, label string")
    assert not logistic.fitted(df, "label", ("a", "b")).any() and not logistic.fitted(df.limit(0), "label", ("a", "b")).any()
