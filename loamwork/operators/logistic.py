"""Balanced logistic regression, one label against the rest, by a trust-region Newton method over the whole table.

The problem is ``min 0.5 |w|^2 + c * sum_i k_i ln(1 + exp(-y_i w.x_i))`` with the intercept as a feature that is always 1 and
is penalised like any other, and weights ``k_i`` by which both classes of a label weigh the same in sum.

The Hessian is never formed: conjugate gradients ask for its products with vectors, and each product, like each value
with its gradient, is a sum over rows that tasks add up before anything is shuffled. The labels' solvers run side by side,
and what all of them ask for is answered in one pass. The driver holds a few vectors a label.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.sources.staging import staged

Request = tuple[str, np.ndarray, np.ndarray | None]
#: Steps, products a step, and by how much the gradient's length is to fall.
STEPS, PRODUCTS, FALL = 100, 250, 1e-9


def newton(dim: int) -> Generator[Request, tuple, np.ndarray]:
    """Asks for ("value", w, None), answered by value and gradient, and ("product", w, v), answered by a vector; returns the solution."""
    w = np.zeros(dim)
    value, gradient = yield "value", w, None
    first = reach = np.linalg.norm(gradient)
    for _ in range(STEPS):
        length = np.linalg.norm(gradient)
        if length <= FALL * first:
            break
        step, rest = np.zeros(dim), -gradient
        way, square = rest.copy(), rest @ rest
        for _ in range(PRODUCTS):
            if np.sqrt(square) <= min(0.1, np.sqrt(length / first)) * length:
                break
            (product,) = yield "product", w, way
            far = square / (way @ product)
            if np.linalg.norm(step + far * way) > reach:  # to the border of the trusted region, and no further
                a, b, c = way @ way, step @ way, step @ step - reach * reach
                far = (np.sqrt(b * b - a * c) - b) / a
                step, rest = step + far * way, rest - far * product
                break
            step, rest = step + far * way, rest - far * product
            before, square = square, rest @ rest
            way = rest + square / before * way
        there, slope = yield "value", w + step, None
        promised, got = -0.5 * (gradient @ step - step @ rest), value - there
        size = np.linalg.norm(step)
        if promised <= 1e-14 * abs(value) or abs(got) <= 1e-15 * abs(value):  # no more than rounding is left
            return w + step if np.linalg.norm(slope) < length else w
        reach = 0.25 * min(size, reach) if got < 0.25 * promised else max(reach, 2.5 * size) if got > 0.75 * promised else reach
        if got > 1e-4 * promised:
            w, value, gradient = w + step, there, slope
    return w


def _pass(rows: DataFrame, asked: list[tuple[int, Request]], counts: np.ndarray, c: float, dim: int) -> list[tuple]:
    """The answers to (label, request) from one read of ``rows`` (y, at, x)."""
    total = counts.sum()
    weights = [(total / (2 * counts[k]), total / (2 * (total - counts[k]))) for k, _ in asked]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(asked), dim + 1))  # the value at the end
        for batch in batches:
            y = batch.column("y").to_numpy()
            sizes = batch.column("at").value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at, x = batch.column("at").flatten().to_numpy(), batch.column("x").flatten().to_numpy(zero_copy_only=False)
            dot = lambda v: np.bincount(row, x * v[at], batch.num_rows) + v[-1]  # noqa: B023, E731
            for n, ((k, (kind, w, v)), (mine, other)) in enumerate(zip(asked, weights, strict=True)):
                sign = np.where(y == k, 1.0, -1.0)
                weight, z = np.where(y == k, mine, other), sign * dot(w)
                p = 1 / (1 + np.exp(np.minimum(z, 700)))  # of being wrong
                if kind == "value":
                    sums[n, -1] += (weight * np.logaddexp(0, -z)).sum()
                    part = -weight * sign * p
                else:
                    part = weight * p * (1 - p) * dot(v)
                sums[n, : dim - 1] += np.bincount(at, x * part[row], dim - 1)[: dim - 1]
                sums[n, dim - 1] += part.sum()
        n, i = np.nonzero(sums)
        yield pa.record_batch([pa.array(n.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(sums[n, i])], names=["n", "i", "v"])

    sums = np.zeros((len(asked), dim + 1))
    found = rows.mapInArrow(added, "n int, i int, v double").groupBy("n", "i").agg(F.sum("v").alias("v")).toPandas()
    sums[found["n"], found["i"]] = found["v"]
    out = []
    for (_, (kind, w, v)), s in zip(asked, sums, strict=True):
        out.append((0.5 * w @ w + c * s[-1], w + c * s[:-1]) if kind == "value" else (v + c * s[:-1],))
    return out


def fitted(train: DataFrame, label: str, labels: Sequence[str], c: float = 1.0, at: str = "at", x: str = "x", passes: list[int] | None = None) -> np.ndarray:
    """Coefficients, a row a label and the intercept last.

    ``at``, ``x``: the places (from 0) and values of a row's features, no place twice. Rows with another label or null features are left
    out. A label without rows, or with all of them, keeps coefficients of 0. ``passes`` gets the number of requests of each pass.
    """
    index = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
    rows = staged(train.select(index.alias("y"), F.col(at).cast("array<int>").alias("at"), F.col(x).cast("array<double>").alias("x")).where("y >= 0 and at is not null and x is not null"), "logistic-rows")
    shape = rows.groupBy("y").agg(F.count("*").alias("n"), F.max(F.array_max("at")).alias("top")).collect()
    dim = 2 + max((r.top for r in shape if r.top is not None), default=-1)
    counts, out = np.zeros(len(labels)), np.zeros((len(labels), dim))
    for r in shape:
        counts[r.y] = r.n
    solvers = {k: newton(dim) for k in range(len(labels)) if 0 < counts[k] < counts.sum()}
    asked = {k: next(s) for k, s in solvers.items()}
    while asked:
        keys = list(asked)
        if passes is not None:
            passes.append(len(keys))
        for k, answer in zip(keys, _pass(rows, [(k, asked[k]) for k in keys], counts, c, dim), strict=True):
            try:
                asked[k] = solvers[k].send(answer)
            except StopIteration as end:
                out[k] = end.value
                del asked[k]
    return out


def probabilities(rows: DataFrame, coefficients: np.ndarray, at: str = "at", x: str = "x") -> DataFrame:
    """``rows`` with ``probs``: each label's probability against the rest, brought to sum one; places beyond the coefficients count as 0."""
    held = rows.sparkSession.sparkContext.broadcast(coefficients)  # a row a label

    @F.pandas_udf("array<double>")
    def probs(places, values):
        import pandas as pd

        w, out = held.value, []
        for p, v in zip(places, values, strict=True):
            known = np.asarray(p) < w.shape[1] - 1
            z = w[:, -1] + (w[:, np.asarray(p)[known]] * np.asarray(v)[known]).sum(axis=1) if len(p) else w[:, -1]
            q = 1 / (1 + np.exp(-z))
            out.append((q / q.sum()).tolist())
        return pd.Series(out)

    return rows.withColumn("probs", probs(F.col(at).cast("array<int>"), F.col(x).cast("array<double>")))
