"""Split draws against exact distribution functions and plain sampling."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loamwork.operators import multinomial


def plain_binomial(k, units, left, u):
    """Exact, by fractions: the least x at which the distribution function exceeds u."""
    p, total = Fraction(units, left), Fraction(0)
    for x in range(k + 1):
        total += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > Fraction(u):
            return x
    return k


def test_binomials_are_exact():
    rng = random.Random(1)
    for _ in range(60):
        k, left = rng.choice([0, 1, 7, 60, 400]), rng.choice([3, 50, 997])
        units = rng.randrange(left + 1)
        u = np.array([rng.random() for _ in range(5)] + [2.0**-33, 1 - 2.0**-33])
        got = multinomial.binomial(np.full(len(u), k, np.int64), units / left, u)
        assert got.tolist() == [plain_binomial(k, units, left, x) for x in u.tolist()]


def test_large_numbers_of_draws():
    """A hundred million draws: mean and spread are the binomial's."""
    u = (np.arange(4000) + 0.5) / 4000
    got = multinomial.binomial(np.full(4000, 10**8, np.int64), 0.3, u)
    assert abs(got.mean() - 3e7) < 60 and abs(got.std() / math.sqrt(2.1e7) - 1) < 0.01


def test_log_factorials():
    x = np.array([0, 1, 2, 20, 255, 256, 1000, 10**6])
    assert np.allclose(multinomial.log_factorial(x), [math.lgamma(v + 1) for v in x.tolist()], rtol=1e-13)


@pytest.mark.parametrize("stratum", [None, "s"])
def test_cell_weights_against_a_plain_split(spark, stratum):
    rows = [("x", "a", 5), ("x", "b", 40), ("x", "c", 0), (None, "a", 1), (None, "d", 12)] if stratum else [(None, "a", 5), (None, "b", 40), (None, "c", 0), (None, "d", 13)]
    cells = spark.createDataFrame(rows, "s string, cell string, n long")
    got = {(r.replicate, r[1] if stratum else None, r.cell): r.weight for r in multinomial.cell_weights(cells, "cell", "n", 30, 7, stratum).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        listed = sorted((c, n) for t, c, n in rows if t == s and n)
        for replicate in range(30):
            left = draws = sum(n for _, n in listed)
            for c, n in listed:
                u = multinomial.uniforms(7, replicate, *([s] if stratum else []), c)
                x = plain_binomial(draws, n, left, u)
                draws, left = draws - x, left - n
                if x:
                    want[replicate, s, c] = x
    assert got == want


def test_too_many_cells_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(multinomial, "MOST_CELLS", 3)
    cells = spark.range(5).selectExpr("cast(id as string) as cell", "1L as n")
    with pytest.raises(ValueError, match="value_replicates"):
        multinomial.cell_weights(cells, "cell", "n", 2, 1)
    assert multinomial.cell_weights(cells.limit(0), "cell", "n", 2, 1).count() == 0


def test_value_replicates(spark, monkeypatch):
    """Every replicate draws as many rows as there are; means and their spread are those of sampling."""
    monkeypatch.setattr(multinomial, "RANGE", 300)
    rng = random.Random(3)
    values = [rng.gauss(10, 4) for _ in range(2000)]
    rows = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "k long, v double, one double").repartition(5)
    got = {r.replicate: r.estimate for r in multinomial.value_replicates(rows, "v", "k", 600, 5).collect()}
    again = {r.replicate: r.estimate for r in multinomial.value_replicates(rows.repartition(2), "v", "k", 600, 5).collect()}
    assert len(got) == 600 and all(abs(got[r] - again[r]) < 1e-9 for r in got)
    mean, spread = np.mean(values), np.std(values) / math.sqrt(len(values))
    assert abs(np.mean(list(got.values())) - mean) < 5 * spread / math.sqrt(600) and 0.85 < np.std(list(got.values())) / spread < 1.15
    ones = multinomial.value_replicates(rows, "one", "k", 20, 5).collect()
    assert all(abs(r.estimate - 1) < 1e-12 for r in ones) and multinomial.value_replicates(rows.limit(0), "v", "k", 3, 1).count() == 0
