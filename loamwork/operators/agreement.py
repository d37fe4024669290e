"""Two raters and an adjudicator: agreement, kappa, intervals, final labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def kappa(rows: DataFrame, first: str, second: str, by: Sequence[str] = (), degenerate: float | None = 1.0) -> DataFrame:
    """n, observed and expected agreement and Cohen's kappa, in all and by group, from counts of label pairs.

    With ``by`` each set of names is its own grouping, and so is the whole table. Expected agreement 1 gives
    ``degenerate``.
    """
    cells = rows.groupBy(*by, first, second).count()
    group = [F.coalesce(F.col(b).cast("string"), F.lit("?")).alias(b) for b in by]
    whole = [F.lit(None).cast("string").alias(b) for b in by]
    every = cells.select(*group, first, second, "count", F.lit(False).alias("in_all"))
    if by:
        every = every.unionByName(cells.select(*whole, first, second, "count", F.lit(True).alias("in_all")))
    sides = F.explode(F.array(F.struct(F.col(first).alias("label"), F.col("count").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col(second).alias("label"), F.lit(0).cast("long").alias("a"), F.col("count").alias("b"))))
    same = F.when((F.col(first) == F.col(second)) & (F.col("s.a") > 0), F.col("count")).otherwise(0)
    margins = every.select("*", sides.alias("s")).groupBy(*by, "in_all", "s.label").agg(F.sum("s.a").alias("a"), F.sum("s.b").alias("b"), F.sum(same).alias("same"))
    sums = margins.groupBy(*by, "in_all").agg(F.sum("a").alias("n"), F.sum("same").alias("same"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    observed, expected = F.col("same") / F.col("n"), F.col("ab") / F.col("n") / F.col("n")
    value = F.when(F.col("ab") == F.col("n") * F.col("n"), F.lit(degenerate).cast("double")).otherwise((observed - expected) / (1 - expected))
    return sums.select(*by, "n", observed.alias("observed"), expected.alias("expected"), value.alias("kappa"))


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """(low, high) of the Wilson interval; null for n = 0."""
    k, m = successes.cast("double"), n.cast("double")
    p = F.try_divide(k, m)
    scale = 1 + F.try_divide(F.lit(z * z), m)
    centre = (p + F.try_divide(F.lit(z * z), 2 * m)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z), 4 * m * m)) / scale
    return F.struct(F.greatest(centre - half, F.lit(0.0)).alias("low"), F.least(centre + half, F.lit(1.0)).alias("high"))


def adjudicated(rows: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """``rows`` with ``final`` and ``final_source``: the raters' label where they agree, else the adjudicator's.

    A disagreement without a third label is an error, as is a missing rating.
    """
    a, b, c = F.col(first), F.col(second), F.col(third)
    missing = F.raise_error(F.lit("missing rating or adjudication"))
    final = F.when(a.isNull() | b.isNull(), missing).when(a == b, a).when(c.isNotNull(), c).otherwise(missing)
    return rows.withColumn("final", final).withColumn("final_source", F.when(a == b, "agreement").otherwise("adjudication"))


def matched(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """One-to-one join of two raters; a key that one side lacks is an error."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), list(key), "full_outer")
    whole = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("ids of the two sides differ"))
    return both.where(whole.isNull()).drop("_l", "_r")
