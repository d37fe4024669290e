"""Crossover study: pairs, t statistics, variance analysis, reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import distributions as D


def duration(raw: Column, start: Column, end: Column) -> Column:
    """Seconds: the stated value, else the timestamps' difference."""
    return F.coalesce(raw.cast("double"), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)


def row_total(flag: Column, scores: Sequence[Column]) -> Column:
    """Sum of scores, null if the row is flagged or one is missing."""
    return F.when(F.upper(F.coalesce(flag, F.lit(""))) == "Y", F.lit(None).cast("double")).otherwise(sum(scores[1:], scores[0]).cast("double"))


def weighted_rating(ratings: Sequence[Column], weights: Sequence[Column]) -> Column:
    """Weighted mean of ratings, null for zero weight."""
    return F.try_divide(sum((r * w for r, w in zip(ratings[1:], weights[1:], strict=True)), ratings[0] * weights[0]).cast("double"), sum(weights[1:], weights[0]).cast("double"))


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def paired(rows: DataFrame, unit: str, system: str, value: str, systems: tuple[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row a unit with both systems' means; units that lack one are left out."""
    wide = rows.groupBy(unit, *keep).pivot(system, list(systems)).agg(F.avg(value))
    return wide.where(F.col(systems[0]).isNotNull() & F.col(systems[1]).isNotNull()).withColumn("difference", F.col(systems[0]) - F.col(systems[1]))


def paired_statistics(pairs: DataFrame, by: Sequence[str] = (), value: str = "difference") -> DataFrame:
    """n, mean, sample sd, standard error, t, degrees of freedom and the effect size dz."""
    stats = pairs.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return stats.select(*by, "n", "mean", "sd", se.alias("se"), F.try_divide(F.col("mean"), se).alias("t"), (F.col("n") - 1).alias("df"), F.try_divide(F.col("mean"), F.col("sd")).alias("dz"))


def with_tests(statistics: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adds p_value, low and high to the few rows of ``paired_statistics``."""
    names = [c for c in statistics.columns if c not in ("p_value", "low", "high")]
    out = []
    for r in statistics.collect():
        usable = r["n"] > 1 and r["se"]
        reach = D.t_quantile(0.5 + confidence / 2, r["df"]) * r["se"] if usable else None
        p = D.t_two_sided(r["t"], r["df"]) if usable else None
        out.append((*(r[c] for c in names), p, r["mean"] - reach if usable else None, r["mean"] + reach if usable else None))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in statistics.schema) + ", p_value double, low double, high double"
    return statistics.sparkSession.createDataFrame(out, schema)


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from group sums: ss and df between and within, F."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return total.select(between.alias("ss_between"), F.col("within").alias("ss_within"), df1.alias("df_between"), df2.alias("df_within"), F.try_divide(between / df1, F.col("within") / df2).alias("f"))


def holm(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Step-down adjusted p-values of a small family of tests."""
    order = Window.orderBy(p, key)
    m = Window.partitionBy()
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(m) - F.row_number().over(order) + 1))
    return tests.withColumn("_raw", raw).withColumn("adjusted", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def reliability(rows: DataFrame, target: str, one: str, two: str) -> DataFrame:
    """Agreement ICC of single and average ratings of two raters, Pearson's r and the mean absolute difference.

    The mean squares follow from sums over targets: with two raters, d their difference and s their sum,
    MSR = var(s) / 2 and MSE = var(d) / 2.
    """
    a = rows.agg(
        F.count("*").alias("n"), (F.var_samp(F.col(one) + F.col(two)) / 2).alias("r"), (F.var_samp(F.col(one) - F.col(two)) / 2).alias("e"),
        (F.count("*") * F.pow(F.avg(F.col(one) - F.col(two)), 2) / 2).alias("c"), F.corr(one, two).alias("pearson"), F.avg(F.abs(F.col(one) - F.col(two))).alias("mean_abs_difference"),
    )
    r, e, c, n = F.col("r"), F.col("e"), F.col("c"), F.col("n")
    return a.select("n", F.try_divide(r - e, r + e + 2 * (c - e) / n).alias("icc_single"), F.try_divide(r - e, r + (c - e) / n).alias("icc_average"), "pearson", "mean_abs_difference")


def describe(rows: DataFrame, value: str, key: str, by: Sequence[str] = ()) -> DataFrame:
    """n, distinct keys, mean, geometric mean, quartiles and range."""
    q = lambda p: F.percentile(value, p)
    positive = F.when(F.col(value) > 0, F.ln(value))
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.count_distinct(key).alias("n_keys"), F.avg(value).alias("mean"), F.exp(F.avg(positive)).alias("geometric_mean"), q(0.5).alias("median"),
        q(0.25).alias("q1"), q(0.75).alias("q3"), F.min(value).alias("least"), F.max(value).alias("most"),
    )


def preference(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """How many units prefer ``left``, with the exact two-sided binomial p-value; ties are left out."""
    r = pairs.agg(F.count_if(F.col(left) > F.col(right)).alias("k"), F.count_if(F.col(left) != F.col(right)).alias("n")).first()
    return pairs.sparkSession.createDataFrame([(r["k"], r["n"], D.binomial_two_sided(r["k"], r["n"]) if r["n"] else None)], "k long, n long, p_value double")
