"""Calibration and selective prediction from probability vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators.ordering import ranked


def scored(rows: DataFrame, gold: str, probs: str, labels: Sequence[str]) -> DataFrame:
    """``rows`` with ``p`` (checked), ``confidence``, ``correct`` and ``gold_at``."""
    names = F.array(*map(F.lit, labels))
    out = rows.withColumn("p", V.checked(F.col(probs), len(labels))).withColumn("gold_at", F.array_position(names, F.col(gold)).cast("int"))
    return out.withColumn("confidence", F.array_max("p")).withColumn("correct", (V.argmax(F.col("p"), labels) == F.col(gold)).cast("int"))


def bins(rows: DataFrame, gold: str, probs: str, labels: Sequence[str], n: int = 15) -> DataFrame:
    """Count, mean confidence and accuracy of each non-empty bin of confidence; the last one is closed."""
    place = F.least(F.floor(F.col("confidence") * n), F.lit(n - 1)).cast("int")
    return scored(rows, gold, probs, labels).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"))


def summary(rows: DataFrame, gold: str, probs: str, labels: Sequence[str], n: int = 15) -> DataFrame:
    """Log loss, Brier sum, top-label calibration error, mean confidence and accuracy in one row.

    Everything is summed by bin first, so one pass gives the error and the means.
    """
    s = scored(rows, gold, probs, labels)
    brier = F.aggregate(F.transform("p", lambda x, i: F.pow(x - F.when(i + 1 == F.col("gold_at"), 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)
    place = F.least(F.floor(F.col("confidence") * n), F.lit(n - 1))
    by_bin = s.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("conf"), F.sum("correct").alias("right"),
        F.sum(-F.ln(F.element_at("p", F.col("gold_at")))).alias("loss"), F.sum(brier).alias("brier"),
    )
    all_n = F.sum("n")
    return by_bin.agg(
        all_n.alias("items"),
        (F.sum("loss") / all_n).alias("log_loss"),
        (F.sum("brier") / all_n).alias("brier"),
        (F.sum(F.abs(F.col("right") - F.col("conf"))) / all_n).alias("calibration_error"),
        (F.sum("conf") / all_n).alias("mean_confidence"),
        (F.sum("right") / all_n).alias("accuracy"),
    )


def risk_coverage(rows: DataFrame, gold: str, probs: str, labels: Sequence[str], key: str, points: int = 10) -> DataFrame:
    """Risk among the most confident rows at ``points`` coverages; equal confidences go by ``key``."""
    s = ranked(scored(rows, gold, probs, labels).select(key, "confidence", "correct"), "confidence", key, descending=True)
    # a row belongs to the first target that retains it; targets above add up
    n = rows.count()
    step = F.ceil(F.col("rank") * points / F.lit(n) - 1e-12).cast("int")
    parts = s.groupBy(step.alias("point")).agg(F.lit(n).alias("n"), F.sum("correct").alias("right"), F.count("*").alias("kept"), F.min("confidence").alias("least_confidence"))
    upto = Window.orderBy("point").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select("point", "n", "least_confidence", F.sum("right").over(upto).alias("right"), F.sum("kept").over(upto).alias("kept"))
    return run.select("point", (F.col("kept") / F.col("n")).alias("coverage"), (F.col("right") / F.col("kept")).alias("accuracy"), (1 - F.col("right") / F.col("kept")).alias("risk"), "least_confidence")


def area(curve: DataFrame, x: str = "coverage", y: str = "risk") -> DataFrame:
    """Trapezoid area under a curve of few points."""
    w = Window.orderBy(x)
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return curve.select(part.alias("part")).agg(F.sum("part").alias("area"))
