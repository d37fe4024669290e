"""Classification metrics over a fixed label domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_counts(pairs: DataFrame, gold: str, predicted: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """True positives, predicted and gold counts of every label of the domain, zeros included.

    Each row gives one count to its gold label and one to its predicted label, so the sums are combined before the
    shuffle and only ``labels`` rows a group leave a task. A label never seen gets zeros; labels outside the domain
    are left out; an empty input has no groups.
    """
    hit = F.col(gold) == F.col(predicted)
    long = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col(gold).alias("label"), F.lit(1).alias("gold"), F.lit(0).alias("pred"), hit.cast("int").alias("tp")),
                F.struct(F.col(predicted).alias("label"), F.lit(0).alias("gold"), F.lit(1).alias("pred"), F.lit(0).alias("tp")),
                *(F.struct(F.lit(x).alias("label"), F.lit(0).alias("gold"), F.lit(0).alias("pred"), F.lit(0).alias("tp")) for x in labels),
            )
        ).alias("x"),
    ).select(*by, "x.*")
    return long.where(F.col("label").isin(*labels)).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("pred").alias("n_pred"), F.sum("gold").alias("support")
    )


def per_class(pairs: DataFrame, gold: str, predicted: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each label; a division by zero gives 0."""
    counts = label_counts(pairs, gold, predicted, labels, by)
    return counts.select(
        *by, "label", "tp", "n_pred", "support",
        ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support")).alias("f1"),
    )


def macro(pairs: DataFrame, gold: str, predicted: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Macro and weighted F1 and accuracy over the fixed label domain, in one aggregation after ``per_class``."""
    return per_class(pairs, gold, predicted, labels, by).groupBy(*by).agg(
        F.sum("support").alias("n"),
        (F.sum("f1") / len(labels)).alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
    )


def confusion(pairs: DataFrame, gold: str, predicted: str, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Every (gold, predicted) cell of the domain with its count, zeros included."""
    counts = pairs.groupBy(*by, F.col(gold).alias("gold"), F.col(predicted).alias("pred")).count()
    as_map = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "gold", "pred"), "count"))).alias("cells"))
    cells = F.array(*(F.struct(F.lit(g).alias("gold"), F.lit(p).alias("pred")) for g in labels for p in labels))
    long = as_map.select(*by, "cells", F.explode(cells).alias("x"))
    return long.select(*by, "x.gold", "x.pred", F.coalesce(F.try_element_at("cells", F.concat_ws("|", "x.gold", "x.pred")), F.lit(0)).alias("n"))


def decision(label: Column) -> Column:
    """Four labels to three decisions; any other label is an error."""
    return (
        F.when(label == "SUPPORTED", "PRESENT")
        .when(label == "NOT_SUPPORTED", "ABSENT")
        .when(label.isin("INSUFFICIENT_CONTEXT", "ENTITY_OR_TYPE_ERROR"), "ABSTAIN")
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))))
    )


def abstention(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, covered accuracy, admission error and recalls of abstention, null where nothing supports them."""
    g, p = F.col(gold), F.col(predicted)
    apart = lambda c: c.isin("INSUFFICIENT_CONTEXT", "ENTITY_OR_TYPE_ERROR")
    share = lambda of, where: F.round(F.avg(F.when(where, of.cast("double"))), 9)
    columns = [
        F.count("*").alias("items"),
        F.count_if(apart(g)).alias("gold_abstentions"),
        share(~apart(p), F.lit(True)).alias("coverage"),
        share(g == p, ~apart(p)).alias("covered_accuracy"),
        share(g != "SUPPORTED", p == "SUPPORTED").alias("admission_error"),
        share(apart(p), apart(g)).alias("any_abstention_recall"),
        share(p == "SUPPORTED", apart(g)).alias("false_present_rate"),
        share(p == "SUPPORTED", g == "SUPPORTED").alias("supported_recall"),
    ]
    for reason in ("INSUFFICIENT_CONTEXT", "ENTITY_OR_TYPE_ERROR"):
        short = reason.split("_")[0].lower()
        columns += [share(p == reason, g == reason).alias(f"{short}_correct_recall"), share(apart(p), g == reason).alias(f"{short}_any_recall")]
    return pairs.groupBy(*by).agg(*columns)


def set_scores(gold: DataFrame, predicted: DataFrame, key: Sequence[str], group: str) -> DataFrame:
    """Precision, recall and F1 of a set of keys against another, in all (``group`` null) and by group, in one pass."""
    both = gold.select(*key).distinct().withColumn("_g", F.lit(1)).join(predicted.select(*key).distinct().withColumn("_p", F.lit(1)), list(key), "full_outer")
    hits = both.select(group, (F.col("_g").isNotNull() & F.col("_p").isNotNull()).cast("int").alias("tp"), F.col("_g").isNull().cast("int").alias("fp"), F.col("_p").isNull().cast("int").alias("fn"))
    counts = hits.rollup(group).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.grouping(group).alias("in_all"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        group, F.col("in_all").cast("int").alias("in_all"), "tp", "fp", "fn",
        F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"),
    )


def average_precision(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Mean over positives of the precision at their score; rows of one score count together."""
    by_score = rows.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    from loamwork.operators.ordering import running

    total = running(by_score, score, ("p", "n"), descending=True)
    return total.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("p") * F.col("run_p") / F.col("run_n")), F.sum("p")), F.lit(0.0)), 9).alias("average_precision"))


def selection_score(rows: DataFrame, gold: str, predicted: str, source: str, known_sources: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row: macro-F1 of four labels and of three decisions, the same over rows of sources that ``known_sources`` lacks, and the harmonic mean.

    Without any such row the unseen score is that of all rows. Sources are marked by a join, and all scores come from
    one table of counts by (unseen, gold, predicted).
    """
    known = known_sources.select(F.col(source).alias("_known")).distinct()
    marked = rows.join(known, F.col(source) == F.col("_known"), "left").withColumn("unseen", F.col("_known").isNull())
    cells = marked.groupBy("unseen", F.col(gold).alias("gold"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))
    parts = F.explode(F.when(F.col("unseen"), F.array(F.lit("four"), F.lit("three"), F.lit("unseen"))).otherwise(F.array(F.lit("four"), F.lit("three"))))
    each = cells.select("unseen", "gold", "pred", "n", parts.alias("part"))
    view = lambda c: F.when(F.col("part") == "four", F.col(c)).otherwise(decision(F.col(c)))
    each = each.select("part", "n", view("gold").alias("gold"), view("pred").alias("pred")).groupBy("part", "gold", "pred").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), zero.alias("p")), F.struct(F.col("pred").alias("label"), zero.alias("g"), F.col("n").alias("p"))))
    hit = F.when((F.col("gold") == F.col("pred")) & (F.col("s.g") > 0), F.col("n")).otherwise(0)
    f1 = each.select("*", sides.alias("s")).groupBy("part", "s.label").agg(ratio(2 * F.sum(hit), F.sum("s.g") + F.sum("s.p")).alias("f1"), F.sum("s.g").alias("g"))
    score = lambda part, size: F.sum(F.when(F.col("part") == part, F.col("f1"))) / size
    out = f1.agg(score("four", len(labels)).alias("four"), score("three", 3).alias("three"), score("unseen", 3).alias("other"), F.coalesce(F.sum(F.when(F.col("part") == "unseen", F.col("g"))), F.lit(0)).cast("long").alias("unseen_items"))
    unseen = F.coalesce("other", "three")
    return out.select(F.round("four", 9).alias("four_class"), F.round("three", 9).alias("three_decision"), F.round(unseen, 9).alias("unseen_three_decision"), F.round(ratio(2 * F.col("three") * unseen, F.col("three") + unseen), 9).alias("harmonic"), "unseen_items")
