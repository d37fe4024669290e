"""Connected components by randomised contraction; everything stays in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import discarded, stored


def priority(node: str, nth: int) -> Column:
    """By what nodes are compared in round ``nth``: their ids at first, then a hash that differs from round to round."""
    return F.col(node) if nth == 0 else F.xxhash64(F.col(node), F.lit(nth))


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, label) of every node of the undirected ``edges`` (a, b); a label is a node of the component.

    Each round points every node to the least of itself and its neighbours, replaces the ends of all edges by where
    they point and drops loops and doubles. The first round compares ids, so that stars around their least id vanish
    at once. Later ones compare hashes drawn anew: whatever the graph is, a node is pointed at with a probability of
    at most 3/4 in expectation (1/2 on a path), so rounds are logarithmic in the nodes and need no limit. The tables
    of a round shrink in the same way; labels are put together from the last round back, at a linear cost in all.

    A hub's edges are reduced in every task before its least neighbour is sent, and the joins on it can be split by
    Spark. No edges give no rows; loops and repeated edges make no difference, and an edge with a null end has none.
    ``rounds`` gets the number of edges that each round began with.
    """
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "component-edges")
    steps: list[DataFrame] = []
    while n := rest.count():
        if rounds is not None:
            rounds.append(n)
        nth = len(steps)
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = both.groupBy("node").agg(F.min(F.struct(priority("other", nth).alias("by"), F.col("other").alias("id"))).alias("least"))
        own = F.struct(priority("node", nth).alias("by"), F.col("node").alias("id"))
        points = stored(least.select("node", F.least("least", own)["id"].alias("to")), "component-points")
        steps.append(points)
        ends = rest.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        after = stored(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "component-edges")
        discarded(rest)
        rest = after
    if not steps:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("label"))
    before = steps.pop()
    labels = before.withColumnRenamed("to", "label")
    while steps:
        points, last = steps.pop(), labels.select(F.col("node").alias("to"), "label")
        labels = stored(points.join(last, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "component-labels")
        discarded(points, before)
        before = labels
    return labels
