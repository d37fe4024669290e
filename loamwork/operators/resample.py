"""Bootstrap intervals from hashed draws.

A draw is a uniform number from the SHA-256 of (seed, replicate, draw), so results depend on no order, no partitioning
and no engine. Draws are counted to weights first, so a replicate never repeats a row. Spark takes the draws for as
small as the one row of counts that they are made from, so joins with them are told to merge: else they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators.ordering import in_order_within, numbered, ranked, text_place

#: Draws of a replicate that one row of the plan stands for before they are spread over the tasks.
DRAWS_A_ROW = 1 << 16


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1), from the first 32 bits of the hash of the parts joined by ``|``."""
    key = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def draws(spark: SparkSession, replicates: int, units: DataFrame, seed: int, stratum: str | None = None) -> DataFrame:
    """(replicate, [stratum,] unit, weight): how often each replicate drew each unit.

    ``units``: [stratum,] n, the number of units to draw of; units are numbered from 0.
    """
    own = [stratum] if stratum else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = units.where("n > 0").select(*own, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    chunks = every.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(DRAWS_A_ROW).cast("long")))).repartition(parts)
    drawn = chunks.withColumn("draw", F.explode(F.sequence("first", F.least(F.col("first") + DRAWS_A_ROW, "n") - 1)))
    u = uniform(seed, F.col("replicate"), *(F.col(s) for s in own), F.col("draw"))
    placed = drawn.select("replicate", *own, F.floor(u * F.col("n")).cast("long").alias("unit"))
    # one shuffle serves the counts and the join by unit
    return placed.repartition(parts, *own, "unit").groupBy("replicate", *own, "unit").agg(F.count("*").alias("weight")).hint("merge")


def interval(values: DataFrame, value: str, by: Sequence[str] = (), method: str = "linear", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval over replicates: ``linear`` interpolation or the ``nearest`` rank floor(q * R)."""
    if method == "linear":
        return values.groupBy(*by).agg(F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"), F.count("*").alias("replicates"))
    ordered = values.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = lambda q: F.element_at("v", F.least(F.floor(q * F.size("v")).cast("int") + 1, F.size("v")))
    return ordered.select(*by, at(low).alias("low"), at(high).alias("high"), F.size("v").cast("long").alias("replicates"))


def unit_numbers(clusters: DataFrame, key: str) -> DataFrame:
    """``clusters`` with ``unit``, their numbers from 0 by ``key``, a text or a number; none of it in one task."""
    place = text_place(F.col(key)) if clusters.schema[key].dataType.simpleString() == "string" else F.col(key).cast("double")
    return numbered(clusters, place, [key], "unit").withColumn("unit", F.col("unit") - 1)


def bootstrap_mean(rows: DataFrame, value: str, key: str, replicates: int, seed: int) -> DataFrame:
    """A: (replicate, estimate), the means of rows drawn one by one."""
    spark = rows.sparkSession
    units = ranked(rows.select(key, value), key, key).withColumn("unit", F.col("rank") - 1)
    weights = draws(spark, replicates, rows.agg(F.count("*").alias("n")), seed)
    return weights.join(units, "unit").groupBy("replicate").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("estimate"))


def bootstrap_clusters(rows: DataFrame, cluster: str, value: str, replicates: int, seed: int) -> DataFrame:
    """B: means of whole clusters drawn; each cluster is reduced to a sum and a count before it meets the draws."""
    parts = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    units = unit_numbers(parts, cluster)
    weights = draws(rows.sparkSession, replicates, parts.agg(F.count("*").alias("n")), seed)
    return weights.join(units, "unit").groupBy("replicate").agg((F.sum(F.col("weight") * F.col("s")) / F.sum(F.col("weight") * F.col("c"))).alias("estimate"))


def bootstrap_strata(rows: DataFrame, stratum: str, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """D: rows drawn within their stratum; (replicate, estimate) is the mean over all."""
    # rows of a stratum are numbered by key; a null stratum meets no draws
    units = in_order_within(rows.select(stratum, key, value).where(F.col(stratum).isNotNull()), [stratum], [F.asc(key)], "unit").withColumn("unit", F.col("unit") - 1)
    weights = draws(rows.sparkSession, replicates, rows.groupBy(stratum).agg(F.count("*").alias("n")), seed, stratum)
    return weights.join(units, [stratum, "unit"]).groupBy("replicate").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("estimate"))


def two_stage_weights(rows: DataFrame, cluster: str, key: str, replicates: int, seed: int) -> DataFrame:
    """C: (replicate, key, weight): clusters drawn, then as many rows of each drawn cluster as it has, once a draw.

    Store the result where several estimates share it.
    """
    from pyspark.sql import Window

    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n"))
    units = unit_numbers(sizes, cluster)
    drawn = draws(rows.sparkSession, replicates, sizes.agg(F.count("*").alias("n")), seed).join(units, "unit")
    each = drawn.select("replicate", cluster, "n", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("turn")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    u = uniform(seed, F.lit("item"), F.col("replicate"), F.col(cluster), F.col("turn"), F.col("draw"))
    picked = each.withColumn("item", F.floor(u * F.col("n")).cast("long")).groupBy("replicate", cluster, "item").agg(F.count("*").alias("weight"))
    items = rows.select(cluster, key).withColumn("item", F.row_number().over(Window.partitionBy(cluster).orderBy(key)).cast("long") - 1)
    return picked.hint("merge").join(items, [cluster, "item"]).select("replicate", key, "weight")


def weighted_mean(weights: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(replicate, estimate) of a mean from shared weights."""
    return weights.hint("merge").join(rows.select(key, value), key).groupBy("replicate").agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("estimate"))


def weighted_macro_f1(weights: DataFrame, rows: DataFrame, key: str, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """(replicate, estimate) of macro-F1 over the fixed label domain from shared weights."""
    from loamwork.operators.metrics import ratio

    cells = weights.hint("merge").join(rows.select(key, gold, predicted), key).groupBy("replicate", gold, predicted).agg(F.sum("weight").alias("w"))
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col(gold).alias("label"), F.col("w").alias("g"), zero.alias("p")), F.struct(F.col(predicted).alias("label"), zero.alias("g"), F.col("w").alias("p"))))
    hit = F.when((F.col(gold) == F.col(predicted)) & (F.col("s.g") > 0), F.col("w")).otherwise(0)
    by_label = cells.select("*", sides.alias("s")).groupBy("replicate", "s.label").agg(F.sum("s.g").alias("g"), F.sum("s.p").alias("p"), F.sum(hit).alias("tp"))
    return by_label.groupBy("replicate").agg((F.sum(ratio(2 * F.col("tp"), F.col("g") + F.col("p"))) / len(labels)).alias("estimate"))


def paired_f1(rows: DataFrame, cluster: str, gold: str, one: str, other: str, replicates: int, seed: int) -> DataFrame:
    """E: (replicate, difference) of pooled F1 of two sets of 0/1 decisions; whole clusters are drawn."""
    from loamwork.operators.metrics import ratio

    g = F.col(gold) == 1
    count = lambda c, name: [F.count_if(g & (F.col(c) == 1)).alias(f"tp_{name}"), F.count_if(~g & (F.col(c) == 1)).alias(f"fp_{name}"), F.count_if(g & (F.col(c) == 0)).alias(f"fn_{name}")]
    parts = rows.groupBy(cluster).agg(*count(one, "a"), *count(other, "b"))
    units = unit_numbers(parts, cluster)
    weights = draws(rows.sparkSession, replicates, parts.agg(F.count("*").alias("n")), seed)
    total = lambda c: F.sum(F.col("weight") * F.col(c))
    f1 = lambda n: ratio(2 * total(f"tp_{n}"), 2 * total(f"tp_{n}") + total(f"fp_{n}") + total(f"fn_{n}"))
    return weights.join(units, "unit").groupBy("replicate").agg((f1("a") - f1("b")).alias("difference"))


def two_sided(differences: DataFrame, value: str = "difference") -> DataFrame:
    """Twice the smaller tail share, each with one added, at most 1."""
    n = F.count("*")
    tail = lambda c: (F.count_if(c) + 1) / (n + 1)
    return differences.agg(F.least(F.lit(1.0), 2 * F.least(tail(F.col(value) <= 0), tail(F.col(value) >= 0))).alias("p_value"))
