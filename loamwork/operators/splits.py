"""Reproducible samples, splits and folds; hashes take the place of a generator's state."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.operators.ordering import hash_ranked

#: Into how many units groups are brought together before they are dealt on the driver.
UNITS = 10_000


def hash_order(seed: int, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")), 256)


def fixed_per_stratum(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum, those of the least hashes.

    A first limit within ``PARTS`` hashed parts of a stratum leaves at most ``n`` rows each, so no large stratum is
    sorted in one task.
    """
    parts = 64
    h = rows.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_p", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(parts)))
    first = h.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_h", key))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))).where(F.col("_r") <= n).drop("_h", "_p", "_r")


def split_by_position(rows: DataFrame, stratum: str, key: str, seed: int, test: float = 0.2, dev: float = 0.1) -> DataFrame:
    """``rows`` with ``split``: of each stratum in hash order, first the test rows, then dev, the rest train.

    Shares are rounded half to even and take one row at least.
    """
    out = hash_ranked(rows, F.col(stratum), hash_order(seed, F.col(key)), key)
    tested = F.greatest(F.lit(1), F.bround(F.col("n") * test, 0))
    developed = tested + F.greatest(F.lit(1), F.bround(F.col("n") * dev, 0))
    return out.withColumn("split", F.when(F.col("rank") <= tested, "test").when(F.col("rank") <= developed, "dev").otherwise("train")).drop("rank", "n", "_block")


def root_allocation(sizes: DataFrame, stratum: str, size: str, total: int) -> DataFrame:
    """``sizes`` with ``allocated``: ``total`` shared by the square root of size, floors first, then largest remainders.

    ``sizes`` has a row a stratum. No stratum gets more than it has; what that leaves over is not dealt again.
    """
    all_ = Window.partitionBy()
    share = F.lit(total) * F.sqrt(size) / F.sum(F.sqrt(size)).over(all_)
    out = sizes.withColumn("_share", share).withColumn("_floor", F.floor("_share"))
    left = F.lit(total) - F.sum("_floor").over(all_)
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_floor")), stratum))
    return out.withColumn("allocated", F.least(F.col("_floor") + F.when(place <= left, 1).otherwise(0), F.col(size)).cast("long")).drop("_share", "_floor")


def group_folds(rows: DataFrame, group: str, label: str, labels: Sequence[str], folds: int = 5, seed: int = 0) -> DataFrame:
    """``rows`` with ``fold``: whole groups, dealt so that each fold's label counts stay even.

    Label counts of groups are summed in Spark and dealt on the driver, largest first, to the fold whose counts then
    stray least. A group of less than a ``UNITS``-th of all rows is dealt with others of its hash, so the driver sees at
    most twice ``UNITS`` of them, whatever the number of groups.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"), *(F.count_if(F.col(label) == x).alias(f"_{i}") for i, x in enumerate(labels)))
    total_rows = rows.count()
    text = F.coalesce(F.col(group).cast("string"), F.lit("\0"))
    unit = F.when(F.col("_n") * UNITS >= total_rows, F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("#"), F.pmod(F.crc32(text), F.lit(UNITS)).cast("string")))
    named = counts.withColumn("_unit", unit)
    sums = named.groupBy("_unit").agg(*(F.sum(f"_{i}").alias(f"_{i}") for i in range(len(labels))))
    found = [(r["_unit"], [r[f"_{i}"] for i in range(len(labels))]) for r in sums.collect()]
    total = [sum(c[i] for _, c in found) or 1 for i in range(len(labels))]
    held = [[0] * len(labels) for _ in range(folds)]
    dealt = []
    for name, c in sorted(found, key=lambda x: (-sum(x[1]), x[0])):
        spread = lambda f: sum(((h[i] + (c[i] if k == f else 0)) / total[i]) ** 2 for k, h in enumerate(held) for i in range(len(labels)))  # noqa: B023, E731
        best = min(range(folds), key=lambda f: (round(spread(f), 9), sum(held[f]), f))
        held[best] = [a + b for a, b in zip(held[best], c, strict=True)]
        dealt.append((name, best))
    by_unit = rows.sparkSession.createDataFrame(dealt, "_unit string, fold int")
    by_group = named.join(F.broadcast(by_unit), "_unit").select(F.col(group).alias("_group"), "fold")
    return rows.join(by_group, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def balanced_split(groups: DataFrame, group: str, counts: Sequence[str], trials: int, share: float, seed: int) -> DataFrame:
    """(trial, error, chosen groups) of the trial whose chosen share of groups has the label shares nearest to all.

    ``groups``: a row a group with label counts. Each trial, of a stated number, orders the groups by its own hash;
    only its sums are kept, and the names are looked up for the best trial alone.
    """
    digest = lambda trial: F.sha2(F.concat_ws("|", F.lit(str(seed)), trial, group), 256)
    pairs = groups.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    ordered = hash_ranked(pairs, F.col("trial"), digest(F.col("trial").cast("string")), group)
    picked = ordered.withColumn("_in", (F.col("rank") <= F.ceil(F.col("n") * share)).cast("int"))
    sums = picked.groupBy("trial").agg(*(F.sum(F.col("_in") * F.col(c)).alias(f"in_{c}") for c in counts), *(F.sum(c).alias(f"all_{c}") for c in counts))
    total = lambda kind: sum((F.col(f"{kind}_{c}") for c in counts[1:]), F.col(f"{kind}_{counts[0]}"))
    off = lambda c: F.abs(F.try_divide(F.col(f"in_{c}"), total("in")) - F.col(f"all_{c}") / total("all")) + F.when(F.col(f"in_{c}") == 0, 1.0).otherwise(0.0)
    error = sum((off(c) for c in counts[1:]), off(counts[0]))
    best = sums.select("trial", F.round(error, 12).alias("error")).agg(F.min(F.struct("error", "trial")).alias("b")).select("b.trial", "b.error")
    won = best.first()
    if won is None or won["trial"] is None:
        return best.select("trial", "error", F.array().cast("array<string>").alias("chosen"))
    names = hash_ranked(groups, F.lit(0), digest(F.lit(str(won["trial"]))), group).where(F.col("rank") <= F.ceil(F.col("n") * share))
    chosen = names.agg(F.sort_array(F.collect_list(group)).alias("chosen"))
    return chosen.select(F.lit(won["trial"]).cast("long").alias("trial"), F.lit(won["error"]).cast("double").alias("error"), "chosen")


def derangement(rows: DataFrame, key: str, value: str, seed: int, block: str | None = None) -> DataFrame:
    """``rows`` with the ``value`` of the next row in hash order, the last taking the first's; within ``block`` if given."""
    placed = hash_ranked(rows, F.col(block) if block else F.lit(0), hash_order(seed, F.col(key)), key)
    after = placed.select("_block", F.when(F.col("rank") == 1, F.col("n")).otherwise(F.col("rank") - 1).alias("rank"), F.col(value).alias(f"next_{value}"))
    return placed.join(after, ["_block", "rank"]).select(*rows.columns, f"next_{value}")


def batches(rows: DataFrame, group: str, order: Sequence[str], size: int = 12) -> DataFrame:
    """``rows`` with ``batch``: runs of ``size`` rows within each group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size).cast("int"))


def least_loaded(sizes: Mapping[str, int], parts: int) -> dict[str, int]:
    """Names to parts, largest first, each to the least loaded."""
    heap, out = [(0, k) for k in range(parts)], {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(heap)
        out[name] = k
        heapq.heappush(heap, (load + size, k))
    return out
