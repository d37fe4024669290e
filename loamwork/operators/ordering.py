"""Ranks over a whole table without one task that sorts it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.sources.staging import staged

RANGES = 512
_PLACE = (1 << 33) - 1  # the place in a partition within Spark's increasing ids


def sorted_rows(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` dealt into ranges by ``order``, sorted and staged, with ``_nth``: partition and place in it as one number.

    Rows that ``order`` doesn't tell apart are cut by their place in ``df``, so a value that many rows share fills no
    partition by itself. Spark samples the rows for the ranges, so ``df`` is computed twice.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *order, F.asc("_salt")).sortWithinPartitions(*order, F.asc("_salt"))
    return staged(rows.withColumn("_nth", F.monotonically_increasing_id()).drop("_salt"), "sorted-rows")


def in_order(df: DataFrame, order: Sequence[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` numbered from 1 by ``order``; one row a partition is summed up on the driver."""
    rows = sorted_rows(df, *order, parts=parts)
    part, upto, starts = F.shiftright("_nth", 33), 0, []
    for i, n in sorted(rows.groupBy(part.alias("part")).count().collect()):
        starts.append((i, upto))
        upto += n
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    placed = rows.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_nth").bitwiseAND(_PLACE) + 1).drop("_part", "_start", "_nth")


def in_order_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` numbered from 1 by ``order`` within each value of ``groups``, which has no nulls; no group lies in one task.

    A sorted partition holds a run of rows of each of its groups. Runs are counted, and rows meet their own run, so the
    join's keys are no larger than a partition.
    """
    rows = sorted_rows(df, *(F.asc(g) for g in groups), *order).withColumn("_part", F.shiftright("_nth", 33))
    runs = rows.groupBy(*groups, "_part").agg(F.min("_nth").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*groups, "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return rows.join(runs, [*groups, "_part"]).withColumn(name, F.col("_nth") - F.col("_first") + F.col("_before") + 1).drop("_part", "_nth", "_first", "_before")


def ranked(df: DataFrame, value: str, tie: str, descending: bool = False, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` with its rank from 1 by (value, tie), dealt into ``ranges``. Nulls come last."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return in_order(df, [order, F.asc(tie)], name, ranges)


def running(df: DataFrame, value: str, sums: tuple[str, ...], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``run_<c>``: the sum of ``c`` over all rows up to this one in order of ``value``, which is unique."""
    splits = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = F.array(*(F.lit(float(s)) for s in sorted(set(splits)))) if splits else F.array().cast("array<double>")
    place = F.size(F.filter(cuts, lambda s: s <= F.col(value).cast("double")))
    rows = df.withColumn("_range", -place if descending else place)
    totals = rows.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums))
    within = Window.partitionBy("_range").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(c).over(within).alias(f"_w_{c}") for c in sums)).join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *((F.col(f"_w_{c}") + F.col(f"_s_{c}")).alias(f"run_{c}") for c in sums))


def text_place(column: Column) -> Column:
    """A number that grows with a text's first six bytes, or stays."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def numbered(df: DataFrame, place: Column, order: Sequence[Column | str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` numbered from 1 by ``order``; ``place`` is a number that never falls along it, nulls first."""
    columns = [F.asc(c) if isinstance(c, str) else c for c in order]
    return in_order(df, [place.asc_nulls_first(), *columns], name, ranges)


def hash_ranked(df: DataFrame, block: Column, digest: Column, tie: str) -> DataFrame:
    """``df`` with ``rank`` from 1 in the order of a hexadecimal ``digest`` within ``block``, and the block's size ``n``.

    Digests are even, so their first byte cuts every block, however large, into 256 parts that are sorted apart.
    """
    rows = df.withColumn("_block", F.coalesce(block.cast("string"), F.lit("\0"))).withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 2))
    counts = rows.groupBy("_block", "_part").count()
    all_ = Window.partitionBy("_block")
    upto = F.sum("count").over(all_.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    starts = counts.select("_block", "_part", upto.alias("_start"), F.sum("count").over(all_).alias("n"))
    row = F.row_number().over(Window.partitionBy("_block", "_part").orderBy("_digest", tie))
    return rows.withColumn("_row", row).join(starts, ["_block", "_part"]).withColumn("rank", F.col("_start") + F.col("_row")).drop("_part", "_digest", "_start", "_row")
