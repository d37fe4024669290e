"""Bootstrap replicates by splitting their draws, without a row a draw.

Drawing n times from n units and counting what falls into each cell is one multinomial draw. A replicate's draws are
split cell by cell: of the draws left, those of a cell are binomial with the cell's part of the units left. The
binomial number comes from one hashed uniform number through its distribution function, so that results depend on no
order, partitioning or engine.

Statistics that take few values, such as accuracies, F1 and counts a cluster, need no rows at all: rows with equal values
are a cell. For others ``value_replicates`` splits the draws over ranges of rows first and draws within each range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators.ordering import in_order
from loamwork.sources.staging import staged

#: Most cells, entries of a table of probabilities at once, replicates a task, and rows of a range.
MOST_CELLS, TABLE, REPLICATES_A_TASK, RANGE = 100_000, 1 << 21, 250, 1 << 16
#: The distribution function is summed over the mean and so many standard deviations, and as many units, to either side;
#: what lies beyond is less than the least uniform number.
REACH = 12


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln(x!) for whole numbers: a sum up to 255 and Stirling's series beyond."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    z = np.maximum(x, 1).astype(float)
    series = z * np.log(z) - z + 0.5 * np.log(2 * np.pi * z) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(x < 256, small[np.minimum(x, 255).astype(int)], series)


def binomial(draws: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each of ``draws``: the least number at which the distribution function exceeds ``u``."""
    if p >= 1:
        return draws.copy()
    if p <= 0:
        return np.zeros_like(draws)
    spread = REACH * np.sqrt(draws * p * (1 - p)) + REACH
    low = np.maximum(0, np.floor(draws * p - spread)).astype(np.int64)
    high = np.minimum(draws, np.ceil(draws * p + spread)).astype(np.int64)
    out, width = np.zeros_like(draws), int((high - low).max(initial=0)) + 1
    rows = max(1, TABLE // width)
    for a in range(0, len(draws), rows):
        part = slice(a, a + rows)
        x, k = low[part, None] + np.arange(width), draws[part, None]
        inside = x <= high[part, None]
        x = np.minimum(x, high[part, None])
        log = log_factorial(k) - log_factorial(x) - log_factorial(k - x) + x * np.log(p) + (k - x) * np.log1p(-p)
        upto = np.cumsum(np.where(inside, np.exp(log), 0.0), axis=1)
        out[part] = low[part] + (upto <= u[part, None] * upto[:, -1:]).sum(axis=1)
    return np.minimum(out, high)


def uniforms(*parts: object) -> float:
    """Between 0 and 1, both left out, from the first 32 bits of the hash of the parts joined by ``|``."""
    return (int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def cell_weights(cells: DataFrame, cell: str, n: str, replicates: int, seed: int, stratum: str | None = None) -> DataFrame:
    """(replicate, [stratum,] cell, weight): how many of each replicate's draws fall into each cell; as many are drawn as there are units.

    ``cells``: [stratum,] a name, unique within its stratum, and its number of units. Each stratum is drawn for itself.
    Cells go through the driver: more than ``MOST_CELLS`` are an error, as statistics with so many values are for
    ``value_replicates``. Cells without draws are left out; no cells give no rows; a null stratum is one like any.
    """
    own = [stratum] if stratum else []
    rows = cells.select(*own, F.col(cell).cast("string").alias("_cell"), F.col(n).cast("long").alias("_n")).where("_n > 0").limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: use value_replicates")
    strata: dict = {}
    for r in rows:
        strata.setdefault(r[0] if own else None, []).append((r["_cell"], r["_n"]))
    strata = {s: sorted(v) for s, v in strata.items()}
    kind = f"{stratum} {cells.schema[stratum].dataType.simpleString()}, " if own else ""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for s, listed in strata.items():
                left_units = sum(units for _, units in listed)
                left = np.full(len(ids), left_units, np.int64)
                for name, units in listed:
                    u = np.array([uniforms(seed, r, *([s] if own else []), name) for r in ids.tolist()])
                    drawn = binomial(left, units / left_units, u)
                    left, left_units = left - drawn, left_units - units
                    some = drawn > 0
                    yield pd.DataFrame({"replicate": ids[some], **({stratum: [s] * int(some.sum())} if own else {}), cell: name, "weight": drawn[some]})

    ids = cells.sparkSession.range(0, replicates, 1, max(1, -(-replicates // REPLICATES_A_TASK)))
    return ids.mapInPandas(split, f"replicate long, {kind}{cell} string, weight long")


def value_replicates(rows: DataFrame, value: str, key: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, estimate): means of ``value`` over as many rows as there are, drawn one by one; nulls count as 0.

    Rows are numbered by ``key``, which is unique, and cut into ranges. A replicate's draws fall into ranges first, and
    a range's task draws rows for all replicates, from generators seeded by (seed, replicate, range). No rows give none.
    """
    numbered = in_order(rows.select(key, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")), [F.asc(key)], "place")
    ranged = staged(numbered.select("place", "_v", F.floor((F.col("place") - 1) / RANGE).cast("long").alias("range")), "bootstrap-values")
    n = ranged.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "replicate long, estimate double")
    sizes = np.full(-(-n // RANGE), RANGE, np.int64)
    sizes[-1] = n - RANGE * (len(sizes) - 1)
    whole = len(sizes)

    def generator(*parts: object) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(int(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:32], 16)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.full(whole, RANGE / n)
        share[-1] = 1 - RANGE / n * (whole - 1)
        for batch in batches:
            for r in batch.column("id").to_pylist():
                draws = generator("ranges", r).multinomial(n, share)
                some = np.flatnonzero(draws)
                yield pa.record_batch([pa.array(np.full(len(some), r)), pa.array(some), pa.array(draws[some])], names=["replicate", "range", "draws"])

    def drawn(values: pa.Table, wanted: pa.Table) -> pa.Table:
        if not values.num_rows or not wanted.num_rows:
            return pa.table({"replicate": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        held = values.sort_by("place").column("_v").to_numpy()
        here = wanted.column("range")[0].as_py()
        ids, draws = wanted.column("replicate").to_pylist(), wanted.column("draws").to_pylist()
        totals = [float(held[generator(r, here).integers(0, len(held), k)].sum()) for r, k in zip(ids, draws, strict=True)]
        return pa.table({"replicate": pa.array(ids, pa.int64()), "total": pa.array(totals, pa.float64())})

    ids = rows.sparkSession.range(0, replicates, 1, max(1, -(-replicates // REPLICATES_A_TASK)))
    tasks = max(1, -(-replicates // (8 * REPLICATES_A_TASK)))  # a range's replicates, so that a task has some thousand
    wanted = ids.mapInArrow(dealt, "replicate long, range long, draws long").withColumn("part", (F.col("replicate") % tasks).cast("int"))
    copies = ranged.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    totals = copies.groupBy("range", "part").cogroup(wanted.groupBy("range", "part")).applyInArrow(drawn, "replicate long, total double")
    return totals.groupBy("replicate").agg((F.sum("total") / n).alias("estimate"))
