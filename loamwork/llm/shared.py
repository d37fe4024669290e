"""What the operators share: the cluster's shared folder, blocks of rows for numpy, and hashes of words.

Hashes of words and windows are computed for a whole block of texts at once. With ``C`` the running sum of
``T[b_i] * P**i`` over the bytes, ``(C[end] - C[start]) * P**-start`` is a polynomial hash of the word that does not
depend on its place; the same holds for windows over words. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, as in tests."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"loamwork-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def delete_on_exit(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(folder)


def stored(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lost executors cost no more than a file's tasks.

    Tables of ids and hashes gain nothing from compression; those with texts are stored with ``zstd``. The table goes
    when the driver's JVM ends, as results that read it may be computed until then, or with ``discarded``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        path = df.__dict__.get("stored_at")
        if path is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(folder, True)


def range_sorted(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` dealt into ranges by ``order`` and sorted, with ``_nth``: the partition and the place in it, as one number.

    Rows that ``order`` doesn't tell apart are cut by their place in ``df``, so no key fills a partition by itself. Spark
    samples the rows for the ranges, so they are computed twice: give a stored table, and store the result.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_salt", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *order, F.asc("_salt")).sortWithinPartitions(*order, F.asc("_salt"))
    return rows.withColumn("_nth", F.monotonically_increasing_id()).drop("_salt")


def with_places(rows: DataFrame, name: str) -> DataFrame:
    """Stored rows of ``range_sorted`` with their place from 1 in the whole order instead of ``_nth``; a row a partition goes through the driver."""
    part = F.shiftright("_nth", 33)
    upto, starts = 0, []
    for i, n in sorted(rows.groupBy(part.alias("part")).count().collect()):
        starts.append((i, upto))
        upto += n
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_nth").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_start", "_nth")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` names it inside of lambdas."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array, ``step`` folded over the elements up to it, from ``zero``; ``step`` is associative.

    The array is folded in parts of about the square root of its size, as an append copies what is there: time is the
    1.5th power of the size, not its square.
    """
    none = F.array().cast("array<long>")
    fold = lambda part: F.aggregate(part, none, lambda acc, x: F.array_append(acc, step(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x)))

    def parts(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), size), lambda k: fold(F.slice(v, k + 1, size)))

    def put_together(folded: Column) -> Column:
        ends = fold(F.transform(folded, lambda part: F.coalesce(F.get(part, F.size(part) - 1), zero)))
        before = F.concat(F.array(zero), ends)
        return F.flatten(F.zip_with(folded, F.slice(before, 1, F.size(folded)), lambda part, b: F.transform(part, lambda x: step(b, x))))

    return let(values.cast("array<long>"), lambda v: let(parts(v), put_together))


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that are taken."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(text_bytes(batch.column(column))[1])
        ends, start, total = [], 0, 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > most:
                ends.append((start, i))
                start, total = i, 0
            total += n
        for a, b in [*ends, (start, batch.num_rows)]:
            yield batch.slice(a, b - a)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@functools.lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i up to n, modulo 2**64."""

    def run(b: int) -> np.ndarray:
        out = np.full(n + 1, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(n).bit_length()))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & M64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))
#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts; ``apart`` and ``change`` give other separators or bytes.

    ``start``, ``end``: byte offsets in the block. ``doc``: the row of each word. ``first``: per row, the index of its
    first word, with the total at the end. ``hash``: 64 bits a word.
    """

    def __init__(self, array: pa.Array, apart: np.ndarray = SPACE, change: np.ndarray | None = None) -> None:
        self.data, self.offsets = text_bytes(array)
        if change is not None:
            self.data = change[self.data]
        n = len(self.data)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~apart[self.data]
        cut = np.zeros(n + 2, bool)
        cut[self.offsets + 1] = True  # a text's first byte, seen in solid's numbering
        self.start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[1:-1]))
        self.end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[2:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        self.count = np.diff(self.first)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        n = len(self.data)
        up, down = powers(BYTE_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[self.data] * up[:n], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word, and whether it ends within the same text."""
        return window_hashes(self.hash, self.first[self.doc + 1] if len(self.doc) else self.doc, size, seed)


def window_hashes(words: np.ndarray, ends: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each on, and whether they end by ``ends``, the place after its text's last word."""
    n = len(words)
    up, down = powers(WORD_BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=sums[1:])
    index = np.arange(n)
    last = np.minimum(index + size, n)
    return mixed((sums[last] - sums[:n]) * down[:n], seed + size), index + size <= ends


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, one for each node but the least of its part."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (before == label).all():
            some = label != np.arange(len(names))
            return names[label[some]], names[some]
