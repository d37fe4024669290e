"""SimHash near-duplicates by vantage-point trees.

A text's fingerprint has 64 bits, each set where it is set in over half of the hashes of the text's shingles.

1. Equal fingerprints are one point, with the least id of their rows, so copies leave before anything is compared.
2. A vantage-point tree over a sample of the points parts all of them into shards by their Hamming distance to vantage
   points. A point of the inner side whose distance is within ``MOST`` of the border also goes on to the outer side:
   by the triangle inequality no pair of linked points lies across otherwise. The sample shapes the shards alone; every
   point goes through the tree.
3. A shard's task parts its points in the same way until few are left, and compares these. Where parting no longer
   helps, as all points are near each other, each point looks up the codes within ``MOST`` bits instead. A shard
   returns a spanning forest of its links, never its pairs.
4. Components of all forests are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.graph import components
from loamwork.llm.importance import LOWER
from loamwork.llm.shared import Words, blocks, spanning, stored
from loamwork.sources.tables import table

SHINGLE, MOST, SEED = 3, 2, 42
#: Points a shard is meant to hold, most shards, and points of the sample for each shard.
SHARD_POINTS, MOST_SHARDS, SAMPLE_A_SHARD = 4096, 1 << 16, 16
#: Points that a task compares by pairs, vantage points tried for a split, and shingles whose bits are counted at once.
LEAF, TRIES, COUNTED = 256, 8, 1 << 14
#: A fingerprint with at least this part of all rows is joined by a broadcast, so there are at most as many.
HOT_PARTS = 1000


def fingerprints(array: pa.Array) -> np.ndarray:
    """The fingerprint of each text of a block; one without words has 0."""
    words = Words(array, change=LOWER)
    size = words.end - words.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])  # places once every word is followed by one space
    text = np.full(int(begin[-1]), 0x20, np.uint8)
    text[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[np.arange(int(size.sum())) + np.repeat(words.start - (np.cumsum(size) - size), size)]
    count = np.where(words.count > 0, np.maximum(words.count - (SHINGLE - 1), 1), 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(int(upto[-1])) - np.repeat(upto[:-1] - words.first[:-1], count)
    last = np.minimum(first + SHINGLE, np.repeat(words.first[1:], count))
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[first].tolist(), (begin[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    ones = np.zeros((len(count), 64), np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    for a in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[a : a + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.flatnonzero(np.diff(doc[a : a + COUNTED], prepend=-1))
        ones[doc[a + starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def far(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def best_split(points: np.ndarray, most: int) -> tuple[np.uint64, int, float]:
    """Vantage point, radius and the share of points at the larger side, border copies counted, that is least.

    Points up to the radius are inside; those inside within ``most`` of it go to both sides. Of ``TRIES`` evenly spaced
    vantage points and all radii, the split is chosen whose two sides have the least sum of squares.
    """
    n = len(points)
    best = (np.uint64(0), 0, np.inf)
    for point in points[np.linspace(0, n - 1, min(TRIES, n)).astype(int)]:
        inside = np.cumsum(np.bincount(far(points, point), minlength=65))
        border = inside - np.concatenate([np.zeros(most, np.int64), inside[:-most]])
        outside = n - inside + border
        cost = (inside.astype(float) ** 2 + outside.astype(float) ** 2) / float(n) ** 2
        radius = int(np.argmin(cost))
        if cost[radius] < best[2]:
            best = (point, radius, float(cost[radius]))
    return best


class Tree:
    """A vantage-point tree as arrays: node i splits at ``point[i]`` and ``radius[i]`` into ``inner[i]`` and ``outer[i]``; a negative child is a shard."""

    def __init__(self, sample: np.ndarray, shards: int, most: int = MOST) -> None:
        self.point, self.radius, self.inner, self.outer = [], [], [], []
        self.most, self.shards = most, 0
        self.root = self._grow(np.sort(sample), shards)
        self.point, self.radius = np.array(self.point, np.uint64), np.array(self.radius, np.int16)

    def _grow(self, points: np.ndarray, shards: int) -> int:
        if shards > 1 and len(points) >= 2:
            point, radius, cost = best_split(points, self.most)
            if cost < 0.9:
                d, at = far(points, point), len(self.point)
                for values in (self.point, self.radius, self.inner, self.outer):
                    values.append(0)
                self.point[at], self.radius[at] = point, radius
                self.inner[at] = self._grow(points[d <= radius], shards // 2)
                self.outer[at] = self._grow(points[d > radius - self.most], shards - shards // 2)
                return at
        self.shards += 1
        return -self.shards

    def dealt(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, shard) of every copy of the points."""
        out, waiting = [], [(self.root, np.arange(len(points)))]
        while waiting:
            node, at = waiting.pop()
            if node < 0:
                out.append((at, np.full(len(at), -1 - node, np.int32)))
                continue
            d = far(points[at], self.point[node])
            waiting.append((self.inner[node], at[d <= self.radius[node]]))
            waiting.append((self.outer[node], at[d > self.radius[node] - self.most]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def near_pairs(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct points at most ``most`` bits apart, by comparing all."""
    i, j = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= most, 1))
    return points[i], points[j]


def looked_up(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect, by looking up each point's codes within ``most`` bits: time is in proportion to the points."""
    points = np.sort(points)
    patterns = [np.uint64(0)]
    for _ in range(most):
        patterns = sorted({int(p) ^ (1 << b) for p in patterns for b in range(64)} | {int(p) for p in patterns})
    a, b = [points[:0]], [points[:0]]
    for pattern in patterns:
        if int(pattern) == 0:
            continue
        other = points ^ np.uint64(pattern)
        at = np.minimum(np.searchsorted(points, other), len(points) - 1)
        yes = (points[at] == other) & (points < other)
        if yes.any():
            a.append(points[yes])
            b.append(other[yes])
            if sum(map(len, a)) > 4 * len(points):
                a, b = ([x] for x in spanning(np.concatenate(a), np.concatenate(b)))
    return np.concatenate(a), np.concatenate(b)


def shard_forest(points: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the points of a shard; memory is in proportion to the points."""
    a, b, held = [points[:0]], [points[:0]], 0
    waiting = [np.unique(points)]
    while waiting:
        some = waiting.pop()
        if len(some) <= LEAF:
            found = near_pairs(some, most)
        else:
            point, radius, cost = best_split(some[:: max(1, len(some) // 2048)], most)
            d = far(some, point)
            inner, outer = some[d <= radius], some[d > radius - most]
            if cost < 0.9 and max(len(inner), len(outer)) < 0.97 * len(some):
                waiting += [inner, outer]
                continue
            found = looked_up(some, most)
        a.append(found[0])
        b.append(found[1])
        held += len(found[0])
        if held > 4 * len(points) + LEAF * LEAF:
            a, b = ([x] for x in spanning(np.concatenate(a), np.concatenate(b)))
            held = len(a[0])
    return spanning(np.concatenate(a), np.concatenate(b))


def links(points: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect all points (``fingerprint`` long, distinct) at most ``most`` bits apart.

    The tree is grown from at most ``SAMPLE_A_SHARD`` points a shard, and of ``MOST_SHARDS`` shards at most: those with
    the least hashes, 8 MB of fingerprints at the very most, which go through the driver to all tasks.
    """
    n = points.count()
    shards = min(MOST_SHARDS, max(1, -(-n // SHARD_POINTS)))
    wanted = shards * SAMPLE_A_SHARD
    part = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.lit(1 << 30))
    sample = points.where(part < int(2 * wanted / max(n, 1) * (1 << 30)) + 1) if n > 2 * wanted else points
    sample = sample.select("fingerprint", F.xxhash64("fingerprint", F.lit(2)).alias("by")).orderBy("by").limit(wanted).collect()
    tree = Tree(np.array([r[0] for r in sample], np.int64).view(np.uint64), shards, most)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fingerprint").to_numpy()
            at, shard = tree.dealt(values.view(np.uint64))
            yield pa.record_batch([pa.array(shard), pa.array(values[at])], names=["shard", "fingerprint"])

    def forest(rows: pa.Table) -> pa.Table:
        a, b = shard_forest(rows.column("fingerprint").combine_chunks().to_numpy().view(np.uint64), most)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = points.select("fingerprint").mapInArrow(deal, "shard int, fingerprint long")
    return dealt.groupBy("shard").applyInArrow(forest, "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row a row of ``docs``: doc_id, fingerprint (16 lowercase hexadecimal digits), component_id.

    Fingerprints link at ``most`` or fewer differing bits (at least 1), equal ones always; ``component_id`` is the least
    id that links reach, the row's own included. Null, empty and wordless texts have fingerprint zero and are linked
    like any other. A null id takes part, but is least only where its component has no other; repeated rows are rows.
    Very long texts are read whole. An empty table gives no rows; other columns make no difference.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield pa.record_batch([block.column("doc_id"), pa.array(fingerprints(block.column("text")).view(np.int64))], names=["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(slim.mapInArrow(signed, "doc_id long, fingerprint long"), "simhash-rows")
    points = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-points")
    labels = components(links(points, most)).select(F.col("node").alias("fingerprint"), "label")
    placed = points.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    found = stored(placed.join(placed.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fingerprint", "n", "component_id"), "simhash-classes")
    hot = found.where(F.col("n") * HOT_PARTS >= rows.count())
    many = rows.join(F.broadcast(hot.drop("n")), "fingerprint")
    few = rows.join(F.broadcast(hot.select("fingerprint")), "fingerprint", "left_anti").join(found.drop("n"), "fingerprint")
    return many.unionByName(few).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op11_simhash_dedup": op11_simhash_dedup}
ORACLES: dict[str, str] = {}
