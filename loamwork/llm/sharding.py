"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups sorted by size, largest first, go to the least-loaded
shard, kept in a heap. Groups of one size are interchangeable, so the driver needs only the number of groups of each
size. Sizes of ``EXACT_BITS`` bits or fewer count as they are; larger ones are classes by their leading bits, whose
groups differ by less than one in 2**14 and count as their mean. So the driver holds at most a fixed number of classes,
about half a million, whatever the corpus, and texts of any length. Each class comes back with how many of its groups every shard takes; a
group finds its shard by its rank among its equals.

No step gathers one key: a group's rows are dealt by (text, salt), ranks and slots are counted in hashed buckets first
and then within each, and the plan meets a class's buckets before these meet the groups.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.shared import stored
from loamwork.sources.tables import table

SALTS, RANK_BUCKETS, SLOT_BUCKETS, EXACT_BITS = 64, 4096, 256, 15


def spread(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` bytes each shard takes when each goes to the least (load, index).

    The j-th group of shard i is placed at load ``loads[i] + j * size``; the ``count`` smallest of these are taken, all
    below a level found by bisection at once and the rest through the heap.
    """
    below = lambda level: sum(-(-(level - x) // size) for x in loads if x < level)
    taken = [0] * len(loads)
    if count > 2 * len(loads):
        low, high = min(loads), max(loads) + size * count
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if below(middle) <= count else (low, middle)
        taken = [max(0, -(-(low - x) // size)) for x in loads]
    heap = [(x + k * size, i) for i, (x, k) in enumerate(zip(loads, taken, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, i = heap[0]
        taken[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return taken


def schedule(sizes: list[tuple[int, int]], shards: int) -> pa.Table:
    """For each (size, number of groups): the shards that take some, and up to which rank each does."""
    loads, rows = [0] * shards, {"group_bytes": [], "till": [], "takes": []}
    for size, count in sorted(sizes, reverse=True):
        taken = spread(loads, size, count)
        till, takes, upto = [], [], 0
        for i, k in enumerate(taken):
            loads[i] += k * size
            if k:
                upto += k
                till.append(upto)
                takes.append(i)
        for name, value in zip(rows, (size, till, takes), strict=True):
            rows[name].append(value)
    return pa.table(rows, schema=pa.schema({"group_bytes": pa.int64(), "till": pa.list_(pa.int64()), "takes": pa.list_(pa.int32())}))


def size_class(size: Column) -> Column:
    """The size itself if it has at most ``EXACT_BITS`` bits, else its number of further bits and its leading ones."""
    further = F.greatest(F.length(F.bin(size)) - EXACT_BITS, F.lit(0))
    return further.cast("long") * (1 << 20) + F.call_function("shiftright", size, further.cast("int")).cast("long")


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot in it.

    Law ``bytes``: the shards' sums of UTF-8 bytes plus ``overhead`` a row are near equal, as far as whole groups allow.
    Texts of any length are taken whole. A null text has no bytes, CRC 0, and all null texts are one group, apart from the empty texts. A null id is kept;
    repeated rows each get a slot. Other columns of ``docs`` are left out. An empty input gives no rows.
    """
    text, spark = F.col(text_col), docs.sparkSession
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("none")).alias("key"),
            F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias("salt"),
        ),
        "shard-rows",
    )
    units = rows.groupBy("key", "salt").agg(F.sum("size").alias("bytes"))
    groups = units.groupBy("key").agg(F.sum("bytes").alias("group_bytes")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(RANK_BUCKETS)).cast("int"))
    groups = stored(groups.withColumn("kind", size_class(F.col("group_bytes"))), "shard-groups")
    kinds = {round(total / n): (kind, n) for kind, n, total in groups.groupBy("kind").agg(F.count("*"), F.sum("group_bytes")).toLocalIterator()}
    plan = schedule([(mean, n) for mean, (_, n) in kinds.items()], shards)
    plan = plan.append_column("kind", pa.array([kinds[mean][0] for mean in plan.column("group_bytes").to_pylist()], pa.int64())).drop_columns(["group_bytes"])

    counts = groups.groupBy("kind", "bucket").count()
    offset = F.sum("count").over(Window.partitionBy("kind").orderBy("bucket")) - F.col("count")
    planned = counts.select("kind", "bucket", offset.alias("offset")).join(spark.createDataFrame(plan), "kind")
    ranked = groups.withColumn("row", F.row_number().over(Window.partitionBy("kind", "bucket").orderBy("key")))
    rank = F.col("offset") + F.col("row") - 1
    taker = F.element_at("takes", F.size(F.filter("till", lambda t: t <= rank)) + 1)
    placed = ranked.join(planned, ["kind", "bucket"]).select("key", taker.alias("shard"))

    of_unit = units.select("key", "salt").join(placed, "key")
    bucket = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BUCKETS)).cast("int")
    assigned = stored(rows.join(of_unit, ["key", "salt"]).select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "shard-assigned")
    # at most shards * SLOT_BUCKETS rows
    starts = assigned.groupBy("shard", "bucket").count()
    starts = starts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    numbered = assigned.withColumn("row", slot).join(F.broadcast(starts), ["shard", "bucket"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLES: dict[str, str] = {}
