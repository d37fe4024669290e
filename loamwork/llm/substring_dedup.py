"""Substring dedup: suffixes split by variable-length prefixes, repeats read off deep nodes of their subtrees.

A window of 20 words that starts later than an equal one is a repeat, and the words that repeats cover are removed.
In the suffix tree of the corpus such windows are the leaves but the first below an internal node at a depth of 20 words
or more. The tree is never built whole:

* Texts are dealt into blocks of ``BLOCK`` bytes. A block builds the subtrees of its own suffixes, grouped by their leading
  words and then deeper, and of each depth-20 node sends the first leaf alone: the other leaves are repeats whatever
  other blocks hold. So no node, however common, has more rows than there are blocks.
* Between blocks a window's prefix is the run of ``LENGTHS[0]`` words with the least hash that the window holds. Equal windows have
  equal prefixes, and windows that follow each other mostly share theirs, so they travel as one row with the words of
  all. Prefixes that one block alone holds lead to no node and are left out.
* A prefix of more than ``GROUP`` rows grows: its windows take the least run of the next length instead, up to the
  whole window. So every group fits into memory but those of a single node, whose first leaf is found in two rounds,
  by ``SALTS`` parts of the node and then among the parts' first leaves.
* Each group's subtree is built from the words of its suffixes: ranks by one word, by two, by four and then by four more
  at a time are its nodes at those depths. All leaves of a depth-20 node but the first, by (document, place), are
  repeats, and stretches of them are the maximal repeats that are removed.

Words are told apart by 64 bits each; nodes are compared word by word, never by hashes of windows.

Blocks wait compressed in the shared folder as a bucketed table, a row a block, so that prefixes and repeats come to the
texts and the texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.sentencepiece_codec import spread
from loamwork.llm.shared import Words, blocks, delete_on_exit, shared_dir, stored, window_hashes
from loamwork.sources.tables import table

WINDOW, LENGTHS = 20, (4, 8, 12, 20)
BLOCK, PART = 4 << 20, 1 << 19
#: Rows of a group that is built at once, of at most WINDOW * 2 words each, and rows that are built together.
GROUP, TOGETHER = 100_000, 20_000
SALTS = 64
#: Null ids come first; whether an id is null is kept beside it.
NULL_ID = -(1 << 63)


def bucket_of(x: int, n: int) -> int:
    """The bucket of a long among ``n``: Spark's hash with seed 42, modulo n."""
    m32, h = 0xFFFFFFFF, 42
    turn = lambda v, r: ((v << r) | (v >> (32 - r))) & m32
    for word in (x & m32, (x >> 32) & m32):
        h ^= (turn((word * 0xCC9E2D51) & m32, 15) * 0x1B873593) & m32
        h = (turn(h, 13) * 5 + 0xE6546B64) & m32
    h ^= 8
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & m32
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & m32
    h ^= h >> 16
    return (h - (1 << 32) if h >> 31 else h) % n


def packed_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, texts): each task's rows in Arrow files of about BLOCK bytes of text, by document id; a bucketed table.

    A task names its blocks so that all fall into one bucket, and writes one file.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, size = TaskContext.get().partitionId(), [], 0
        names = (x for x in range(task << 32, (task + 1) << 32) if bucket_of(x, n) == task % n)

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(waiting).sort_by([("doc_id", "ascending"), ("known", "ascending")]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(rows)
            return pa.record_batch([pa.array([next(names)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

        for part in blocks(batches, "text", PART):
            waiting.append(part)
            size += part.column("text").nbytes
            if size >= BLOCK:
                yield out()
                waiting, size = [], 0
        if waiting:
            yield out()

    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    slim.mapInArrow(packed, "block long, texts binary").write.format("parquet").bucketBy(n, "block").sortBy("block").option("compression", "none").option("path", path).saveAsTable(name)
    delete_on_exit(spark, path)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files stay for what reads them
    return texts


class Block:
    """A block's rows with the hashes of all their words; ``end``: for each word, the place after its text's last one."""

    def __init__(self, texts: bytes) -> None:
        rows = pa.ipc.open_stream(texts).read_all().combine_chunks()
        self.doc_id, self.known = rows.column("doc_id").to_numpy(), rows.column("known").to_numpy(zero_copy_only=False)
        self.text = rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.string())
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in blocks(iter([pa.record_batch([self.text], names=["text"])]), "text", PART):
            words = Words(part.column("text"))
            hashes.append(words.hash)
            counts.append(words.count)
        self.hash, self.count = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.end = np.repeat(self.first[1:], self.count)

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where whole windows start, in order of (document, place): the first leaf of each depth-20 node, and all others.

        The block's own subtrees give the nodes; a window that no other equals is the only leaf of its own.
        """
        long = self.count >= WINDOW
        words = self.hash if long.all() else self.hash[np.repeat(long, self.count)]
        at, node = deep_nodes(words, self.count[long])
        start = at + np.repeat((self.first[:-1] - (np.cumsum(self.count * long) - self.count * long))[long], self.count[long] - (WINDOW - 1))
        inner = np.flatnonzero(node >= 0)
        later = np.zeros(len(at), bool)
        later[inner] = True
        later[inner[np.unique(node[inner], return_index=True)[1]]] = False
        return start[~later], start[later]

    def prefixes(self, at: np.ndarray, length: int) -> np.ndarray:
        """The least hash of the runs of ``length`` words in each window that starts at ``at``."""
        least, _ = window_hashes(self.hash, self.end, length, 7)
        reach, want = 1, WINDOW - length + 1
        while 2 * reach <= want:
            least[: len(least) - reach] = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        return np.minimum(least[at], least[at + want - reach]).view(np.int64)

    def settled(self, at: np.ndarray, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at ``at``: which are in a group, their levels and prefixes, and which have yet to grow, as the prefixes in ``known`` say.

        ``known``: (level, prefix, grows) of this block's prefixes that other blocks hold, too.
        """
        level, prefix = np.full(len(at), -1), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        names, grows, levels = known.column("prefix").to_numpy(), known.column("grows").to_numpy(zero_copy_only=False), known.column("level").to_numpy()
        for i in range(len(LENGTHS)):
            of_level = np.flatnonzero(levels == i)
            if not len(open_) or not len(of_level):
                break
            of_level = of_level[np.argsort(names[of_level])]
            keys = names[of_level]
            mine = self.prefixes(at[open_], LENGTHS[i])
            near = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[near] == mine
            more = hit & grows[of_level][near] if i < len(LENGTHS) - 1 else np.zeros(len(hit), bool)
            done = open_[hit & ~more]
            level[done], prefix[done] = i, mine[hit & ~more]
            open_ = open_[more]
        return level, prefix, open_


def stretches(at: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices where runs of consecutive places begin, and the runs' lengths; ``apart`` marks further beginnings."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    if apart is not None:
        new[1:] |= apart
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(at)))


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("block")[i].as_py(), Block(batch.column("texts")[i].as_py())


KEYS = pa.schema({"prefix": pa.int64(), "block": pa.int64(), "n": pa.int32()})


def counted_prefixes(name: int, at: np.ndarray, prefix: np.ndarray) -> pa.Table:
    """How many rows each prefix of the block's windows would make."""
    begin, _ = stretches(at, prefix[1:] != prefix[:-1])
    keys, n = np.unique(prefix[begin], return_counts=True)
    return pa.table([pa.array(keys), pa.array(np.full(len(keys), name, np.int64)), pa.array(n.astype(np.int32))], schema=KEYS)


def block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for name, block in each_block(batches):
        at = block.leaves()[0]
        yield from counted_prefixes(name, at, block.prefixes(at, LENGTHS[0])).to_batches(1 << 16)


def grown_keys(level: int):
    def keys(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows or not known.num_rows:
            return KEYS.empty_table()
        name, block = next(each_block(iter(texts.combine_chunks().to_batches())))
        at = block.leaves()[0]
        some = at[block.settled(at, known)[2]]
        return counted_prefixes(name, some, block.prefixes(some, LENGTHS[level]))

    return keys


RUNS = pa.schema({"prefix": pa.int64(), "level": pa.int32(), "doc_id": pa.int64(), "block": pa.int64(), "at": pa.int32(), "words": pa.binary()})
RUNS_DDL = "prefix long, level int, doc_id long, block long, at int, words binary"


def runs(texts: pa.Table, known: pa.Table) -> pa.Table:
    """The block's first leaves of nodes that other blocks may have, too: a row a stretch of one group, with its words."""
    if not texts.num_rows or not known.num_rows:
        return RUNS.empty_table()
    name, block = next(each_block(iter(texts.combine_chunks().to_batches())))
    at = block.leaves()[0]
    level, prefix, _ = block.settled(at, known)
    some = level >= 0
    at, level, prefix = at[some], level[some], prefix[some]
    begin, length = stretches(at, (prefix[1:] != prefix[:-1]) | (level[1:] != level[:-1]) | (level[1:] == len(LENGTHS) - 1))
    size = length + WINDOW - 1
    words = spread(block.hash, at[begin], size)
    offsets = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
    row = np.searchsorted(block.first, at[begin], "right") - 1
    columns = [prefix[begin], level[begin].astype(np.int32), block.doc_id[row], np.full(len(begin), name, np.int64), at[begin].astype(np.int32)]
    return pa.table([*map(pa.array, columns), packed], schema=RUNS)


def deep_nodes(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of rows of ``size`` words, as places in ``words`` in order, and the depth-20 node of each.

    A rank is a node; ranks at depth 2 and 4 come from pairs of those at half the depth, and deeper ones from the node
    above and the rank of the next four words. Only suffixes that still share theirs
    with another one go deeper, as leaves of their own have no internal node below.
    """
    first = np.cumsum(size) - size
    windows = size - (WINDOW - 1)
    at = np.repeat(first - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    n = len(words)
    rank = {1: np.unique(words, return_inverse=True)[1].astype(np.int64)}
    for depth in (1, 2):  # up to 4 words for all places, as deeper ranks of suffixes look ahead
        ahead = np.minimum(np.arange(n) + depth, n - 1)
        rank[2 * depth] = np.unique(rank[depth] * (n + 1) + rank[depth][ahead], return_inverse=True)[1].astype(np.int64)
    node, live = rank[4][at], np.arange(len(at))
    for depth in range(4, WINDOW, 4):
        shared = np.bincount(node[live], minlength=1)[node[live]] > 1
        node[live[~shared]] = -1
        live = live[shared]
        if not len(live):
            break
        node[live] = np.unique(node[live] * (n + 1) + rank[4][at[live] + depth], return_inverse=True)[1]
    return at, node


REPEATS = pa.schema({"block": pa.int64(), "at": pa.int32(), "n": pa.int32()})


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats of groups that come sorted by (level, prefix, doc_id, block, at), as stretches of places."""

    def built(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        packed = rows.column("words").combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        words = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)
        size = np.diff(offsets) // 8
        at, node = deep_nodes(words, size)
        inner = np.flatnonzero(node >= 0)
        later = np.ones(len(inner), bool)
        later[np.unique(node[inner], return_index=True)[1]] = False
        later = inner[later]
        row = np.repeat(np.arange(len(size)), size - (WINDOW - 1))[later]
        place = rows.column("at").to_numpy()[row] + (at[later] - (np.cumsum(size) - size)[row])
        begin, length = stretches(place, row[1:] != row[:-1])
        return pa.record_batch([pa.array(rows.column("block").to_numpy()[row[begin]]), pa.array(place[begin].astype(np.int32)), pa.array(length.astype(np.int32))], schema=REPEATS)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= TOGETHER:
            rows = pa.Table.from_batches(waiting)
            prefix = rows.column("prefix").to_numpy()
            cut = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if (prefix != prefix[-1]).any() else 0
            if cut:
                yield built(rows.slice(0, cut))
                waiting = rows.slice(cut).combine_chunks().to_batches()
    if waiting and sum(b.num_rows for b in waiting):
        yield built(pa.Table.from_batches(waiting))


KEPT = pa.schema({"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "repeats": pa.string()})


def removed(texts: pa.Table, repeats: pa.Table) -> pa.Table:
    """The block's documents without the words that repeats cover."""
    if not texts.num_rows:
        return KEPT.empty_table()
    _, block = next(each_block(iter(texts.combine_chunks().to_batches())))
    own = block.leaves()[1]
    at, n = repeats.column("at").to_numpy().astype(np.int64), repeats.column("n").to_numpy().astype(np.int64)
    change = np.zeros(len(block.hash) + 1, np.int64)
    np.add.at(change, np.concatenate([own, at]), 1)
    np.add.at(change, np.concatenate([own + WINDOW, at + n + WINDOW - 1]), -1)
    gone = np.cumsum(change)[:-1] > 0
    digests, spans, row = [], [], 0
    for part in blocks(iter([pa.record_batch([block.text], names=["text"])]), "text", PART):
        words = Words(part.column("text"))
        data = np.append(words.data, np.uint8(0x20))
        n = len(words.start)
        stay = ~gone[block.first[row] : block.first[row] + n]
        begin, size = words.start[stay], words.end[stay] - words.start[stay] + 1
        kept = spread(data, begin, size)
        kept[np.cumsum(size) - 1] = 0x20
        upto = np.concatenate([[0], np.cumsum(np.bincount(words.doc[stay], weights=size, minlength=part.num_rows).astype(np.int64))])
        for i in range(part.num_rows):
            digests.append(hashlib.sha256(kept[upto[i] : max(upto[i], upto[i + 1] - 1)].tobytes()).hexdigest())
            lost = np.flatnonzero(np.diff(np.concatenate([[False], gone[block.first[row] : block.first[row + 1]], [False]]).astype(np.int8)))
            spans.append(",".join(f"{a}:{b}" for a, b in lost.reshape(-1, 2).tolist()))
            row += 1
    lost = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(block.first[:-1], len(gone))) * (block.count > 0)
    ids = pa.array(block.doc_id, mask=~block.known)
    return pa.table([ids, pa.array(block.count), pa.array(lost), pa.array(digests, pa.string()), pa.array(spans, pa.string())], schema=KEPT)


def shared_prefixes(texts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(block, level, prefix, grows) of all prefixes that several blocks hold, and the number of levels; prefixes with more than ``most`` rows grow."""
    known = None
    for level in range(len(LENGTHS)):
        if level == 0:
            keys = texts.mapInArrow(block_keys, "prefix long, block long, n int")
        else:
            keys = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(grown_keys(level), "prefix long, block long, n int")
        keys = stored(keys, "suffix-keys")
        sizes = keys.groupBy("prefix").agg(F.sum("n").alias("rows"), F.count("*").alias("blocks")).where("blocks > 1").select("prefix", (F.col("rows") > most).alias("grows"))
        here = stored(keys.join(sizes, "prefix").select("block", F.lit(level).alias("level"), "prefix", "grows"), "suffix-shared")
        known = here if known is None else known.unionByName(here)
        if here.where("grows").isEmpty():
            break
    return known, level + 1


def single_nodes(rows: DataFrame) -> DataFrame:
    """The repeats among rows of one window each: all rows of a node but the first, in two rounds so that no node lies in one task."""
    order = Window.orderBy("doc_id", "block", "at")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    salted = salted.withColumn("nth", F.row_number().over(order.partitionBy("prefix", "words", "salt")))
    again = salted.where(F.col("nth") == 1).withColumn("nth", F.row_number().over(order.partitionBy("prefix", "words")))
    return salted.unionByName(again).where(F.col("nth") > 1).select("block", "at", F.lit(1).alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_removed, kept_sha256, repeats (``from:to`` in words, end exclusive).

    Null and empty texts have no words. Rows with a null id come before all others; rows of one id are told apart, and
    one of them, always the same within a block, counts as the earlier. An empty table gives no rows, other columns
    make no difference, and a text of any length is taken whole, in one block.
    """
    texts = packed_blocks(docs, id_col, text_col)
    by_block = texts.groupBy("block")
    known, levels = shared_prefixes(texts, GROUP)
    rows = by_block.cogroup(known.groupBy("block")).applyInArrow(runs, RUNS_DDL)
    whole = F.col("level") == len(LENGTHS) - 1
    if levels == len(LENGTHS):
        rows = stored(rows, "suffix-runs")
    groups = rows if levels < len(LENGTHS) else rows.where(~whole)
    repeats = groups.repartition("prefix").sortWithinPartitions("level", "prefix", "doc_id", "block", "at").mapInArrow(subtrees, "block long, at int, n int")
    if levels == len(LENGTHS):
        repeats = repeats.unionByName(single_nodes(rows.where(whole)))
    return by_block.cogroup(repeats.groupBy("block")).applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
OP9_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w WHERE len(w) >= {WINDOW})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM e) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM r),
s AS (SELECT doc_id, min(i) - 1 AS a, max(i) AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g) GROUP BY doc_id, island),
t AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS repeats, CAST(sum(b - a) AS BIGINT) AS n FROM s GROUP BY doc_id),
u AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) > 0) z ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(repeats, '') AS repeats
FROM w LEFT JOIN t USING (doc_id) LEFT JOIN u USING (doc_id)
"""
ORACLES = {"op9_substring_dedup": OP9_SQL}
