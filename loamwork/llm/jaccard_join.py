"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles (all words, if there are fewer); rows with equal texts are one unit. MinHash
bands of four rows bring units into buckets: at similarity 0.8, 24 bands miss a pair with probability 3e-6.

1. Buckets of up to ``SMALL_BUCKET`` units compare their members' sketches, one byte of each of 48 MinHash values, in
   steps. After each step a pair is dropped if, given its matches so far, the posterior probability (uniform prior) that
   its similarity reaches the threshold is below ``TOLERANCE``; of those left a spanning forest goes on. The members of a
   larger bucket are compared with its first in the same way and tied to it if they pass. If at most ``SMALL_BUCKET``
   don't, all members are compared with these. If more don't, as where boilerplate fills the bucket, all members go on
   to buckets split by four more MinHash values each, in ``FURTHER`` ways at once. Members that share sixteen values are
   tied to their first.
2. The edges' connected components hold every candidate pair. Components are dealt into bins; one of more than ``TILE``
   units or ``TILE_BYTES`` of shingles is dealt into tiles, and every pair of its tiles is a task, so that no group lies
   whole in a task.
3. In a task all pairs are pruned again in the same way by whole MinHash values, and those left are verified exactly
   on the shingles. A task returns a row a unit: its links, and the least unit that it reaches in the task.
4. Components of these are the classes.

Pairs are never listed, so a large group of near copies gives as many rows as it has documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.graph import components
from loamwork.llm.shared import Words, blocks, fresh, mixed, spanning, stored
from loamwork.sources.tables import table

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, SKETCH = 24, 4, 48
TOLERANCE, STEP = 1e-6, 16
SMALL_BUCKET, FURTHER = 64, (4, 3, 3)
#: Most units and bytes of shingles of a tile, and of a bin of small components.
TILE, TILE_BYTES, BIN_UNITS, BIN_BYTES = 512, 24 << 20, 1500, 48 << 20

_K = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
FLIPS, FACTORS = mixed(_K, 71), mixed(_K, 73) | np.uint64(1)


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, one row after the other, and the rows' offsets. No word: no shingle."""
    hashes, whole = words.windows(SHINGLE)
    row = words.doc[whole]
    value = hashes[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        whole_text = []
        for r in short:
            part = words.hash[words.first[r] : words.first[r + 1]]
            whole_text.append(mixed((part * FACTORS[: len(part)]).sum(dtype=np.uint64)[None], 900 + len(part))[0])
        row, value = np.append(row, short), np.append(value, np.array(whole_text, np.uint64))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(words.count) + 1))


def minhashes(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows with shingles, BANDS * ROWS) least hashes of 32 bits."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), len(FLIPS)), np.uint32)
    if len(starts):
        for k in range(len(FLIPS)):
            out[:, k] = np.minimum.reduceat(((value ^ FLIPS[k]) * FACTORS[k]) >> np.uint64(32), starts)
    return out


@functools.lru_cache
def least_matches(total: int, step: int, threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = step, 2 * step ... total values compared: the fewest matches at which a pair is kept.

    The posterior of the similarity after m matches of n is Beta(m + 1, n - m + 1); its upper tail comes from a sum
    over a fine grid.
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            if density[x >= threshold].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survive(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of rows stay after the comparison in steps, as places."""
    live, matched = np.arange(len(left)), np.zeros(len(left), np.int32)
    for i, least in enumerate(least_matches(left.shape[1], STEP, threshold, TOLERANCE)):
        part = slice(i * STEP, (i + 1) * STEP)
        matched[live] += (left[live, part] == right[live, part]).sum(axis=1, dtype=np.int32)
        live = live[matched[live] >= least]
        if not len(live):
            break
    return live


def signed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, doc_id, key, n, marks): marks are the MinHash values, ``n`` the number of shingles."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            value, at = shingle_sets(Words(block.column("text")))
            marks, n = minhashes(value, at), np.diff(at)
            raw, nth = marks.tobytes(), np.cumsum(n > 0) - 1
            width = 4 * len(FLIPS)
            packed = [raw[j * width : (j + 1) * width] if some else b"" for j, some in zip(nth.tolist(), n > 0, strict=True)]
            yield pa.record_batch([block.column("doc_id"), block.column("key"), pa.array(n.astype(np.int32)), pa.array(packed, pa.binary())], names=["doc_id", "key", "n", "marks"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.md5(text_col), F.lit("none")).alias("key"))
    rows = slim.mapInArrow(signed, "doc_id long, key string, n int, marks binary")
    return stored(rows.withColumn("rid", F.monotonically_increasing_id()), "jaccard-rows")


def band_rows(units: DataFrame) -> DataFrame:
    """(bucket, rid, sketch): a row a unit and band."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                marks = np.frombuffer(b"".join(part.column("marks").to_pylist()), np.uint32).reshape(part.num_rows, BANDS, ROWS)
                mix = np.zeros((part.num_rows, BANDS), np.uint64)
                for r in range(ROWS):
                    mix = mixed(mix ^ marks[:, :, r].astype(np.uint64), 7 + r)
                mix = mixed(mix + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 3)
                sketch = marks.reshape(part.num_rows, -1)[:, -SKETCH:].astype(np.uint8)
                rid = np.repeat(part.column("rid").to_numpy(), BANDS)
                packed = np.repeat(np.array([x.tobytes() for x in sketch], object), BANDS)
                yield pa.record_batch([pa.array(mix.reshape(-1).view(np.int64)), pa.array(rid), pa.array(packed, pa.binary())], names=["bucket", "rid", "sketch"])

    return units.select("rid", "marks").mapInArrow(banded, "bucket long, rid long, sketch binary")


def sketches(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.uint8).reshape(len(array), SKETCH)


def bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of small buckets, whose rows come together; the last bucket of a batch waits for the next."""
    rest: list[pa.RecordBatch] = []

    def edges(rows: pa.Table) -> pa.RecordBatch:
        bucket, rid, sketch = rows.column("bucket").to_numpy(), rows.column("rid").to_numpy(), sketches(rows.column("sketch").combine_chunks())
        found = [(rid[:0], rid[:0])]
        for shift in range(1, SMALL_BUCKET):
            at = np.flatnonzero(bucket[shift:] == bucket[:-shift]) if len(bucket) > shift else np.zeros(0, np.int64)
            if not len(at):
                break
            keep = at[survive(sketch[at], sketch[at + shift])]
            found.append((rid[keep], rid[keep + shift]))
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return pa.record_batch([pa.array(x) for x in spanning(a, b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*rest, batch]).combine_chunks()
        bucket = rows.column("bucket").to_numpy()
        start = int(np.flatnonzero(bucket == bucket[-1])[0])
        yield edges(rows.slice(0, start))
        rest = rows.slice(start).to_batches()
    if rest:
        yield edges(pa.Table.from_batches(rest))


def leader_tests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, rid, sketch, leader, near): whether a member may be similar to its bucket's leader."""
    for batch in batches:
        if batch.num_rows:
            near = np.zeros(batch.num_rows, bool)
            near[survive(sketches(batch.column("sketch")), sketches(batch.column("lead")))] = True
            yield pa.record_batch([*(batch.column(c) for c in ("bucket", "rid", "sketch", "leader")), pa.array(near)], names=["bucket", "rid", "sketch", "leader", "near"])


def far_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between members of a bucket and those few of it that are not near its leader."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            far = part.column("far")
            at = np.repeat(np.arange(part.num_rows), far.value_lengths().to_numpy())
            rid, other = part.column("rid").to_numpy()[at], far.flatten().field("rid").to_numpy()
            sketch = sketches(part.column("sketch"))[at]
            kept = survive(sketch, sketches(far.flatten().field("sketch")))
            kept = kept[rid[kept] != other[kept]]
            yield pa.record_batch([pa.array(x) for x in spanning(rid[kept], other[kept])], names=["a", "b"])


def sketch_of(units: DataFrame) -> DataFrame:
    """(rid, sketch), as ``band_rows`` has it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint32).reshape(batch.num_rows, BANDS * ROWS)
            yield pa.record_batch([batch.column("rid"), pa.array([x.tobytes() for x in marks[:, -SKETCH:].astype(np.uint8)], pa.binary())], names=["rid", "sketch"])

    return units.select("rid", "marks").mapInArrow(cut, "rid long, sketch binary")


def candidate_edges(units: DataFrame) -> DataFrame:
    """Edges whose components hold every candidate pair; no large bucket is brought together, nor its pairs listed."""
    rows, found = band_rows(units), []
    for depth in range(len(FURTHER) + 1):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rid").alias("leader")).where(F.col("n") > SMALL_BUCKET)
        large = stored(sizes.select("bucket", "leader"), "jaccard-large")
        few = rows.join(large.select("bucket"), "bucket", "left_anti")
        found.append(few.repartition("bucket").sortWithinPartitions("bucket", "rid").mapInArrow(bucket_edges, "a long, b long"))
        if not large.limit(1).count():
            break
        leads = stored(large.join(sketch_of(units.join(large.select(F.col("leader").alias("rid")).distinct(), "rid", "left_semi")).withColumnsRenamed({"rid": "leader", "sketch": "lead"}), "leader"), "jaccard-leads")
        tested = stored(rows.join(leads, "bucket").mapInArrow(leader_tests, "bucket long, rid long, sketch binary, leader long, near boolean"), "jaccard-tested")
        tied = tested.where("rid <> leader" if depth == len(FURTHER) else "rid <> leader and near")
        found.append(tied.select(F.col("leader").alias("a"), F.col("rid").alias("b")))
        if depth < len(FURTHER):
            counted = stored(tested.where("not near").groupBy("bucket").agg(F.count("*").alias("n")), "jaccard-far")
            few_far = tested.where("not near").join(counted.where(F.col("n") <= SMALL_BUCKET), "bucket").groupBy("bucket").agg(F.collect_list(F.struct("rid", "sketch")).alias("far"))
            found.append(tested.select("bucket", "rid", "sketch").join(few_far, "bucket").select("rid", "sketch", "far").mapInArrow(far_edges, "a long, b long"))
            mixed_ = counted.where(F.col("n") > SMALL_BUCKET).select("bucket")
            first = 1 + 4 * sum(FURTHER[:depth])
            ways = F.explode(F.array(*(F.xxhash64("bucket", F.lit(w), F.substring("sketch", first + 4 * w, 4)) for w in range(FURTHER[depth]))))
            rows = tested.join(mixed_, "bucket", "left_semi").select(ways.alias("bucket"), "rid", "sketch")
    return functools.reduce(DataFrame.unionByName, found)


LINKS = pa.schema({"rid": pa.int64(), "links": pa.int64(), "root": pa.int64()})


def tile_links(rows: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """Links of the units of a task: of each component's pairs, or of the pairs between two tiles of one component."""
    rows = rows.combine_chunks()
    component, tile, rid = (rows.column(c).to_numpy() for c in ("component", "tile", "rid"))
    copies, sets = rows.column("copies").to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("shingles")]
    order = np.lexsort((rid, tile, component))
    out: list[np.ndarray] = []
    bounds = np.flatnonzero(np.diff(component[order], prepend=-1, append=-2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        some = order[a:b]
        some = some[np.concatenate([[True], rid[some][1:] != rid[some][:-1]])]
        tiles = np.unique(tile[some])
        left = some[tile[some] == tiles[0]]
        right = left if len(tiles) == 1 else some[tile[some] == tiles[1]]
        # one tile with itself is only for the task of that tile; rows say how many tiles their task has
        out.append(linked([sets[i] for i in left], [sets[i] for i in right], rid[left], rid[right], copies[left], copies[right], len(tiles) == 1, threshold))
    found = np.concatenate([*out, np.zeros((0, 3), np.int64)])
    return pa.table([pa.array(found[:, k]) for k in range(3)], schema=LINKS)


def linked(left: list, right: list, left_id, right_id, left_n, right_n, same: bool, threshold: float) -> np.ndarray:
    """(rid, linked rows, least rid reached) of units with links between the two sides."""
    marks = [minhashes(np.concatenate(side), np.concatenate([[0], np.cumsum([len(x) for x in side])])) for side in ((left,) if same else (left, right))]
    i, j = np.triu_indices(len(left), 1) if same else (x.ravel() for x in np.indices((len(left), len(right))))
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    fits = np.minimum(size_l[i], size_r[j]) >= threshold * np.maximum(size_l[i], size_r[j]) - 1e-9
    i, j = i[fits], j[fits]
    kept = np.concatenate([a + survive(marks[0][i[a : a + 50_000]], marks[-1][j[a : a + 50_000]], threshold) for a in range(0, len(i), 50_000)] or [np.zeros(0, np.int64)])
    i, j = i[kept], j[kept]
    common = intersections(left, right, i, j)
    yes = common >= threshold * (size_l[i] + size_r[j] - common) - 1e-9
    i, j = i[yes], j[yes]
    ids = np.concatenate([left_id, [] if same else right_id]).astype(np.int64)
    links, least = np.zeros(len(ids), np.int64), ids.copy()
    j_at = j if same else j + len(left)
    np.add.at(links, i, right_n[j])
    np.add.at(links, j_at, left_n[i])
    while len(i):
        before = least.copy()
        low = np.minimum(least[i], least[j_at])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j_at, low)
        if (before == least).all():
            break
    some = links > 0
    return np.stack([ids[some], links[some], least[some]], axis=1)


def intersections(left: list, right: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs: one by one if few, else for each left set against all right ones at once."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    flat, owner = np.concatenate(right), np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    by_left = np.argsort(i, kind="stable")
    bounds = np.flatnonzero(np.diff(i[by_left], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        pairs = by_left[a:b]
        one = left[i[pairs[0]]]
        if len(pairs) <= 4:
            for p in pairs:
                other = right[j[p]]
                near = np.minimum(np.searchsorted(other, one), len(other) - 1)
                out[p] = (other[near] == one).sum()
            continue
        low, high = np.searchsorted(flat, one, "left"), np.searchsorted(flat, one, "right")
        n = high - low
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[pairs] = np.bincount(owner[hit], minlength=len(right))[j[pairs]]
    return out


def tile_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        value, at = shingle_sets(Words(block.column("text")))
        packed = [value[at[r] : at[r + 1]].tobytes() for r in range(block.num_rows)]
        yield pa.record_batch([*(block.column(c) for c in ("rid", "component", "copies", "tiles")), pa.array(packed, pa.binary())], names=["rid", "component", "copies", "tiles", "shingles"])


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of ``docs``: doc_id, class_id, n_links, n_shingles, is_first, text_key (MD5 of the text, or ``none``).

    ``n_links``: other rows with Jaccard similarity of at least 0.8, equal texts included. ``class_id``: least id of
    the rows that links connect. ``is_first``: the one row of its class that stays when near copies go, the least by id
    and then by the text's key. Rows without a
    word have no links and a class of their own each. A null id takes part and sorts first; repeated rows are rows. An
    empty table gives no rows, other columns make no difference, and texts of any length are taken whole.
    """
    rows = signed_rows(docs, id_col, text_col)
    reps = stored(rows.where("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "rid")).alias("least"), F.count("*").alias("copies"), F.max("n").alias("n")).select("key", "least.*", "copies", "n"), "jaccard-units")
    units = rows.select("rid", "marks").join(reps.select("rid"), "rid", "left_semi")
    near = stored(components(candidate_edges(units)), "jaccard-components")
    weighed = near.join(reps.select(F.col("rid").alias("node"), "n"), "node")
    sizes = weighed.groupBy("label").agg(F.count("*").alias("size"), (8 * F.sum("n")).alias("bytes"))
    tiles = F.ceil(F.greatest(F.col("size") / TILE, F.col("bytes") / TILE_BYTES)).cast("int")
    members = near.join(sizes, "label").select(F.col("node").alias("rid"), F.col("label").alias("component"), tiles.alias("tiles"))
    members = stored(members.join(reps.drop("doc_id"), "rid"), "jaccard-members")
    text = docs.select(F.col(text_col).alias("text"), F.coalesce(F.md5(text_col), F.lit("none")).alias("key"), F.col(id_col).cast("long").alias("doc_id"))
    wanted = members.join(reps.select("rid", F.col("doc_id").alias("least_id")), "rid")
    found = text.join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("least_id"))).select("rid", "component", "copies", "tiles", "text")
    sets = found.mapInArrow(tile_sets, "rid long, component long, copies long, tiles int, shingles binary")
    loose = members.where("tiles = 1").agg(F.count("*"), F.coalesce(8 * F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-loose[0] // BIN_UNITS), -(-loose[1] // BIN_BYTES))
    tile = F.pmod(F.xxhash64("rid"), F.col("tiles")).cast("int")
    # a unit of tile t meets its own tile in task (t, t) and every other tile u in task (min, max)
    task = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least(u, F.col("tile")).alias("i"), F.greatest(u, F.col("tile")).alias("j"))))
    dealt = sets.withColumn("tile", tile).withColumn("task", task)
    home = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "task.i", "task.j"))
    dealt = dealt.select("rid", "component", "copies", "tile", "shingles", (F.col("tiles") > 1).alias("tiled"), "task.i", "task.j", home.alias("home"))
    links = stored(dealt.groupBy("tiled", "home", "i", "j").applyInArrow(tile_task, "rid long, links long, root long"), "jaccard-links")
    roots = components(links.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rid").agg(F.sum("links").alias("links"))
    by_unit = reps.join(counted, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    by_unit = by_unit.select("key", "doc_id", "rid", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rid").alias("label"))
    least = by_unit.groupBy("label").agg(F.min(F.struct("doc_id", "key", "rid")).alias("least"))
    by_unit = by_unit.join(least, "label").select("key", "links", "copies", F.col("least.doc_id").alias("class_id"), F.col("least.rid").alias("first_rid"))
    out = rows.select("rid", "doc_id", "key", "n").join(by_unit, "key", "left")
    worded = F.col("n") > 0
    return out.select(
        "doc_id",
        F.when(worded, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        (~worded | (F.col("rid") == F.col("first_rid"))).alias("is_first"),
        F.col("key").alias("text_key"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: one row of each class of ``similarity_classes`` stays.

    Rows are told apart by id and text, null ids included, so a row of one id may go while another of the same id
    stays. Rows that repeat id and text of one that stays are the same document: the least of them by all columns stays,
    also where the text is null or has no word. Column names may be any.
    """
    classes = similarity_classes(docs, id_col, text_col)
    by_row = classes.groupBy("doc_id", "text_key").agg(F.bool_or("is_first").alias("stays"), F.count("*").alias("n"))
    named, key, stays = fresh(docs.columns, "doc", "text_key", "stays")
    special = by_row.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias(named), F.col("text_key").alias(key), F.col("stays").alias(stays))
    special = stored(special, "jaccard-special")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(named)) & (F.coalesce(F.md5(text_col), F.lit("none")) == F.col(key))
    once = docs.join(special, same, "left_anti")
    again = docs.join(special.where(stays), same).groupBy(named, key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.select(*docs.columns).unionByName(again.select("row.*"))


def tile_task(rows: pa.Table) -> pa.Table:
    """A task of two different tiles compares only across them; their own pairs belong to the tiles' own tasks."""
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    if rows.column("tiled")[0].as_py() and i != j and len(rows.column("tile").unique()) < 2:
        return LINKS.empty_table()
    if not rows.column("tiled")[0].as_py():
        rows = rows.set_column(rows.schema.get_field_index("tile"), "tile", pa.array(np.zeros(rows.num_rows, np.int32)))
    return tile_links(rows)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents")).drop("text_key")


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT min(doc_id) AS u, count(*) AS copies, text, any_value(w) AS w FROM d WHERE len(w) > 0 GROUP BY text),
s AS (SELECT DISTINCT u, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS k FROM (SELECT u, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM u)),
n AS (SELECT u, count(*) AS n FROM s GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b FROM s a JOIN s b USING (k) JOIN n na ON na.u = a.u JOIN n nb ON nb.u = b.u WHERE a.u <> b.u
  GROUP BY a.u, b.u HAVING count(*) >= {THRESHOLD} * (any_value(na.n) + any_value(nb.n) - count(*)) - 1e-9),
c(u, r) AS (SELECT u, u FROM u UNION SELECT c.u, p.b FROM c JOIN p ON p.a = c.r),
k AS (SELECT u, min(r) AS class_id FROM c GROUP BY u),
l AS (SELECT p.a AS u, sum(o.copies) AS links FROM p JOIN u o ON o.u = p.b GROUP BY p.a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, CAST(coalesce(l.links, 0) + coalesce(u.copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(n.n, 0) AS INTEGER) AS n_shingles,
  k.class_id IS NULL OR k.class_id = d.doc_id AS is_first
FROM d LEFT JOIN u ON d.text = u.text LEFT JOIN n ON n.u = u.u LEFT JOIN k ON k.u = u.u LEFT JOIN l ON l.u = u.u
"""
ORACLES = {"op7_jaccard_join": OP7_SQL}
