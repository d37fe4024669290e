"""The donor of the best score for every item: likeness of character pairs, of lengths, and a bonus for shared ends.

``score = |A & C| / |A | C| + 0.20 * exp(-|len_c - len_a| / max(1, len_a)) + 0.15 * (C's text holds an end of A)`` with A and
C the distinct character pairs of both texts without white space.

Items and donors of a key are sorted by length and dealt into chunks and blocks; a task compares a chunk with a block. It
counts common pairs as a product of matrices over the pairs that most donors hold, and through an inverted index for the
rest. Each chunk meets the block of the nearest lengths first, which gives scores to beat; pieces whose lengths and numbers
of pairs rule a better score out are passed over. Ends that a donor's text holds are looked up once a donor, so texts go
into no comparison. Tasks return a row an item and block, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.operators.automaton import code_points
from loamwork.operators.ordering import in_order_within
from loamwork.sources.staging import staged

#: Weights of the lengths' likeness and of a shared end.
LENGTH_WEIGHT, END_BONUS = 0.20, 0.15
BLOCK, ITEMS_A_TASK, EPS = 8192, 4096, 1e-9
PIECE, WIDTH, DENSE = 256, 1024, 1024  # items and donors compared at once, and pairs of characters that are columns of the matrices
TEXTS_A_TASK, ENDS_A_TASK = 512, 50_000
ROWS_AT_ONCE = 128  # of a batch, as a row's pairs are many times the row


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def pair_codes(text: str) -> np.ndarray:
    """Distinct pairs of neighbouring characters as sorted numbers; a text of one character is its own."""
    c = code_points(text)
    return np.unique((c[:-1] << 21) | c[1:]) if len(c) > 1 else c


def _with_pairs(rows: DataFrame, key: str, text: str, ends: Sequence[str], tiers: Sequence[Sequence[str]]) -> DataFrame:
    """(id, text, ends, keys, length, pairs, n): ``keys`` has one text a tier, ``pairs`` are packed numbers."""
    keys = F.array(*(F.to_json(F.struct(F.lit(i).alias("_tier"), *tier)) for i, tier in enumerate(tiers, 1)))
    said = F.coalesce(text, F.lit(""))
    slim = rows.select(F.col(key).alias("id"), said.alias("text"), F.array(*ends).cast("array<string>").alias("ends"), keys.alias("keys"), F.length(said).alias("length"), X.compact(F.col(text)).alias("_solid"))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            codes = [pair_codes(t) for t in batch.column("_solid").to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([len(c) for c in codes], pa.int32())], names=[*batch.schema.names[:-1], "pairs", "n"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(paired, f"{schema}, pairs binary, n int")


def _exploded(rows: DataFrame, *kept: str) -> DataFrame:
    """(kept, pair): a row a pair of characters."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            values = [np.frombuffer(p, np.int64) for p in batch.column("pairs").to_pylist()]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(v) for v in values]))
            yield pa.record_batch([*(batch.column(c).take(at) for c in kept), pa.array(np.concatenate([np.zeros(0, np.int64), *values]))], names=[*kept, "pair"])

    slim = rows.select(*kept, "pairs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(spread, f"{schema}, pair long")


def _flat(pairs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All rows' pairs in one array, and where each row's begin."""
    each = [np.frombuffer(p, np.int64) for p in pairs.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *each]), np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)])


def _split(code: np.ndarray, row: np.ndarray, rows: int, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matrix of ones for the codes below ``dense``, and code and row of the others."""
    matrix = np.zeros((rows, dense), np.float32)
    often = code < dense
    matrix[row[often], code[often]] = 1
    return matrix, code[~often], row[~often]


def tile_best(items: pa.Table, donors: pa.Table) -> tuple[np.ndarray, list, np.ndarray]:
    """Of each item that has a donor here other than itself whose score is ``got`` or more: its place, the donor, and the score, rounded to 12 digits."""
    ids = donors.column("id").to_pylist()
    length, size = donors.column("length").to_numpy(), donors.column("n").to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    order = np.argsort(length, kind="stable")  # pieces have close lengths; within one the least id comes first
    order = np.concatenate([p[np.argsort(rank[p])] for p in np.split(order, range(WIDTH, len(order), WIDTH))])
    ids, rank, length, size = [ids[k] for k in order], rank[order], length[order].astype(float), size[order].astype(float)
    donors = donors.take(pa.array(order))

    flat, begins = _flat(donors.column("pairs"))
    known, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(known), np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(known))
    dense = min(DENSE, len(known))
    theirs, rare, owner = _split(place[code], np.repeat(np.arange(len(ids)), np.diff(begins)), len(ids), dense)
    flat, begins = _flat(items.column("pairs"))
    at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
    hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
    mine, own_rare, own_row = _split(place[at[hit]], np.repeat(np.arange(items.num_rows), np.diff(begins))[hit], items.num_rows, dense)

    ends = {e: k for k, e in enumerate(dict.fromkeys(e for row in items.column("ends").to_pylist() for e in row if e is not None))}
    holds = np.zeros((len(ends) + 1, len(ids)), bool)  # the last row is that of a null end
    if "" in ends:
        holds[ends[""]] = True
    for d, held in enumerate(donors.column("held").to_pylist()):
        for e in held or ():
            if e in ends:
                holds[ends[e], d] = True
    end_rows = np.array([[len(ends) if e is None else ends[e] for e in row] for row in items.column("ends").to_pylist()]).reshape(items.num_rows, -1)

    where = {k: d for d, k in enumerate(ids)}
    self_at = np.array([where.get(k, -1) for k in items.column("id").to_pylist()])
    n = items.column("n").to_numpy().astype(float)
    target = np.maximum(items.column("length").to_numpy(), 1).astype(float)
    best, chosen, chosen_rank = items.column("got").to_numpy().copy(), np.full(items.num_rows, -1), np.full(items.num_rows, len(ids))
    by_length = np.argsort(target, kind="stable")
    pieces = []
    for a in range(0, len(ids), WIDTH):
        z = min(a + WIDTH, len(ids))
        inside = (owner >= a) & (owner < z)
        c, o = rare[inside] - dense, owner[inside] - a
        by = np.argsort(c, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(known) - dense))])
        pieces.append((a, z, o[by], first, size[a:z].min(), size[a:z].max(), length[a:z].min(), length[a:z].max()))
    by_row = np.argsort(own_row, kind="stable")
    own_rare, own_first = own_rare[by_row] - dense, np.concatenate([[0], np.cumsum(np.bincount(own_row, minlength=items.num_rows))])
    for i in range(0, len(by_length), PIECE):
        group = by_length[i : i + PIECE]
        middle = np.median(target[group])
        for a, z, o, first, n0, n1, l0, l1 in sorted(pieces, key=lambda p: abs((p[6] + p[7]) / 2 - middle)):
            away = np.maximum(np.maximum(l0 - target[group], target[group] - l1), 0)
            like = np.where(n1 < n[group], n1 / np.maximum(n[group], 1), np.where(n0 > n[group], n[group] / max(n0, 1), 1.0))
            rows = group[like + LENGTH_WEIGHT * np.exp(-away / target[group]) + END_BONUS >= best[group] - EPS]
            if not len(rows):
                continue
            common = (mine[rows] @ theirs[a:z].T).astype(float)
            count = own_first[rows + 1] - own_first[rows]
            codes = own_rare[_spans(own_first[rows], count)]
            found = first[codes + 1] - first[codes]
            cell = np.repeat(np.repeat(np.arange(len(rows)), count), found) * (z - a) + o[_spans(first[codes], found)]
            np.add.at(common.reshape(-1), cell, 1.0)
            t = target[rows, None]
            score = common / np.maximum(size[a:z] + n[rows, None] - common, 1) + LENGTH_WEIGHT * np.exp(-np.abs(length[a:z] - t) / t)
            for k in range(end_rows.shape[1]):
                bonus = holds[end_rows[rows, k], a:z] if k == 0 else bonus | holds[end_rows[rows, k], a:z]
            score = np.round(score + np.where(bonus, END_BONUS, 0.0) if end_rows.shape[1] else score, 12)
            own = (self_at[rows] >= a) & (self_at[rows] < z)
            score[np.flatnonzero(own), self_at[rows][own] - a] = -1.0
            k = np.argmax(score, axis=1)
            top = score[np.arange(len(rows)), k]
            better = (top > best[rows]) | ((top == best[rows]) & (rank[a + k] < chosen_rank[rows]))
            rows, k = rows[better], a + k[better]
            best[rows], chosen[rows], chosen_rank[rows] = top[better], k, rank[k]
    rows = np.flatnonzero(chosen >= 0)
    return rows, [ids[k] for k in chosen[rows]], best[rows]


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``first`` on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _compared(wanted: DataFrame, items: DataFrame, blocks: DataFrame, kind: str) -> DataFrame:
    """(id, donor, score): the best of each item in each wanted (tkey, chunk, block), if it is ``got`` or more."""
    left = items.select("id", "tkey", "chunk", "length", "n", "ends", "pairs", "got").join(wanted, ["tkey", "chunk"])
    right = blocks.join(wanted, ["tkey", "block"])

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, chosen, scores = tile_best(mine, theirs) if mine.num_rows and theirs.num_rows else ([], [], [])
        ids = mine.column("id").take(pa.array(rows, pa.int64())) if mine.num_rows else theirs.column("id").slice(0, 0)
        return pa.table({"id": ids, "donor": pa.array(chosen, ids.type), "score": pa.array(scores, pa.float64())})

    keys = ("tkey", "chunk", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"id {kind}, donor {kind}, score double")


def ends_held(texts: Sequence[str], ends: Sequence[str]) -> list[list[str]]:
    """The ends that each text holds; many ends of a length are looked up by the text's pieces of that length."""
    by: dict[int, set[str]] = {}
    for e in ends:
        by.setdefault(len(e), set()).add(e)
    out = []
    for t in texts:
        held: list[str] = []
        for m, names in by.items():
            held.extend([e for e in names if e in t] if len(names) < 32 else names & {t[i : i + m] for i in range(len(t) - m + 1)})
        out.append(held)
    return out


def _with_held(theirs: DataFrame, my: DataFrame, kind: str) -> DataFrame:
    """(tkey, id, held): the ends of the key's items that a donor's text holds."""
    ends = my.select("tkey", F.explode("ends").alias("end")).where("end <> ''").distinct()
    parts = ends.groupBy("tkey").agg(F.ceil(F.count("*") / ENDS_A_TASK).cast("int").alias("parts"))
    load = theirs.groupBy("tkey").agg(F.ceil(F.count("*") / TEXTS_A_TASK).cast("int").alias("salts")).join(parts, "tkey")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = theirs.select("id", "tkey", "text").join(load, "tkey").withColumn("salt", dealt("id", "salts")).withColumn("part", every("parts")).drop("salts", "parts")
    right = ends.join(load, "tkey").withColumn("part", dealt("end", "parts")).withColumn("salt", every("salts")).drop("salts", "parts")

    def look(texts: pa.Table, ends: pa.Table) -> pa.Table:
        held = ends_held(texts.column("text").to_pylist(), ends.column("end").to_pylist())
        return pa.table({"tkey": texts.column("tkey"), "id": texts.column("id"), "held": pa.array(held, pa.list_(pa.string()))})

    keys = ("tkey", "salt", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, f"tkey string, id {kind}, held array<string>")
    return found.where("size(held) > 0").groupBy("tkey", "id").agg(F.flatten(F.collect_list("held")).alias("held"))


def best_donor(items: DataFrame, donors: DataFrame, tiers: Sequence[Sequence[str]], key: str = "item_id", text: str = "text", ends: Sequence[str] = ("head_text", "tail_text")) -> DataFrame:
    """(key, donor, tier, score): the best donor of the first tier of columns in which an item has any; ties go to the least donor.

    A tier of no columns holds all donors. Nulls in a tier's columns are values like any; a null text counts as empty;
    a null end is held nowhere, an empty one everywhere. An item is no donor of its own. ``key`` is unique on either
    side and of one type on both. Items that no tier has a donor for are left out.
    """
    kind = items.schema[key].dataType.simpleString()
    i_rows = staged(_with_pairs(items, key, text, ends, tiers), "donor-items")
    d_rows = staged(_with_pairs(donors, key, text, ends, tiers), "donor-donors")
    held = d_rows.select("id", F.explode("keys").alias("tkey")).groupBy("tkey").agg(F.count("*").alias("held"), F.min("id").alias("only"))
    asked = i_rows.select("id", F.posexplode("keys").alias("tier", "tkey")).join(held, "tkey").where((F.col("held") > 1) | (F.col("only") != F.col("id")))
    first = asked.groupBy("id").agg(F.min(F.struct("tier", "tkey")).alias("t")).select("id", (F.col("t.tier") + 1).alias("tier"), "t.tkey")
    dealt = lambda rows, name, size: in_order_within(rows, ["tkey"], [F.asc("length"), F.asc("id")], "place").withColumn(name, F.floor((F.col("place") - 1) / size).cast("long")).drop("place")
    my = staged(dealt(i_rows.drop("keys", "text").join(first, "id"), "chunk", ITEMS_A_TASK), "donor-items")

    theirs = d_rows.select("id", "text", "length", "n", "pairs", F.explode("keys").alias("tkey")).join(my.select("tkey").distinct(), "tkey", "left_semi")
    blocks = dealt(theirs.drop("text"), "block", BLOCK).join(_with_held(theirs, my, kind), ["tkey", "id"], "left")
    blocks = staged(blocks, "donor-blocks")
    middle = (F.min("length") + F.max("length")) / 2
    tiles = my.groupBy("tkey", "chunk").agg(middle.alias("c")).join(blocks.groupBy("tkey", "block").agg(middle.alias("b")), "tkey")
    nearest = F.min(F.struct(F.abs(F.col("c") - F.col("b")).alias("away"), "block"))
    tiles = staged(tiles.groupBy("tkey", "chunk").agg(nearest.alias("near"), F.collect_list("block").alias("blocks")), "donor-tiles")
    seeds = staged(_compared(tiles.select("tkey", "chunk", "near.block"), my.withColumn("got", F.lit(0.0)), blocks, kind), "donor-seeds")
    rest = tiles.select("tkey", "chunk", F.explode(F.array_remove("blocks", F.col("near.block"))).alias("block"))
    beat = my.join(seeds.select("id", F.col("score").alias("got")), "id", "left").withColumn("got", F.coalesce("got", F.lit(0.0)))
    found = seeds.unionByName(_compared(rest, beat, blocks, kind))
    least = F.struct((-F.col("score")).alias("s"), F.col("donor").alias("d"))
    out = found.groupBy("id").agg(F.min(least).alias("b")).join(my.select("id", "tier"), "id")
    return out.select(F.col("id").alias(key), F.col("b.d").alias("donor"), "tier", (-F.col("b.s")).alias("score"))
