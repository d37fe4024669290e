"""Merkle manifest of a dataset by superblock reduction.

Leaves are the hashes of rows, in order within their group. A node of level l covers ``fanout**l`` leaves, so the leaves
of one index divided by ``fanout**k`` are all that the node k levels above them needs: such a superblock is collapsed in
a task of its own by ``applyInPandas``, which gives each of its nodes the siblings on the way up and the block's root.
The roots, fewer by ``fanout**k``, are reduced in the same way until each group has one; the groups' roots are once more
such a row of nodes, whose root is the dataset's. A leaf's proof is that of its superblock followed by that of each
superblock above it.

No group is gathered: a superblock has at most ``fanout**k`` nodes, and places within a group come from a range sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.shared import range_sorted, stored
from loamwork.sources.tables import table

FANOUT, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Hash of the values, each as its number of UTF-8 bytes, a colon and itself, or as ``-`` if null."""
    said = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*said), 256)


def numbered(nodes: DataFrame, *order: Column) -> DataFrame:
    """``nodes`` (group and others) with ``idx``, from 0 by ``order`` within the group.

    A sorted partition numbers the rows of each group that it holds. Only its first group can have begun before it, so
    what such groups held in earlier partitions is a table of at most one row a partition, which is broadcast.
    """

    def numbering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, count, opening = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            at, first = [], []
            for g in batch.column("group").to_pylist():
                if g != group:
                    opening = opening and group is None
                    group, count = g, 0
                at.append(count)
                first.append(opening)
                count += 1
            columns = [*batch.columns, pa.array(at, pa.int64()), pa.array(first, pa.bool_()), pa.array([part] * batch.num_rows, pa.int32())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "idx", "_opening", "_part"])

    ordered = range_sorted(nodes, F.asc("group"), *order).drop("_nth")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    rows = stored(ordered.mapInArrow(numbering, f"{schema}, idx long, _opening boolean, _part int"), "merkle-rows")
    held = rows.groupBy("group", "_part", "_opening").count()
    before = F.sum("count").over(Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = held.withColumn("_carry", before).where("_opening and _carry > 0").select("_part", "_opening", "_carry")
    return rows.join(F.broadcast(carried), ["_part", "_opening"], "left").withColumn("idx", F.col("idx") + F.coalesce("_carry", F.lit(0))).drop("_part", "_opening", "_carry")


def collapse(nodes: list[str], fanout: int, levels: int, alone: bool) -> tuple[list[str], list[bytes], str]:
    """Of a superblock's nodes: siblings on the way up, the (position, width) of each level's run, and the block's root.

    A block goes up all ``levels``, also with one node; one that is its group's only block (``alone``) stops at one node.
    """
    siblings, shape = [""] * len(nodes), [b""] * len(nodes)
    row, span = nodes, 1
    for _ in range(levels):
        if alone and len(row) == 1:
            break
        above = []
        for a in range(0, len(row), fanout):
            run = row[a : a + fanout]
            for k in range(len(run)):
                others, step = "".join(run[:k] + run[k + 1 :]), bytes([k, len(run)])
                for i in range((a + k) * span, min((a + k + 1) * span, len(nodes))):
                    siblings[i] += others
                    shape[i] += step
            above.append(digest(*run))
        row, span = above, span * fanout
    return siblings, shape, row[0]


def collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (group, idx, node and other strings) with ``block``, ``siblings``, ``shape`` and ``top``, the block's root."""
    size = fanout**levels
    columns = [*nodes.columns, "block", "siblings", "shape", "top"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", ignore_index=True)
        found = collapse(rows["node"].tolist(), fanout, levels, rows["block"].iloc[0] == 0 and len(rows) < size)
        rows["siblings"], rows["shape"] = [bytes.fromhex(s) for s in found[0]], found[1]
        rows["top"] = found[2]
        return rows[columns]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", block long, siblings binary, shape binary, top string"
    return nodes.withColumn("block", F.floor(F.col("idx") / size).cast("long")).groupBy("group", "block").applyInPandas(one, schema)


def reduced(nodes: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``nodes`` (group, idx, node, ...) with their whole ``siblings`` and ``shape`` up to their group's root
    and that root as ``top``, and (group, top) of all groups."""
    tables = [stored(collapsed(nodes, fanout, levels), "merkle-blocks")]
    while True:
        last = tables[-1]
        tops = last.where(F.col("idx") == F.col("block") * fanout**levels).select("group", F.col("block").alias("idx"), F.col("top").alias("node"))
        if not last.where("block > 0").limit(1).count():
            break
        tables.append(stored(collapsed(tops, fanout, levels), "merkle-blocks"))
    out = tables.pop()
    while tables:
        above = out.select("group", F.col("idx").alias("block"), F.col("siblings").alias("_s"), F.col("shape").alias("_h"), F.col("top").alias("_t"))
        low = tables.pop().drop("top").join(above, ["group", "block"])
        out = low.withColumn("siblings", F.concat("siblings", "_s")).withColumn("shape", F.concat("shape", "_h")).withColumn("top", F.col("_t")).drop("_s", "_h", "_t")
    return out.drop("block"), tops.select("group", F.col("node").alias("top"))


def folded(node: str, siblings: str, shape: bytes) -> str:
    """The root that a node and the hexadecimal siblings of its proof lead to."""
    for k, width in zip(shape[::2], shape[1::2], strict=True):
        mine, siblings = siblings[: 64 * (width - 1)], siblings[64 * (width - 1) :]
        node = digest(mine[: 64 * k], node, mine[64 * k :])
    return node


def manifest(rows: DataFrame, group: Column, order: Sequence[Column], node: Column, fanout: int = FANOUT, levels: int = LEVELS, **carried: Column) -> DataFrame:
    """(group, idx, node, subroot, root, siblings, shape and the string columns ``carried``), a row a row of ``rows``.

    ``group`` is read as text; null is a group of its own, before all others. ``siblings``: the proof's digests, 32 bytes
    each, from the leaf's level up through its group's root to the dataset's; ``shape``: of each level the node's place in
    its run and the run's width, a byte each. A leaf alone is its group's root and a group alone gives the dataset's;
    no rows give none. ``order`` names columns of ``rows``, nulls first; rows equal in them are ordered by ``node``, and
    repeated rows are leaves each. Wanted columns are named by the caller, so further ones make no difference.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("a fanout is between 2 and 255")
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    slim = rows.select(F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("group"), *keys, node.alias("node"), *(c.cast("string").alias(n) for n, c in carried.items()))
    slim = stored(slim, "merkle-leaves")
    names = [f"_o{i}" for i in range(len(keys))]
    leaves = numbered(slim, *(F.asc_nulls_first(n) for n in names), F.asc("node")).drop(*names)
    proofs, tops = reduced(leaves, fanout, levels)
    tops = stored(tops.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("top").alias("node")), "merkle-groups")
    above, _ = reduced(numbered(tops, F.asc("name")), fanout, levels)
    above = stored(above.select(F.col("name").alias("group"), F.col("siblings").alias("_s"), F.col("shape").alias("_h"), F.col("top").alias("root")), "merkle-above")
    out = joined_by_group(proofs, above)
    said = F.when(F.col("group") != "", F.substring("group", 2, 1 << 30))
    return out.select(said.alias("group"), "idx", "node", F.col("top").alias("subroot"), "root", F.concat("siblings", "_s").alias("siblings"), F.concat("shape", "_h").alias("shape"), *carried)


def joined_by_group(proofs: DataFrame, above: DataFrame, salts: int = 64) -> DataFrame:
    """``proofs`` with what their group has in ``above``; a group's rows are dealt over ``salts`` keys, as one may hold a third of all."""
    every = above.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return proofs.withColumn("_salt", F.pmod("idx", F.lit(salts)).cast("int")).join(every, ["group", "_salt"]).drop("_salt")


def checked(proofs: DataFrame, changed: str) -> DataFrame:
    """``proofs`` of ``manifest`` with ``proof_sha256``, ``folded_root`` and ``verified``: whether the leaf in column ``changed``, or ``node`` where that is null, leads to the root."""

    def checking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            siblings = [s.hex() for s in batch.column("siblings").to_pylist()]
            nodes = [c or n for c, n in zip(batch.column(changed).to_pylist(), batch.column("node").to_pylist(), strict=True)]
            roots = [folded(n, s, h) for n, s, h in zip(nodes, siblings, batch.column("shape").to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array([digest(s) for s in siblings], pa.string()), pa.array(roots, pa.string())], names=[*batch.schema.names, "proof_sha256", "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return proofs.mapInArrow(checking, f"{schema}, proof_sha256 string, folded_root string").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked after the text of every second one lost its line ends."""
    docs = table(spark, sf_dir, "documents")
    fields = {f: F.col(f) for f in FIELDS}
    hit = (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0) & F.contains("text", F.lit("\n"))
    tampered = F.when(hit, leaf(*(fields | {"text": F.translate("text", "\n", "")}).values()))
    proofs = manifest(docs, F.col("source"), [F.col("doc_id")], leaf(*fields.values()), doc_id=F.col("doc_id"), tampered=tampered)
    out = checked(proofs, "tampered")
    return out.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def said_sql(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


def up_sql(name: str, nodes: str, group: str) -> str:
    """All levels over ``nodes`` (group, i, h): l, i, h, and n, the number of nodes of the level."""
    return f"""{name}(grp, l, i, h, n) AS (SELECT {group}, 0, i, h, count(*) OVER (PARTITION BY {group}) FROM {nodes}
  UNION ALL SELECT grp, l + 1, i // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + {FANOUT - 1}) // {FANOUT} FROM {name} WHERE n > 1 GROUP BY grp, l, i // {FANOUT})"""


OP12_SQL = f"""
WITH RECURSIVE steps AS (SELECT range AS v, range AS b, 0 AS k FROM range(256) UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
ids AS (SELECT doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS x FROM (SELECT DISTINCT doc_id FROM documents)),
hit AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: CAST(CAST('0x' || substr(x, i, 2) AS INTEGER) AS BIGINT))),
  lambda s, y: xor(t[(xor(s, y) & 255) + 1], s >> 8)), 4294967295) % 2 = 0 AS hit FROM ids, crc),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {said_sql(*FIELDS)} AS leaf,
  {said_sql(*FIELDS[:4], "CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END")} AS changed FROM documents LEFT JOIN hit USING (doc_id)),
leaves AS (SELECT r, doc_id, source, leaf, changed, leaf AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{up_sql("low", "leaves", "source")},
tops AS (SELECT grp AS source, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i FROM low WHERE n = 1),
{up_sql("high", "tops", "true")},
ways AS (SELECT p.r, u.l, u.i, u.h, p.i // CAST({FANOUT} ** u.l AS BIGINT) AS own FROM leaves p JOIN low u ON u.grp IS NOT DISTINCT FROM p.source AND u.n > 1 AND u.i // {FANOUT} = p.i // CAST({FANOUT} ** (u.l + 1) AS BIGINT)
  UNION ALL SELECT p.r, 1000 + u.l, u.i, u.h, t.i // CAST({FANOUT} ** u.l AS BIGINT) FROM leaves p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN high u ON u.n > 1 AND u.i // {FANOUT} = t.i // CAST({FANOUT} ** (u.l + 1) AS BIGINT)),
runs AS (SELECT r, l, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS b FROM ways GROUP BY r, l),
proofs AS (SELECT r, string_agg(a || b, '' ORDER BY l) AS proof, list(a || '|' || b ORDER BY l) AS path FROM runs GROUP BY r),
folds AS (SELECT p.doc_id, p.leaf, t.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(list_prepend(p.changed, coalesce(path, [])), lambda s, x: sha256(split_part(x, '|', 1) || s || split_part(x, '|', 2))) AS folded_root
  FROM leaves p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source LEFT JOIN proofs USING (r))
SELECT *, folded_root = root AS verified FROM folds
"""
ORACLES = {"op12_merkle_manifest": OP12_SQL}
