"""Resampling towards a target distribution by importance weights of hashed n-grams.

1. Texts become a sparse matrix of documents by buckets, the counts of the hashed features. It is stored once, a row a
   document with its arrays of buckets and counts.
2. Column sums give both distributions: a task adds its rows to one dense vector, and only that vector's entries are
   shuffled. A bucket's gain is the logarithm of the ratio of its smoothed shares.
3. The product of the matrix with the vector of gains gives every document's weight, read from the matrix alone.
4. Weights with Gumbel noise from a hash of the id are drawn from the top; Spark's range partitioning numbers the rows,
   so no task sorts them all.

What goes through the driver: one number a bucket, and one row a partition of the sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import Words, blocks, discarded, range_sorted, stored, with_places
from loamwork.sources.tables import table

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes that part words, once letters are small: ASCII but digits and letters; bytes of other code points belong to words.
APART = np.ones(256, bool)
APART[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: CRC-32 state of no bytes; words of more bytes than this leave numpy's loop over bytes.
NONE, LONG_WORD = np.uint32(0xFFFFFFFF), 64


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


CRC = _crc_table()


def crc_over(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes ``data[start:end]`` of every row: a byte of all rows at a time, long rows one by one."""
    out, size = state.copy(), end - start
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i] ^ NONE)) ^ int(NONE)
    order = np.flatnonzero(size <= LONG_WORD)
    order = order[np.argsort(-size[order], kind="stable")]
    at, size, part = start[order], size[order], state[order]
    longer = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    for k, n in enumerate(longer.tolist()):
        part[:n] = CRC[(part[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (part[:n] >> np.uint32(8))
    out[order] = part
    return out


def features(words: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all runs of 1 to ``longest`` consecutive words, joined by a space, of a block of texts."""
    first = np.arange(len(words.doc))
    ends = words.first[words.doc + 1] if len(first) else first
    state, rows, found = np.full(len(first), NONE, np.uint32), [], []
    for size in range(longest):
        word = first + size
        if size:
            state = CRC[(state ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = crc_over(state, words.data, words.start[word], words.end[word])
        rows.append(words.doc[first])
        found.append((state ^ NONE) % np.uint32(buckets))
        more = word + 1 < ends[first]
        first, state = first[more], state[more]
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The stored matrix of documents by buckets, a row of the table a block of compressed sparse rows, of one document each.

    ``ids``, ``words``: the document's id and number of words; ``upto``: where its entries end; ``columns`` and ``counts``:
    the entries, buckets ascending. A null or wordless text is a row without entries, and a long one has at most
    ``buckets``. Features are counted for a megabyte of text at once, but blocks are no larger than a document, as
    readers hold thousands of rows together, whatever their sizes.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            words = Words(block.column("text"), APART, LOWER)
            row, bucket = features(words, longest, buckets)
            cell, count = np.unique(row * buckets + bucket, return_counts=True)
            upto = np.searchsorted(cell, np.arange(block.num_rows + 1) * buckets).astype(np.int32)
            each = pa.array(np.arange(block.num_rows + 1, dtype=np.int32))
            one = lambda values: pa.ListArray.from_arrays(each, values)  # noqa: B023, E731
            entries = lambda values: pa.ListArray.from_arrays(pa.array(upto), pa.array(values.astype(np.int32)))  # noqa: B023, E731
            yield pa.record_batch(
                [one(block.column("doc_id")), one(pa.array(words.count.astype(np.int64))), one(pa.array(np.diff(upto))), entries(cell % buckets), entries(count)],
                names=["ids", "words", "upto", "columns", "counts"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(slim.mapInArrow(counted, "ids array<long>, words array<long>, upto array<int>, columns array<int>, counts array<int>"), "importance-matrix", "zstd")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of every bucket with a feature: a task's rows are added up before anything is shuffled."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("columns").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return matrix.select("columns", "counts").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from both sides' column sums: thousandths of the logarithm of the ratio of shares, each sum with one added."""
    every = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + float(buckets)) / ((s + 1) * (F.col("all_t") + float(buckets)))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighted(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the product of the matrix with the gains."""

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([[0], np.cumsum(batch.column("upto").flatten().to_numpy(), dtype=np.int64)])
            columns, counts = batch.column("columns").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64)
            over = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(values)])[at]))  # noqa: B023, E731
            yield pa.record_batch([batch.column("ids").flatten(), batch.column("words").flatten(), over(counts), over(counts * gains[columns])], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(multiplied, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first 32 bits of the hash of ``seed:id``; a null id counts as empty."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score and others) with ``rank``, from 1, of the rows drawn; null for all others.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded down: the highest scores,
    of equal ones the lesser id, null before all. Rows equal in both are drawn in any order.
    """
    fits = F.col("n_words") >= least_words
    rows = stored(range_sorted(scored, F.desc(fits.cast("int")), F.desc("score"), F.asc_nulls_first("doc_id")), "importance-ranks")
    placed = with_places(rows, "rank")
    most = rows.where(fits).count() * percent // 100
    return placed.withColumn("rank", F.when(fits & (F.col("rank") <= most), F.col("rank")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_words, n_features, weight, score, rank; rows with a rank are the sample.

    A null, empty or wordless text has no features and weight 0; one that is too short is never drawn. A null id is kept
    and draws its noise as the empty id does. Repeated rows are rows, each with a score. Very long texts are counted
    whole. An empty ``docs`` gives no rows; an empty ``target`` leaves its side uniform. Other columns make no difference.
    """
    matrix, aim = count_matrix(docs, id_col, text_col, longest, buckets), count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text")), longest=longest, buckets=buckets)
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in bucket_gains(column_sums(matrix, buckets), column_sums(aim, buckets), buckets).collect():  # one row a bucket
        gains[bucket] = gain
    discarded(aim)
    scored = weighted(matrix, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, percent, least_words)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
OP13_SQL = rf"""
WITH RECURSIVE steps AS (SELECT range AS v, range AS b, 0 AS k FROM range(256) UNION ALL SELECT CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
found AS (SELECT r, side, unnest(w) AS word FROM numbered),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM found)),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) AS BIGINT))),
  lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) % {BUCKETS} AS bucket FROM vocabulary, crc),
cells AS (SELECT r, side, bucket, count(*) AS c FROM found JOIN hashed USING (word) GROUP BY ALL),
sums AS (SELECT range AS bucket, coalesce(sum(c) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 'b'), 0)::DOUBLE AS t FROM range({BUCKETS}) LEFT JOIN cells ON bucket = range GROUP BY range),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT r, sum(c) AS n, sum(c * gain) AS weight FROM cells JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM numbered LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM ranked
"""
ORACLES = {"op13_importance_resampling": OP13_SQL}
