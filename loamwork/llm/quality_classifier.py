"""Quality classifier: naive Bayes features and a linear support vector machine.

A text's features say which hashed byte trigrams occur in it. Each is scaled by the log-count ratio of the two classes,
the vector is brought to length 1, and dual coordinate descent fits hinge loss on the result. A logistic curve through
margins of two-fold cross-validation turns a margin into a score.

The fit uses at most ``SAMPLE_ROWS`` labelled texts, those with the smallest hashes, as packed bits of ``FEATURES / 8``
bytes each, so the driver's memory is bounded. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.llm.shared import blocks, text_bytes
from loamwork.sources.tables import table

FEATURES = 1 << 16
SAMPLE_ROWS = 6000
CUT = 0.7


class Model(NamedTuple):
    """``weight``: by feature, ratios included. ``square``: squared ratios. ``bias`` and the curve's slope and offset."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float


def trigram_codes(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def features(data: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Distinct features of one text; ``seen`` is a scratch array of FEATURES booleans, all false."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    codes = trigram_codes(data)
    seen[codes] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    sums = np.full((2, FEATURES), alpha)
    for x, y in zip(rows, labels, strict=True):
        sums[int(y), x] += 1
    sums /= sums.sum(axis=1, keepdims=True)
    return np.log(sums[1] / sums[0])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the scaled, normalised indicators and the bias, by dual coordinate descent on the hinge loss."""
    signs = np.where(labels == 1, 1.0, -1.0)
    values = [ratios[x] / (np.sqrt((ratios[x] ** 2).sum()) or 1.0) for x in rows]
    weight, bias, alpha, random = np.zeros(FEATURES), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = signs[i] * (weight[x] @ v + bias) - 1
            now = min(max(alpha[i] - slope / (v @ v + 1.0), 0.0), cost)
            if now != alpha[i]:
                step = (now - alpha[i]) * signs[i]
                weight[x] += step * v
                bias += step
                alpha[i] = now
    return weight, bias


def margin(model: Model, x: np.ndarray) -> float:
    return float(model.weight[x].sum() / (np.sqrt(model.square[x].sum()) or 1.0)) + model.bias


def logistic(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the curve with the largest likelihood, by Newton's method; targets are smoothed."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A sample of one class gives that class for all texts; an empty one gives 0.5."""
    if len(set(labels.tolist())) < 2:
        offset = 0.0 if not len(labels) else (20.0 if labels[0] == 1 else -20.0)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, offset)

    def trained(use: list[int]) -> Model:
        some, y = [rows[i] for i in use], labels[use]
        ratios = log_count_ratios(some, y)
        weight, bias = descend(some, y, ratios)
        return Model(weight * ratios, ratios**2, bias, 1.0, 0.0)

    halves, margins = [list(range(k, len(rows), 2)) for k in (0, 1)], np.zeros(len(rows))
    for test, train in (halves, halves[::-1]):
        part = trained(train)
        margins[test] = [margin(part, rows[i]) for i in test]
    slope, offset = logistic(margins, labels)
    return trained(list(range(len(rows))))._replace(slope=max(slope, 0.0), offset=offset)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``limit`` different labelled texts.

    They are chosen by (id, hash of the text), as ids may repeat, with the least hashes of both; only these and the
    labels, ``limit`` of them, are broadcast, and copies of a chosen row are dropped before anything is collected.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    order = (F.xxhash64("doc_id", "key"), "doc_id", "key", "quality")
    chosen = keyed.select("doc_id", "key").join(known, "doc_id").orderBy(*order).limit(limit).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, bool)
        for block in blocks(batches, "text"):
            data, at = text_bytes(block.column("text"))
            bits = []
            for i in range(block.num_rows):
                if at[i + 1] - at[i] >= 3:
                    seen[trigram_codes(data[at[i] : at[i + 1]])] = True
                bits.append(np.packbits(seen).tobytes())
                seen[:] = False
            yield pa.record_batch([block.column("doc_id"), block.column("key"), block.column("quality"), pa.array(bits, pa.binary())], names=["doc_id", "key", "quality", "bits"])

    texts = keyed.join(F.broadcast(chosen), ["doc_id", "key"]).select(F.col("doc_id").cast("long").alias("doc_id"), "key", F.col("quality").cast("int").alias("quality"), "text")
    once = texts.mapInArrow(packed, "doc_id long, key long, quality int, bits binary").dropDuplicates(["doc_id", "key", "quality"])
    found = sorted(once.collect(), key=lambda r: (r.doc_id, r.key, r.quality))
    order = np.random.default_rng(3).permutation(len(found))
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(bytes(found[i].bits), np.uint8))) for i in order]
    return rows, np.array([found[i].quality for i in order], np.int64)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null text is scored like an empty one."""
    small = model._replace(weight=model.weight.astype(np.float32), square=model.square.astype(np.float32))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, bool)
        for block in blocks(batches, "text"):
            data, at = text_bytes(block.column("text"))
            m = np.array([margin(small, features(data[at[i] : at[i + 1]], seen)) for i in range(block.num_rows)])
            p = 1 / (1 + np.exp(-np.clip(small.slope * m + small.offset, -30, 30)))
            yield pa.record_batch([block.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``cut``, with all their columns, in one pass."""
    small = model._replace(weight=model.weight.astype(np.float32), square=model.square.astype(np.float32))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, bool)
        for block in blocks(batches, "text"):
            data, at = text_bytes(block.column("text"))
            m = np.array([margin(small, features(data[at[i] : at[i + 1]], seen)) for i in range(block.num_rows)])
            p = 1 / (1 + np.exp(-np.clip(small.slope * m + small.offset, -30, 30)))
            yield block.filter(pa.array(p >= cut))

    return docs.mapInArrow(filtered, docs.schema)


def trained_model(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    return fit(*training_rows(docs, labels, limit))


def classify(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """Quality of every row of ``docs``: doc_id, held_out, score in 0 to 1, predicted.

    Only ``text`` enters a score. Null and empty texts have no trigram and get the score of the bias alone. A null id
    counts as not held out and is not learned from. Rows are scored each for itself; repeated rows and other columns make
    no difference, equal margins get equal scores, and an empty table gives no rows. Texts are read whole.
    """
    out = scores(docs, trained_model(docs, labels, limit))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLES: dict[str, str] = {}
