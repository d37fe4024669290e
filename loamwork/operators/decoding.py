"""The best sequence of tags under first-order scores: Viterbi's dynamic program over whole blocks of records.

The score of a sequence is the sum of its start, its emissions, its transitions and its end. Records of a block move on by
one token together, longest first, so time is linear in the tokens, also where one record holds most of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens, padding included, that are decoded at once; a longer record is decoded alone.
BLOCK = 1 << 18


class Chain:
    """Scores of a chain: ``start`` and ``end`` of each tag and ``step[a, b]`` of tag b after tag a; what is not named scores 0."""

    def __init__(self, tags: Sequence[str], start: Mapping[str, float], step: Mapping[tuple[str, str], float], end: Mapping[str, float]) -> None:
        place = {t: i for i, t in enumerate(tags)}
        if len(place) != len(tags) or not tags:
            raise ValueError("tags are not empty and all different")
        self.tags = list(tags)
        self.start, self.end, self.step = np.zeros(len(tags)), np.zeros(len(tags)), np.zeros((len(tags), len(tags)))
        for t, v in start.items():
            self.start[place[t]] = v
        for t, v in end.items():
            self.end[place[t]] = v
        for (a, b), v in step.items():
            self.step[place[a], place[b]] = v


def decoded(chain: Chain, emissions: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tags of all tokens, record after record, and each record's score; of equal sequences the tag first in order is taken, from the last token back.

    ``emissions``: (tokens, tags). A record without tokens has no score, NaN.
    """
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    size, at = sizes[order], first[order]
    best, out = np.full(len(sizes), np.nan), np.zeros(len(emissions), np.int32)
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    if not len(live):
        return out, best
    score = chain.start + emissions[at[: live[0]]]
    back = []
    for t, n in enumerate(live.tolist()):
        if t:
            through = score[:n, :, None] + chain.step
            back.append(through.argmax(axis=1).astype(np.int16))
            score[:n] = through.max(axis=1) + emissions[at[:n] + t]
    final = score + chain.end
    tag = final.argmax(axis=1)
    best[order[: live[0]]] = final.max(axis=1)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        out[at[:n] + t] = tag[:n]
        if t:
            tag[:n] = back[t - 1][np.arange(n), tag[:n]]
    return out, best


def record_blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of records whose number times the longest is at most ``BLOCK``, or single ones."""
    start, longest = 0, 0
    for i, n in enumerate(sizes.tolist()):
        longest = max(longest, n)
        if i > start and longest * (i + 1 - start) > BLOCK:
            yield start, i
            start, longest = i, n
    if len(sizes) > start:
        yield start, len(sizes)


def best_tags(records: DataFrame, chain: Chain, key: str, emissions: str = "emissions") -> DataFrame:
    """(key, tags, score): the best tags of each record's tokens.

    ``emissions``: an array with an array a token, a score for each tag in the chain's order; a missing or null score is
    0. A null or empty array has no tags and a null score. Keys may repeat or be null.
    """
    width = len(chain.tags)
    full = F.transform(F.coalesce(F.col(emissions), F.array().cast("array<array<double>>")), lambda e: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(e, i), F.lit(0.0))))
    slim = records.select(F.col(key).alias("key"), F.size(full).alias("n"), F.flatten(full).alias("flat"))
    kind = records.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(chain.tags, object)
        for batch in batches:
            sizes = batch.column("n").to_numpy().astype(np.int64)
            for a, b in record_blocks(sizes):
                part = batch.slice(a, b - a)
                flat = part.column("flat").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                tags, score = decoded(chain, flat, sizes[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes[a:b])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[tags].tolist(), pa.string()))
                yield pa.record_batch([part.column("key"), listed, pa.array(score, mask=np.isnan(score))], names=["key", "tags", "score"])

    return slim.mapInArrow(decode, f"key {kind}, tags array<string>, score double").withColumnRenamed("key", key)
