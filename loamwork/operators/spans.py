"""Entity spans: lexicons, longest matches, BIO tags, window stitching."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.operators.automaton import Automaton, match_batch

#: Entries of an automaton that goes to every task, and parts that a split lexicon's texts are dealt into for each start.
MOST_ENTRIES, SALTS = 100_000, 16


def lexicon(spans: DataFrame, least_count: int = 1, least_length: int = 1, single_labels: tuple[str, ...] = ()) -> DataFrame:
    """(text, label, n) of entity mentions that occur often enough and are long enough, or carry a label that may be short."""
    counts = spans.where(F.trim("text") != "").groupBy("text", "label").agg(F.count("*").alias("n"))
    return counts.where((F.col("n") >= least_count) & ((F.length("text") >= least_length) | F.col("label").isin(*single_labels)))


def occurrences(docs: DataFrame, words: DataFrame, id_col: str = "record_id", text_col: str = "text", most: int = MOST_ENTRIES) -> DataFrame:
    """(id, start, end, label, text, n): every place where a lexicon entry stands, whatever its length.

    Texts are read once by an automaton of the entries. One of at most ``most`` entries goes to every task. A larger
    lexicon is split by its entries' first two characters: a text goes to those parts alone that begin with characters
    it holds, each part's entries come before the texts in a sorted stream, and so no task holds more than one part.
    A null text has no place; entries that are null or empty stand nowhere; an empty lexicon gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start int, end int, text string"
    entries = words.where(F.length("text") > 0).select("text").distinct()
    if words.limit(most + 1).count() <= most:
        automaton = Automaton(sorted(r[0] for r in entries.collect()))

        def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from match_batch(automaton, batch, "id", "text")

        places = slim.where(F.col("text").isNotNull()).mapInArrow(matched, schema)
        found = places.join(F.broadcast(words), "text")
    else:
        found = _split_places(slim, entries, kind, schema, most).join(words, "text")
    return found.select(F.col("id").alias(id_col), "start", "end", "label", "text", "n")


def _split_places(slim: DataFrame, entries: DataFrame, kind: str, schema: str, most: int) -> DataFrame:
    """Places of a lexicon in parts, which entries' first two characters (or their only one) choose."""
    parts = -(-2 * entries.count() // most)
    salts = SALTS
    part_of = lambda start: F.pmod(F.xxhash64(start), F.lit(parts)).cast("int")
    starts = lambda chars: F.array_distinct(F.concat(chars, F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))))
    wanted = X.bound(X.characters(F.col("text")), lambda chars: F.array_distinct(F.transform(F.filter(starts(chars), lambda s: s.isNotNull()), part_of)))
    salt = F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int")
    texts = slim.where(F.length("text") > 0).select(F.explode(wanted).alias("part"), salt.alias("salt"), F.lit(1).alias("turn"), "id", "text")
    listed = entries.select(part_of(F.substring("text", 1, 2)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("id"), "text")
    stream = listed.unionByName(texts).repartition("part", "salt").sortWithinPartitions("part", "salt", "turn")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, automaton = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("part", "salt", "turn")])
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                run, (p, s, turn) = batch.slice(a, b - a), keys[:, a].tolist()
                if (p, s) != part:
                    part, held, automaton = (p, s), [], None
                if turn == 0:
                    held += run.column("text").to_pylist()
                    continue
                automaton = automaton or Automaton(sorted(held))
                yield from match_batch(automaton, run, "id", "text")

    return stream.mapInArrow(matched, schema)


def without_overlap(candidates: DataFrame, id_col: str = "record_id", order: str = "longest") -> DataFrame:
    """Greedy choice a document: longest first (``order`` "longest"), or earliest first and longer on ties ("first").

    A candidate is kept if it crosses none kept before, which the kept one before it in the text and the one after it
    tell. A document's candidates are in memory together; documents are independent of each other.
    """
    def kept(rows: pa.Table) -> pa.Table:
        start, end = rows.column("start").to_pylist(), rows.column("end").to_pylist()
        n, label, text = (rows.column(c).to_pylist() for c in ("n", "label", "text"))
        rank = (lambda i: (start[i] - end[i], start[i], -n[i], label[i], text[i])) if order == "longest" else (lambda i: (start[i], start[i] - end[i], label[i], text[i]))
        places, chosen, out = [], {}, []
        for i in sorted(range(len(start)), key=rank):
            k = bisect.bisect_left(places, start[i])
            before, after = places[k - 1] if k else None, places[k] if k < len(places) else None
            if (before is None or end[chosen[before]] <= start[i]) and (after is None or end[i] <= after):
                places.insert(k, start[i])
                chosen[start[i]] = i
                out.append(i)
        return rows.take(pa.array(out, pa.int64())).select([id_col, "start", "end", "label", "text"])

    rows = candidates.select(id_col, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.col("n").cast("long").alias("n")).where("start < end")
    kind = dict(candidates.dtypes)[id_col]
    return rows.groupBy(id_col).applyInArrow(kept, f"{id_col} {kind}, start int, end int, label string, text string")


def bio_tags(docs: DataFrame, spans: DataFrame, id_col: str = "record_id", text_col: str = "text") -> DataFrame:
    """(id, tags): a tag a character; spans out of bounds and those that cross an earlier, longer one are left out.

    Tags are laid out span by span, each after the gap before it.
    """
    valid = spans.join(docs.select(id_col, F.length(text_col).alias("_n")), id_col).where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n")))
    kept = without_overlap(valid.withColumn("n", F.lit(0)).withColumn("text", F.lit("")).drop("_n"), id_col, "first")
    by_doc = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("_s"))
    outside = lambda n: F.array_repeat(F.lit("O"), n.cast("int"))
    inside = lambda s: F.concat(F.array(F.concat(F.lit("B-"), s["label"])), F.array_repeat(F.concat(F.lit("I-"), s["label"]), s["end"] - s["start"] - 1))

    def laid_out(s):
        ends = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["end"]))
        pieces = F.zip_with(s, F.slice(ends, 1, F.size(s)), lambda x, before: F.concat(outside(x["start"] - before), inside(x)))
        return F.concat(F.flatten(pieces), outside(F.length(text_col) - F.get(ends, F.size(ends) - 1)))

    none = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return docs.join(by_doc, id_col, "left").select(id_col, F.when(F.length(text_col) > 0, X.bound(F.coalesce("_s", none), laid_out)).otherwise(F.array().cast("array<string>")).alias("tags"))


def spans_from_tags(tags: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(id, start, end, label): maximal runs, a B- with the I- of its label that follow; an I- without one is nothing.

    A document's runs are cut within its row, so that no row a character is shuffled or sorted.
    """
    label = lambda tag: F.substr(tag, F.lit(3))

    def runs(t):
        def cut(i):
            # at B-, and where a tag before it ends: at O and at a change of label
            tag, before = F.get(t, i), F.get(t, i - 1)
            return tag.startswith("B-") | ((before != "O") & ((tag == "O") | (label(tag) != label(before))))

        def between(cuts):
            ends = F.slice(F.concat(cuts, F.array(F.size(t))), 2, F.size(cuts))
            return F.filter(F.zip_with(cuts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.get(t, a).alias("first"))), lambda r: r["first"].startswith("B-"))

        return X.bound(F.filter(F.sequence(F.lit(0), F.size(t) - 1), cut), between)

    found = tags.select(id_col, F.explode(X.bound(F.col("tags"), runs)).alias("r"))
    return found.select(id_col, "r.start", "r.end", label(F.col("r.first")).alias("label"))


def stitched(spans: DataFrame, own: DataFrame) -> DataFrame:
    """Spans of overlapping windows in text offsets, each from the window that owns its middle, once."""
    return spans.join(own, ["record_id", "window"]).where("owned").select("record_id", "start", "end", "label").distinct()
