"""Rules over typed, scored edges: inheritance (A), candidates (B), review flags (C) and role views (D).

Edges are rows ``edge_id, relation, head_type, head, tail_type, tail, authority_rank, books, support, confidence``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators.ordering import in_order
from loamwork.sources.staging import staged

SCORE = ("authority_rank", "books", "support", "confidence")
#: Stands for a null score, which is below any other; bits of a number within its list; rows of a batch taken at once.
_NONE, _LIST_BITS, _ROWS_AT_ONCE = -(1 << 62), 10, 4096


def of_type(edges: DataFrame, relation: str, head_type: str, tail_type: str) -> DataFrame:
    return edges.where((F.col("relation") == relation) & (F.col("head_type") == head_type) & (F.col("tail_type") == tail_type))


def best_edges(edges: DataFrame, by: Sequence[str] = ("head", "tail")) -> DataFrame:
    """The edge with the greatest (authority, books, support, confidence) of each key; ties go to the greater edge_id.

    Reducing to one edge a pair before rules join them is part of their meaning, as it decides how many paths there are.
    """
    best = F.max(F.struct(*SCORE, "edge_id")).alias("best")
    return edges.groupBy(*by).agg(best).select(*by, *(F.col(f"best.{c}") for c in (*SCORE, "edge_id")))


def _named(edges: DataFrame, head: str, tail: str, prefix: str) -> DataFrame:
    return edges.select(F.col("head").alias(head), F.col("tail").alias(tail), *(F.col(c).alias(f"{prefix}_{c}") for c in (*SCORE, "edge_id")))


def candidates(path: DataFrame, head: str, tail: str, prefixes: Sequence[str], asserted: DataFrame, paths: str | None = None) -> DataFrame:
    """One row a (head, tail) that the paths give and that is not asserted: number of paths and the best of them.

    A path's score is the tuple of its least authority, then the sums of authority, books, support and confidence; ties
    go to the greater edge ids. Pairs are compared by text alone. The asserted pairs are taken out before aggregation.
    ``paths`` names a column with the number of a pair's paths, where ``path`` holds only those that may be its best.
    """
    total = lambda c: sum((F.col(f"{p}_{c}") for p in prefixes[1:]), F.col(f"{prefixes[0]}_{c}"))
    ranks = [F.col(f"{p}_authority_rank") for p in prefixes]
    least = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    flat = (
        least.alias("least_rank"), total("authority_rank").alias("ranks"), total("books").alias("books"), total("support").alias("support"),
        F.round(total("confidence"), 9).alias("confidence"), *(F.col(f"{p}_edge_id") for p in prefixes),
        *(() if paths is None else [F.col(paths).alias("_paths")]),
    )
    rows = path.select(F.col(head).alias("head"), F.col(tail).alias("tail"), *flat)
    open_ = rows.join(asserted.select("head", "tail").distinct(), ["head", "tail"], "left_anti")
    score = F.struct("least_rank", "ranks", "books", "support", "confidence", F.array(*(f"{p}_edge_id" for p in prefixes)).alias("path"))
    number = F.count("*") if paths is None else F.max("_paths")
    found = open_.groupBy("head", "tail").agg(number.alias("path_count"), F.max(score).alias("best"))
    return found.select("head", "tail", "path_count", F.col("best.least_rank"), F.col("best.ranks"), F.col("best.books"), F.col("best.support"), F.col("best.confidence"), F.col("best.path"))


def b1(edges: DataFrame) -> DataFrame:
    """Ingredient enters a meridian, which corresponds to an organ that a disease affects: the ingredient may treat it.

    The few organs would spread every ingredient over every disease of theirs once a meridian. So the way to the organ
    is summed up before diseases come in: of each ingredient, organ and least authority, the number of ways and the
    best. As authority has few values and the rest of a score adds up, the best path is among these.
    """
    enters = _named(best_edges(of_type(edges, "entersmeridian", "Ingredient", "Meridian")), "ingredient", "meridian", "a")
    organ = _named(best_edges(of_type(edges, "correspondsToOrgan", "Meridian", "Organ")), "meridian", "organ", "b")
    affects = _named(best_edges(of_type(edges, "affectsOrgan", "Disease", "Organ")), "disease", "organ", "c")
    both = lambda c: F.col(f"a_{c}") + F.col(f"b_{c}")
    way = F.struct(both("authority_rank").alias("ranks"), both("books").alias("books"), both("support").alias("support"), F.round(both("confidence"), 9).alias("confidence"), F.array("a_edge_id", "b_edge_id").alias("path"))
    ways = enters.join(organ, "meridian").groupBy("ingredient", "organ", F.least("a_authority_rank", "b_authority_rank").alias("least")).agg(F.count("*").alias("ways"), F.max(way).alias("way"))
    asserted = edges.where("relation = 'treats'").select(F.col("head").alias("ingredient"), F.col("tail").alias("disease")).distinct()
    whole = ways.join(affects, "organ").join(asserted, ["ingredient", "disease"], "left_anti")
    score = F.struct(
        F.least("least", "c_authority_rank").alias("least_rank"), (F.col("way.ranks") + F.col("c_authority_rank")).alias("ranks"), (F.col("way.books") + F.col("c_books")).alias("books"),
        (F.col("way.support") + F.col("c_support")).alias("support"), F.round(F.col("way.confidence") + F.col("c_confidence"), 9).alias("confidence"), F.concat("way.path", F.array("c_edge_id")).alias("path"),
    )
    found = whole.groupBy(F.col("ingredient").alias("head"), F.col("disease").alias("tail")).agg(F.sum("ways").alias("path_count"), F.max(score).alias("best"))
    return found.select("head", "tail", "path_count", *(f"best.{c}" for c in ("least_rank", "ranks", "books", "support", "confidence", "path")))


def b2(edges: DataFrame) -> DataFrame:
    """A recipe may treat what an ingredient of it treats.

    Paths are many times the edges, so none is shuffled by itself. Diseases are numbered, and an edge to an ingredient takes
    what this treats, as numbers that hold disease and leading scores, to its recipe. There paths are counted, and those
    that lead by these scores are kept (``_leading``). Only they meet the whole edges.
    """
    kinds = ["head", "tail", "head_type", "tail_type"]
    asserted = staged(best_edges(edges.where("relation = 'treats'"), kinds), "rule-treats")  # asserted pairs and edges of the path in one pass
    treats = _named(asserted.where("head_type = 'Ingredient' AND tail_type = 'Disease'"), "ingredient", "disease", "b")
    numbers = staged(in_order(treats.select("disease").distinct(), [F.asc("disease")], "number"), "rule-diseases")
    code, fields = _coded(treats)
    treats = treats.alias("t").join(numbers.alias("n"), F.col("t.disease").eqNullSafe(F.col("n.disease"))).select("t.*", "number")
    lists = treats.repartition("ingredient").groupBy("ingredient", F.shiftright("number", _LIST_BITS).alias("word")).agg(F.collect_list(code).alias("codes"))
    # dealt by the key of the join, so that choosing a pair's best edge needs no exchange of its own
    contains = _named(best_edges(of_type(edges, "containsIngredient", "Recipe", "Ingredient").repartition("tail")), "recipe", "ingredient", "a")
    met = contains.join(lists, "ingredient").repartition("recipe").sortWithinPartitions("recipe")
    kept = ("recipe", "ingredient", *(f"a_{c}" for c in (*SCORE, "edge_id")))
    schema = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in kept)
    leading = met.select(*kept, "word", "codes").mapInArrow(lambda batches: _leading(batches, fields), f"{schema}, number long, paths long")
    return candidates(leading.join(treats, ["ingredient", "number"]), "recipe", "disease", ("a", "b"), asserted, "paths")


def _coded(treats: DataFrame) -> tuple[Column, list[tuple[str, int, int, int]]]:
    """The lower bits of ``number`` and the leading whole scores of an edge as one number, and (score, shift, bits, least) of each score.

    The widths come from the least and greatest of each score; those from the first that doesn't fit stay out. Zero is null.
    """
    whole = []
    for c in SCORE[:-1]:
        if treats.schema[f"b_{c}"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
            break
        whole.append(c)
    bounds = treats.agg(*(f(f"b_{c}").alias(f"{n}_{c}") for c in whole for n, f in (("min", F.min), ("max", F.max)))).first() if whole else {}
    at, code, fields = _LIST_BITS, F.col("number").bitwiseAND((1 << _LIST_BITS) - 1), []
    for c in whole:
        low, high = bounds[f"min_{c}"] or 0, bounds[f"max_{c}"] or 0
        bits = (high - low + 1).bit_length()
        if at + bits > 63:
            break
        code = code.bitwiseOR(F.shiftleft(F.coalesce(F.col(f"b_{c}").cast("long") - low + 1, F.lit(0).cast("long")), at))
        fields.append((f"a_{c}", at, bits, low))
        at += bits
    return (code.cast("int") if at < 32 else code), fields


def _leading(batches: Iterator[pa.RecordBatch], fields: Sequence[tuple[str, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """The paths of each recipe and number that lead by the scores in ``codes``, and ``paths``, how many there are in all.

    Rows come in order of the recipe. The last recipe of a batch goes on in the next, so its leading paths are held, with
    the number of paths so far at the first one of each number.
    """
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
            part = batch.slice(at, _ROWS_AT_ONCE)
            lists = part.column("codes")
            code = lists.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            number = (part.column("word").to_numpy()[row] << _LIST_BITS) | (code & ((1 << _LIST_BITS) - 1))
            rows, count = pa.Table.from_batches([part]).drop_columns(["word", "codes"]), np.ones(len(code), np.int64)
            if held is not None:
                row = np.concatenate([np.arange(held[0].num_rows), row + held[0].num_rows])
                rows = pa.concat_tables([held[0], rows])
                number, code, count = (np.concatenate([a, b]) for a, b in zip(held[1:], (number, code, count), strict=True))
            run = pc.dictionary_encode(rows.column("recipe").combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)
            pair, group = np.unique((run[row] << 32) | number, return_inverse=True)
            total = np.bincount(group, count, len(pair)).astype(np.int64)
            keep = _best_of(rows, row, code, group, len(pair), fields)
            ends = run[row[keep]] < run[-1]
            done, last = keep[ends], keep[~ends]
            yield _with_paths(rows, row[done], number[done], total[group[done]])
            first = np.unique(group[last], return_index=True)[1]
            count = np.zeros(len(last), np.int64)
            count[first] = total[group[last[first]]]
            held = rows.take(pa.array(row[last])), number[last], code[last], count
    if held is not None:
        group = np.unique(held[1], return_inverse=True)[1]
        yield _with_paths(held[0], np.arange(len(group)), held[1], np.bincount(group, held[3]).astype(np.int64)[group])


def _best_of(rows: pa.Table, row: np.ndarray, code: np.ndarray, group: np.ndarray, groups: int, fields: Sequence[tuple[str, int, int, int]]) -> np.ndarray:
    """Places of the paths of each group with the greatest least authority, then the greatest sum of each score."""
    keep = np.arange(len(code))
    for i, (name, shift, bits, low) in enumerate(fields):
        mine = rows.column(name).cast(pa.int64()).fill_null(_NONE).to_numpy()
        for least in (True, False) if i == 0 else (False,):
            held = (code[keep] >> shift) & ((1 << bits) - 1)
            x, y = mine[row[keep]], np.where(held == 0, _NONE, held + (low - 1))
            none = (x == _NONE) | (y == _NONE)
            value = np.where(none, np.maximum(x, y) if least else _NONE, np.minimum(x, y) if least else x + y)
            best = np.full(groups, np.iinfo(np.int64).min)
            np.maximum.at(best, group[keep], value)
            keep = keep[value == best[group[keep]]]
    return keep


def _with_paths(rows: pa.Table, row: np.ndarray, number: np.ndarray, paths: np.ndarray) -> pa.RecordBatch:
    taken = rows.take(pa.array(row, pa.int64()))
    columns = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in taken.columns]
    return pa.record_batch([*columns, pa.array(number, pa.int64()), pa.array(paths, pa.int64())], names=[*rows.schema.names, "number", "paths"])


def b3(edges: DataFrame) -> DataFrame:
    """An ingredient may treat a disease that a recipe with it treats."""
    treated = _named(best_edges(of_type(edges, "treatedByRecipe", "Disease", "Recipe")), "disease", "recipe", "a")
    contains = _named(best_edges(of_type(edges, "containsIngredient", "Recipe", "Ingredient").repartition("head")), "recipe", "ingredient", "b")
    return candidates(treated.join(contains, "recipe"), "ingredient", "disease", ("a", "b"), edges.where("relation = 'treats'"))


def inherited(edges: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """A1 to A3: a recipe has each ingredient's nature, flavour and meridian. One join for all three rules.

    ``vocabulary`` (rule, tail) keeps valid values only. Values are numbered, and an ingredient holds them as bits of words
    of 64 values. So a recipe meets a few words an ingredient, whose union is taken, instead of a row a property, and
    repeated edges change nothing.
    """
    rule = F.when(F.col("relation") == "hasNature", "A1").when(F.col("relation") == "hasFlavor", "A2").otherwise("A3")
    properties = edges.where(F.col("relation").isin("hasNature", "hasFlavor", "entersmeridian")).select(F.col("head").alias("ingredient"), "tail", rule.alias("rule"))
    values = (properties if vocabulary is None else vocabulary.where("tail is not null")).select("rule", "tail").distinct()
    contains = edges.where("relation = 'containsIngredient'").select(F.col("head").alias("recipe"), F.col("tail").alias("ingredient"))
    return _united(contains, properties, "ingredient", "recipe", ("rule", "tail"), values).select("rule", F.col("recipe").alias("head"), "tail")


def _united(pairs: DataFrame, held: DataFrame, by: str, key: str, value: Sequence[str], values: DataFrame | None = None) -> DataFrame:
    """(key, value): each value that ``held`` (by, value) gives any ``by`` of a key in ``pairs`` (key, by), once.

    Values are numbered, those of ``values`` or all; 64 of them are the bits of a word.
    """
    values = held.select(*value).distinct() if values is None else values
    number = in_order(values, [F.asc(c) for c in value], "nth")
    values = staged(number.select(*value, F.shiftright("nth", 6).alias("word"), F.col("nth").bitwiseAND(63).cast("int").alias("bit")), "rule-values")
    union = F.bit_or("bits").alias("bits")
    known = [F.col(f"h.{c}").eqNullSafe(F.col(f"v.{c}")) for c in value]
    bits = held.alias("h").join(values.alias("v"), functools.reduce(Column.__and__, known)).withColumn("bits", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")))
    words = pairs.join(bits.groupBy(by, "word").agg(union), by).groupBy(key, "word").agg(union)
    named = values.groupBy("word").agg(F.collect_list(F.struct("bit", *value)).alias("names"))
    own = F.filter("names", lambda n: F.call_function("getbit", F.col("bits"), n["bit"]) == 1)
    return words.join(named, "word").select(key, F.explode(own).alias("n")).select(key, *(f"n.{c}" for c in value))


def keyword_conflicts(edges: DataFrame, relation: str, rule: str, related: Column) -> DataFrame:
    """C1 and C2: an ingredient's property against what it treats; ``related`` is a predicate on ``property`` and ``disease``."""
    has = edges.where(F.col("relation") == relation).select(F.col("head").alias("ingredient"), F.col("tail").alias("property")).distinct()
    treats = edges.where("relation = 'treats'").select(F.col("head").alias("ingredient"), F.col("tail").alias("disease")).distinct()
    return has.join(treats, "ingredient").where(related).select(F.lit(rule).alias("rule"), "ingredient", "property", "disease")


def contradictions(edges: DataFrame) -> DataFrame:
    """C3: the same object is treated and contraindicated."""
    side = lambda r: edges.where(F.col("relation") == r).select("head", "tail").distinct()
    return side("treats").join(side("contraindicates"), ["head", "tail"], "left_semi").select(F.lit("C3").alias("rule"), F.col("head").alias("ingredient"), F.col("tail").alias("disease"))


def role_view(edges: DataFrame, role: str, hidden_type: str = "AncientText") -> DataFrame:
    """D1 to D3. ``general``: two sources or more and no hidden endpoint; ``professional``: no hidden endpoint; ``researcher``: all."""
    shown = (F.col("head_type") != hidden_type) & (F.col("tail_type") != hidden_type)
    condition = {"general": shown & (F.col("authority_rank") > 1), "professional": shown, "researcher": F.lit(True)}[role]
    return edges.where(condition)


def by_support(edges: DataFrame) -> DataFrame:
    """D4: strongest support first."""
    return edges.orderBy(F.desc("support"), F.desc("books"), F.desc("confidence"), "relation", "edge_id")


def propagated(edges: DataFrame) -> DataFrame:
    """B1 to B3 as sets: (rule, head, tail), asserted pairs included, each once. What an end reaches is united as bits."""
    pairs = lambda relation, head_type, tail_type, head, tail: of_type(edges, relation, head_type, tail_type).select(F.col("head").alias(head), F.col("tail").alias(tail))
    contains = pairs("containsIngredient", "Recipe", "Ingredient", "recipe", "ingredient")
    to_organ = _united(pairs("entersmeridian", "Ingredient", "Meridian", "ingredient", "meridian"), pairs("correspondsToOrgan", "Meridian", "Organ", "meridian", "organ"), "meridian", "ingredient", ("organ",))
    b1_ = _united(to_organ, pairs("affectsOrgan", "Disease", "Organ", "disease", "organ"), "organ", "ingredient", ("disease",)).select(F.lit("B1").alias("rule"), F.col("ingredient").alias("head"), F.col("disease").alias("tail"))
    b2_ = _united(contains, pairs("treats", "Ingredient", "Disease", "ingredient", "disease"), "ingredient", "recipe", ("disease",)).select(F.lit("B2").alias("rule"), F.col("recipe").alias("head"), F.col("disease").alias("tail"))
    b3_ = _united(contains, pairs("treatedByRecipe", "Disease", "Recipe", "disease", "recipe"), "recipe", "ingredient", ("disease",)).select(F.lit("B3").alias("rule"), F.col("ingredient").alias("head"), F.col("disease").alias("tail"))
    return b1_.unionByName(b2_).unionByName(b3_)


def flattened(found: DataFrame, edges: DataFrame, relations: Sequence[str], most: int = 3) -> DataFrame:
    """``found`` with its path's edges in columns ``edge1_...``, the least authority of them and their distinct books in order of the path.

    ``relations`` names the relation of each edge of the path; edges that a shorter path lacks are null. Of records with
    one id in a relation the one of the greatest score counts.
    """
    out = found
    for i in range(most):
        if i < len(relations):
            best = edges.where(F.col("relation") == relations[i]).groupBy("edge_id").agg(F.max(F.struct(*SCORE, "relation", "head", "tail")).alias("e"))
            own = best.select(F.col("edge_id").alias("_id"), *(F.col(f"e.{c}").alias(f"edge{i + 1}_{c}") for c in ("relation", "head", "tail", "authority_rank", "books")))
            out = out.join(own, F.get("path", F.lit(i)) == F.col("_id"), "left").drop("_id")
        else:
            kinds = {"authority_rank": "int", "books": "int"}
            out = out.withColumns({f"edge{i + 1}_{c}": F.lit(None).cast(kinds.get(c, "string")) for c in ("relation", "head", "tail", "authority_rank", "books")})
    ranks = F.array(*(F.col(f"edge{i + 1}_authority_rank") for i in range(most)))
    books = F.array_distinct(F.array_compact(F.array(*(F.col(f"edge{i + 1}_books").cast("string") for i in range(most)))))
    return out.withColumn("path_authority", F.array_min(ranks)).withColumn("path_books", F.array_join(books, ";"))
