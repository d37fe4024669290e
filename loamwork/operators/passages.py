"""Passages: character TF-IDF, local retrieval, donors, identity lexicons, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.operators.ordering import RANGES, numbered, text_place


def term_weights(units: DataFrame, key: Sequence[str], text_col: str, low: int = 1, high: int = 3, least_df: int = 2, most_features: int | None = None) -> DataFrame:
    """(key, term, weight): sublinear TF-IDF of character n-grams with length 1; idf = ln((1 + N) / (1 + df)) + 1."""
    terms = units.select(*key, F.explode(X.all_ngrams(F.col(text_col), low, high)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    n = units.count()
    df = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= least_df)
    if most_features is not None:
        df = df.orderBy(F.desc("total"), "term").limit(most_features)
    raw = terms.join(df, "term").withColumn("w", (1 + F.ln("tf")) * (F.ln((1.0 + n) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, list(key)).select(*key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(left: DataFrame, right: DataFrame, key: Sequence[str], within: Sequence[str]) -> DataFrame:
    """(key, similarity) of weighted terms on either side that share ``within`` (an item): a join on item and term."""
    both = left.alias("l").join(right.alias("r"), [*within, "term"])
    return both.groupBy(*key).agg(F.sum(F.col("l.weight") * F.col("r.weight")).alias("similarity"))


def selected_segments(segments: DataFrame, top: int = 3) -> DataFrame:
    """Segments (item_id, idx, similarity, holds_endpoint) that are among the ``top`` or next to one that holds an endpoint."""
    by_score = Window.partitionBy("item_id").orderBy(F.desc("similarity"), "idx")
    by_place = Window.partitionBy("item_id").orderBy("idx")
    near = F.col("holds_endpoint") | F.coalesce(F.lag("holds_endpoint").over(by_place), F.lit(False)) | F.coalesce(F.lead("holds_endpoint").over(by_place), F.lit(False))
    return segments.withColumn("place", F.row_number().over(by_score)).withColumn("mandatory", near).where((F.col("place") <= top) | F.col("mandatory"))


def retrieval_summary(segments: DataFrame) -> DataFrame:
    """Best and second score and their margin of each item."""
    ordered = segments.groupBy("item_id").agg(F.sort_array(F.collect_list("similarity"), False).alias("s"))
    best, second = F.coalesce(F.get("s", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    return ordered.select("item_id", best.alias("best"), second.alias("second"), (best - second).alias("margin"))


def closest_donor(items: DataFrame, donors: DataFrame, tiers: Sequence[Sequence[str]], by: str, key: str = "item_id") -> DataFrame:
    """(key, donor, tier, score): the donor of the least difference of ``by`` in the first tier of keys with any; the score is minus that.

    Within the keys of a tier, cut into ranges of ``by`` so that no key lies in one task, a running maximum gives the
    nearest donor on either side, and a row a key and range carries it over the ranges between. ``by`` is not null.
    """
    splits = donors.agg(F.percentile_approx(F.col(by).cast("double"), [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0] or []
    cuts = F.array(*(F.lit(float(s)) for s in sorted(set(splits)))) if splits else F.array().cast("array<double>")
    left, out = items, None
    side = lambda df, donor: df.where(F.col(by).isNotNull()).withColumn("_range", F.size(F.filter(cuts, lambda s: s <= F.col(by).cast("double")))).withColumn("_donor", F.lit(donor))
    for tier, on in enumerate(tiers, 1):
        columns = [key, by, "_range", "_donor", *on]
        both = side(left, 0).select(columns).unionByName(side(donors, 1).select(columns))
        # below: greatest value, then least key; above: least value, then least key
        low = F.when(F.col("_donor") == 1, F.struct(F.col(by).alias("v"), (-F.col(key)).alias("k")))
        high = F.when(F.col("_donor") == 1, F.struct((-F.col(by)).alias("v"), (-F.col(key)).alias("k")))
        edges = both.groupBy(*on, "_range").agg(F.max(low).alias("last"), F.max(high).alias("first"))
        ranges = Window.partitionBy(*on).orderBy("_range")
        carried = edges.select(*on, "_range", F.max("last").over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.max("first").over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
        within = Window.partitionBy(*on, "_range").orderBy(by)
        near = both.withColumn("_low", F.max(low).over(within.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_high", F.max(high).over(within.rangeBetween(0, Window.unboundedFollowing)))
        met = near.where(F.col("_donor") == 0).join(carried, [*on, "_range"])
        sides = [F.struct((-F.abs(F.col(f"{c}.v") * sign - F.col(by))).cast("double").alias("score"), F.col(f"{c}.k").alias("minus")) for c, sign in (("_low", 1), ("_below", 1), ("_high", -1), ("_above", -1))]
        found = met.where(F.coalesce(*(F.col(c) for c in ("_low", "_below", "_high", "_above"))).isNotNull())
        best = F.array_max(F.filter(F.array(*sides), lambda x: x["score"].isNotNull()))
        chosen = found.withColumn("b", best).select(key, (-F.col("b.minus")).alias("donor"), F.lit(tier).alias("tier"), F.col("b.score").alias("score"))
        out = chosen if out is None else out.unionByName(chosen)
        left = left.join(chosen.select(key), key, "left_anti")
    return out


def identity_lexicon(rows: DataFrame, error_label: str = "ENTITY_OR_TYPE_ERROR") -> DataFrame:
    """(surface, type, n, heads, tails) of mentions in rows not marked as errors."""
    side = lambda role: F.struct(X.surface(F.col(f"{role}_text"), False).alias("surface"), F.col(f"{role}_type").alias("type"), F.lit(role).alias("role"))
    long = rows.where(F.col("label") != error_label).select(F.explode(F.array(side("head"), side("tail"))).alias("m")).select("m.*")
    return long.where((F.col("surface") != "") & (F.col("type") != "")).groupBy("surface", "type").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "head").alias("heads"), F.count_if(F.col("role") == "tail").alias("tails"))


def identity_features(rows: DataFrame, lexicon: DataFrame, role: str) -> DataFrame:
    """Counts and shares of the expected and other types of a mention's surface."""
    by_surface = lexicon.groupBy("surface").agg(F.sum("n").alias("total"), F.max("n").alias("dominant"), F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("types"))
    s = rows.withColumn("surface", X.surface(F.col(f"{role}_text"), False)).join(by_surface, "surface", "left")
    total = F.coalesce("total", F.lit(0))
    expected = F.coalesce(F.try_element_at("types", F.col(f"{role}_type")), F.lit(0))
    share = lambda a: a / F.greatest(total, F.lit(1))
    return s.select(
        *rows.columns, (total > 0).cast("int").alias(f"{role}_seen"), total.alias(f"{role}_count"), expected.alias(f"{role}_expected"), (total - expected).alias(f"{role}_other"),
        share(expected).alias(f"{role}_expected_share"), share(F.coalesce("dominant", F.lit(0))).alias(f"{role}_dominant_share"), ((total > 0) & (expected == 0)).cast("int").alias(f"{role}_only_other"),
        (F.length("surface") == 1).cast("int").alias(f"{role}_single"),
    )


#: Endings of recipe names and of meridian names, and the quotation marks of titles.
RECIPE_ENDINGS, MERIDIAN_ENDING = ("方", "汤", "丸", "散", "羹", "粥", "酒", "饮"), "经"
TITLE_QUOTES = (("《", "》"), ("<", "》"), ("〈", "〉"))


def source_titles(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(title): the distinct comparison forms of the named columns, errors included, empty ones left out."""
    long = rows.select(F.explode(F.array(*(X.source_title(F.col(c), False) for c in columns))).alias("title"))
    return long.where(F.col("title") != "").distinct()


def span_flags(rows: DataFrame, titles: DataFrame, role: str, passage: str) -> DataFrame:
    """``rows`` with what a mention's own text and passage say: size, visible share, occurrences, titles and endings."""
    raw, surface = F.coalesce(F.col(f"{role}_text"), F.lit("")), X.surface(F.col(f"{role}_text"), False)
    text = F.coalesce(F.col(passage), F.lit(""))
    quoted = F.lit(False)
    for left, right in TITLE_QUOTES:
        quoted = quoted | F.contains(text, F.concat(F.lit(left), raw, F.lit(right)))
    marked = rows.withColumn("_surface", surface).join(titles.select(F.col("title").alias("_surface"), F.lit(1).alias("_known")), "_surface", "left")
    flag = lambda c: c.cast("int")
    ends = F.lit(False)
    for ending in RECIPE_ENDINGS:
        ends = ends | F.endswith("_surface", F.lit(ending))
    return marked.select(
        *rows.columns, flag(F.length("_surface") <= 2).alias(f"{role}_short"), X.share_of(raw, r"\p{L}\p{N}\x{3400}-\x{9FFF}").alias(f"{role}_visible"), X.occurrences(X.surface(text, False), F.col("_surface")).alias(f"{role}_occurrences"),
        flag(F.col("_known").isNotNull() & (F.col("_surface") != "")).alias(f"{role}_known_title"), flag((raw != "") & quoted).alias(f"{role}_quoted"), flag(ends).alias(f"{role}_recipe_ending"),
        flag(F.endswith("_surface", F.lit(MERIDIAN_ENDING))).alias(f"{role}_meridian_ending"),
    )


def majority(rows: DataFrame, field: str | None, label: str) -> DataFrame:
    """The most frequent label, in all or for each value of ``field``; ties go to the first in order."""
    own = [field] if field else []
    counts = rows.groupBy(*own, label).count()
    best = F.min(F.struct((-F.col("count")).alias("m"), F.col(label).alias("l")))
    out = counts.groupBy(*own).agg(best.alias("b"))
    return out.select(*own, F.col("b.l").alias("majority"), (-F.col("b.m")).alias("n"))


def vocabulary(values: DataFrame, column: str) -> DataFrame:
    """(value, n, index): values by falling count and then by name, numbered from 1, in ranges and not in one task."""
    counts = values.groupBy(column).agg(F.count("*").alias("n"))
    place = -F.col("n").cast("double") + F.coalesce(text_place(F.col(column)), F.lit(0.0)) / 2.0**50
    return numbered(counts, place, [F.desc("n"), column], "index").withColumn("index", F.col("index").cast("int"))


def error_rates(pairs: DataFrame, reference: str = "reference", raw: str = "raw") -> DataFrame:
    """``pairs`` with reference length, edit distance and their ratio."""
    ref, hyp = X.compact(F.col(reference)), X.compact(F.col(raw))
    out = pairs.withColumn("reference_chars", F.length(ref)).withColumn("distance", F.levenshtein(ref, hyp))
    return out.withColumn("cer", F.try_divide(F.col("distance").cast("double"), F.col("reference_chars").cast("double")))


def eligible_pages(pages: DataFrame, text_col: str = "text", least: int = 80, most: int = 12_000, cjk: float = 0.20) -> DataFrame:
    """Pages of a usable length with enough CJK characters."""
    return pages.where(F.col(text_col).isNotNull() & F.length(text_col).between(least, most) & (X.cjk_share(F.col(text_col)) >= cjk))


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails if ``right`` has a key twice."""
    once = right.groupBy(key).agg(*(F.first(c).alias(c) for c in right.columns if c != key), F.count("*").alias("_n"))
    checked = once.where(F.assert_true(F.col("_n") == 1, F.lit(f"{key} is not unique")).isNull()).drop("_n")
    return left.join(checked, key, "left")
