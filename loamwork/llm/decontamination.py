"""Benchmark decontamination: canonical templates, joined by the hashes of their windows.

All built-in functions. Every text has two forms. In the ``plain`` one, numbers become the placeholder n and units after
them u; it finds copies in other letter case and with other numbers. In the ``free`` one, names become p as well:
a name is a run of capitalised words but the ``COMMON`` ones, whatever stands before it, so that names at the start of a
sentence and items set into running text are found. A number is a run of digits with separators and number words
(``3.5``, ``1,200``, ``forty-two``, ``3 million``). What placeholders stand for is kept beside them.

A document holds an item if a window of ``WINDOW`` canonical words (or the whole item, if it is shorter) hashes the same
and the slots agree: the same value of the item always has the same value in the document and the other way round. So an
item with other numbers or names is caught, too. Windows that follow each other in both are a run, and
``consistent`` says whether the slots agree over a whole run. Items of fewer than ``LEAST`` canonical words hold
nothing: single common words would match everywhere. Typographic quotes and dashes and full-width forms count as the
plain ones; a character of a script without spaces, such as Chinese, is a word, half a one where items are too short. A window of the free form counts only if half of its words are no
placeholders.

A window can only match where its anchor stands, of its pairs of literal words the one that the fewest items have, or
such a word if no two stand together. Documents without any anchor, which one pass over their lower-case words tells, are never brought into canonical form; in the others windows
around anchors alone are hashed. Anchors and windows go to the tasks if the windows are at most ``BROADCAST_WINDOWS``;
for a larger benchmark all windows of the documents are hashed and joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamwork.llm.shared import fresh, let
from loamwork.sources.tables import table

WINDOW, LEAST, BROADCAST_WINDOWS = 13, 4, 50_000
#: Units of measure and money.
UNITS = (
    "kg", "g", "mg", "km", "m", "cm", "mm", "ml", "l", "s", "ms", "h", "min", "miles", "mile", "feet", "foot", "inches", "inch", "hours", "hour",
    "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "percent",
)
#: Words that are no names though capitalised.
COMMON = (
    "a", "an", "the", "this", "that", "these", "those", "it", "he", "she", "they", "we", "you", "his", "her", "its", "their", "our", "your", "my", "who", "whom", "whose", "what", "which", "when", "where", "why", "how",
    "is", "are", "was", "were", "do", "does", "did", "can", "could", "will", "would", "should", "has", "have", "had", "if", "in", "on", "at", "by", "for", "from", "of", "to", "with", "as", "and", "or", "but", "so", "then",
    "there", "each", "every", "all", "some", "no", "not", "after", "before", "during", "while", "because", "since", "find", "name", "give",
)
#: Number words, with what the single ones stand for.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1_000_000, "billion": 1_000_000_000,
}
#: ``MARK`` begins placeholders, ``JOINT`` holds parts of one value together, ``SAME`` marks capitalised words that are no names.
MARK, JOINT, SAME = "§", "·", "¤"
#: What parts words: ASCII but letters and digits; in texts yet without placeholders, digits and the marks as well.
APART, APART_LITERAL = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", rf"[\x00-\x60\x7b-\x7f{MARK}{SAME}]+"

#: Typographic marks and what they count as; full-width forms follow ASCII at a fixed distance.
QUOTES, DASHES, GAPS = "\u2018\u2019\u201a\u201b\u2032\u02bc", "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u00a0\u2002\u2003\u2009\u202f\u3000\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb\u2026\u2022\u3001\u3002\u3008\u3009\u300a\u300b\u300c\u300d\u300e\u300f\u3010\u3011\u3014\u3015\u30fb"
FULL_WIDTH = [chr(c) for c in range(0xFF01, 0xFF5F)]
MARKS = "".join((QUOTES, DASHES, GAPS, *FULL_WIDTH))
PLAIN_MARKS = "".join(("'" * len(QUOTES), "-" * len(DASHES), " " * len(GAPS), *(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)))
#: Any character but ASCII and Latin letters; all that ``simple`` changes is among these.
SPECIAL = r"[^\x00-\x7f\u00c0-\u024f]"
#: Characters of scripts that part no words by spaces: each is a word of its own.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"

_NUMBER_WORD = rf"(?:{'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))})(?!\p{{L}})"
_NAME = r"\p{Lu}\p{Ll}"


def simple(text: Column) -> Column:
    """The text without placeholders' marks, with plain quotes, dashes, spaces and full-width forms, and unspaced characters apart.

    One look for any such character spares most texts the rest.
    """
    given = F.coalesce(text, F.lit(""))
    apart = lambda t: F.when(t.rlike(UNSPACED), F.regexp_replace(t, UNSPACED, " $0 ")).otherwise(t)
    return F.when(given.rlike(SPECIAL), let(F.translate(given, MARK + SAME + MARKS, "  " + PLAIN_MARKS), apart)).otherwise(given)


def numbered(t: Column) -> Column:
    """A ``simple`` text with numbers as ``§n`` and their units as ``§u``, each with its value behind it."""
    joined = F.regexp_replace(F.regexp_replace(t, r",(?<=\d,)(?=\d{3}(?!\d))", ""), r"[.,](?<=\d[.,])(?=\d)", JOINT)
    joined = F.regexp_replace(joined, rf"(?i)(?=[ -]+{_NUMBER_WORD})(?<=\d|(?<!\p{{L}})(?:{'|'.join(NUMBER_WORDS)}))[ -]+", JOINT)
    number = rf"(?i)((?:\d+|(?=[{''.join(sorted({w[0] for w in NUMBER_WORDS}))}])(?<!\p{{L}}){_NUMBER_WORD})(?:{JOINT}(?:\d+|{_NUMBER_WORD}))*)"
    marked = F.regexp_replace(joined, number, f" {MARK}n$1 ")
    return F.regexp_replace(marked, rf"(?i)({MARK}n[^ ]+ +)({'|'.join(UNITS)})(?!\p{{L}})", rf"$1{MARK}u$2")


def named(t: Column) -> Column:
    """A ``numbered`` text with names as ``§p`` and their value."""
    common = "|".join(w.capitalize() for w in COMMON)
    t = F.regexp_replace(t, rf"(?<![\p{{L}}{MARK}])(?=(?:{common})(?!\p{{L}}))", SAME)
    t = F.regexp_replace(t, rf"(?<=(?<![\p{{L}}{MARK}{SAME}]){_NAME}{{1,40}})[ -](?={_NAME})", JOINT)
    return F.translate(F.regexp_replace(t, rf"(?<![\p{{L}}{MARK}{SAME}])(?={_NAME})", f"{MARK}p"), SAME, "")


def split_words(t: Column, apart: str = APART) -> Column:
    return F.array_remove(F.split(t, apart), "")


FORMS = ("plain", "free")


def with_words(rows: DataFrame, text_col: str) -> DataFrame:
    """For each of ``FORMS``: the canonical words, and as ``<form>_values`` the same with their values."""
    out = rows.withColumn("_numbered", numbered(simple(F.col(text_col))))
    for form in FORMS:
        text = F.lower("_numbered") if form == "plain" else F.lower(named(F.col("_numbered")))
        out = out.withColumn("_text", text).withColumn(f"{form}_values", split_words(F.col("_text")))
        canonical = split_words(F.regexp_replace("_text", rf"{MARK}([nup])[^\x00-\x2f\x3a-\x60\x7b-\x7f]*", rf"{MARK}$1"))
        out = out.withColumn(form, F.when(F.contains("_text", F.lit(MARK)), canonical).otherwise(F.col(f"{form}_values")))
    return out.drop("_text", "_numbered")


def slots(values: Column, start: Column, size: int | Column) -> Column:
    """The placeholders with their values of the window that starts at ``start``, counted from 0."""
    return F.filter(F.slice(values, start + 1, size), lambda x: x.startswith(MARK))


def literals(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.startswith(MARK))


def item_windows(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(item_id, form, size, nth, hash, words, item_slots): every window of every item in both forms; an item shorter than a window is one itself.

    Windows without a literal word are left out, those of the free form without a half of literal words as well. Both
    forms have windows without names, so that either form's windows cover the whole item.
    """
    rows = with_words(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "text")
    unspaced = F.size(F.filter("plain", lambda w: w.rlike(f"^{UNSPACED}$")))
    rows = rows.where(F.size("plain") - unspaced / 2 >= least)
    out = None
    for form in FORMS:
        size = F.least(F.size(form), F.lit(window))
        each = rows.withColumn("size", size).withColumn("nth", F.explode(F.sequence(F.lit(0), F.size(form) - F.col("size"))))
        part = F.slice(form, F.col("nth") + 1, F.col("size"))
        each = each.select("item_id", F.lit(form).alias("form"), "size", "nth", F.xxhash64(part).alias("hash"), part.alias("words"), slots(F.col(f"{form}_values"), F.col("nth"), F.col("size")).alias("item_slots"))
        each = each.where(F.size(literals(F.col("words"))) * (2 if form == "free" else 1) >= (F.col("size") if form == "free" else F.lit(1)))
        out = each if out is None else out.unionByName(each.where(F.col("size") >= least))
    return out


def pairs_of(words: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """``pair`` of each word and the one after it, null after the last."""
    return F.zip_with(words, F.slice(words, 2, 1 << 30), pair)


def anchors(items: DataFrame) -> DataFrame:
    """(size, anchor): for each window, of its pairs of literal words next to each other, or else of its literal words, the one that the fewest items have; of equals the longest."""
    literal = lambda w: ~w.startswith(MARK)
    both = F.array_compact(pairs_of(F.col("words"), lambda a, b: F.when(literal(a) & literal(b), F.concat(a, F.lit(" "), b))))
    some = F.when(F.size(both) > 0, both).otherwise(literals(F.col("words")))
    words = items.select("item_id", "form", "size", "nth", F.explode(F.array_distinct(some)).alias("word"))
    frequency = words.groupBy("word").agg(F.count_distinct("item_id").alias("n"))
    rank = F.struct("n", (-F.length("word")).alias("short"), "word")
    best = words.join(frequency, "word").groupBy("item_id", "form", "nth", "size").agg(F.min(rank)["word"].alias("anchor"))
    return best.select("size", "anchor").distinct()


def anchored(words: Column, keys: list[str]) -> Column:
    """For each word, whether an anchor begins there."""
    pairs, single = [k for k in keys if " " in k], [k for k in keys if " " not in k]
    first = sorted({k.split(" ")[0] for k in pairs})
    return pairs_of(words, lambda a, b: (a.isin(*first) & F.concat(a, F.lit(" "), b).isin(*pairs)) | a.isin(*single))


def document_windows(docs: DataFrame, size: int, keys: list[str] | None, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``ids``, form, at, hash, doc_slots) of windows of both forms that may match; all windows if ``keys`` is None."""
    if keys is not None:
        words = split_words(F.lower(simple(F.col("text"))), APART_LITERAL)
        docs = docs.where(F.array_contains(let(words, lambda w: anchored(w, keys)), True))

    def windows(form: str) -> Column:
        last = F.size(form) - size
        if keys is None:
            starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        else:
            at = F.array_compact(F.transform(anchored(F.col(form), keys), lambda hit, i: F.when(hit, i)))
            near = F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (size - 1), F.lit(0)), p)))
            starts = F.array_distinct(F.filter(near, lambda s: s <= last))
        return F.transform(starts, lambda s: F.struct(F.lit(form).alias("form"), s.alias("at"), F.xxhash64(F.slice(form, s + 1, size)).alias("hash"), slots(F.col(f"{form}_values"), s, size).alias("doc_slots")))

    rows = with_words(docs, "text")
    return rows.select(*ids, F.explode(F.concat(*map(windows, FORMS))).alias("x")).select(*ids, "x.*")


def valued(slots: Column) -> Column:
    """The slots with single number words as digits, so that ``forty`` and ``40`` are the same value."""
    known = F.create_map(*(F.lit(x) for w, n in NUMBER_WORDS.items() for x in (f"{MARK}n{w}", f"{MARK}n{n}")))
    return F.transform(slots, lambda x: F.coalesce(known[x], x))


def one_to_one(pairs: Column) -> Column:
    """Whether equal values of one side always meet equal values of the other, in an array of (item, doc)."""
    n = F.size(F.array_distinct(pairs))
    return (n == F.size(F.array_distinct(F.transform(pairs, lambda x: x["item"])))) & (n == F.size(F.array_distinct(F.transform(pairs, lambda x: x["doc"]))))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, most: int = BROADCAST_WINDOWS, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a (document, item) that share a window: ``ids``, which tell documents apart, item_id, n_windows, first_at, reparameterised, covered, consistent.

    ``covered``: the part of the item's windows that the document holds. ``reparameterised``: no window has all its
    values unchanged. ``consistent``: the slots agree over a whole run of windows, of the free form if it has any. ``first_at``: where the first
    shared window begins, in words of its form. A window that several items share counts for each of them. Null and empty texts, an empty table or benchmark and items of fewer
    than ``least`` words give no rows; repeated documents count by their id, a null id is an id, and other columns make
    no difference. Texts of any length are taken whole.
    """
    slim = docs.select(*(F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in ids), "text")
    items = item_windows(benchmark, window, least)
    few = items.limit(most + 1).count() <= most
    if few:
        sizes = [(r["size"], sorted(r["keys"])) for r in anchors(items).groupBy("size").agg(F.collect_set("anchor").alias("keys")).collect()]
    else:
        sizes = [(r["size"], None) for r in items.select("size").distinct().collect()]
    key = ["form", "hash", "item_slots"]
    distinct, found = items.select("size", *key).distinct(), None  # a window that many items share meets the documents once
    for size, keys in sorted(sizes, key=lambda x: x[0]):
        side = distinct.where(F.col("size") == size).select(*key)
        part = document_windows(slim, size, keys, ids).join(F.broadcast(side) if few else side, ["hash", "form"])
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = slim.where(F.lit(False)).select(*ids, *(F.lit(None).cast(t).alias(c) for c, t in (("hash", "long"), ("form", "string"), ("at", "int"), ("doc_slots", "array<string>"), ("item_slots", "array<string>"))))
    pairs = F.zip_with(valued(F.col("item_slots")), valued(F.col("doc_slots")), lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    found = found.select(*ids, *key, "at", pairs.alias("pairs"), (F.col("item_slots") == F.col("doc_slots")).alias("same")).where(one_to_one(F.col("pairs")))
    members = items.select(*key, "item_id", "nth")
    found = found.join(F.broadcast(members) if few else members, key).drop("hash", "item_slots")
    runs = found.groupBy(*ids, "item_id", "form", (F.col("at") - F.col("nth")).alias("begin")).agg(
        F.collect_set("nth").alias("nths"), F.min("at").alias("at"), F.max("same").alias("same"), one_to_one(F.flatten(F.collect_list("pairs"))).alias("consistent")
    )
    by_form = runs.groupBy(*ids, "item_id", "form").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("nths")))).cast("long").alias("n_windows"), F.min("at").alias("first_at"), F.max("same").alias("same"), F.max("consistent").alias("consistent")
    )
    totals = items.groupBy("item_id", "form").agg(F.count("*").alias("windows"))
    each = by_form.join(F.broadcast(totals) if few else totals, ["item_id", "form"])
    return each.groupBy(*ids, "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.min("first_at").alias("first_at"), (~F.max("same")).alias("reparameterised"),
        F.round(F.max(F.col("n_windows") / F.col("windows")), 6).alias("covered"),
        F.coalesce(F.max(F.when(F.col("form") == "free", F.col("consistent"))), F.max("consistent")).alias("consistent"),
    )


def benchmark_free(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Rows are told apart by id and text, null ids included."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text_col).alias("text_key"), F.col(text_col).alias("text"))
    named, key = fresh(docs.columns, "doc", "text_key")
    hit = matches(slim, benchmark, ids=("doc_id", "text_key")).select(F.col("doc_id").alias(named), F.col("text_key").alias(key)).distinct()
    return docs.join(hit, F.col(id_col).cast("long").eqNullSafe(F.col(named)) & (F.md5(text_col) == F.col(key)), "left_anti").select(*docs.columns)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
