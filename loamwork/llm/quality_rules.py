"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Length, symbol, stop-word and line ratios, the base count of repeated windows and the verdict are all built-in functions
over a row; nothing is shuffled and no user function runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.sources.tables import table

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "as", "are", "was", "by", "this", "from", "or",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "est", "pour", "par", "sur", "au", "il", "elle", "dans",
    "der", "die", "das", "den", "dem", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "auf", "sich", "als", "ich", "für", "im", "er",
    "el", "los", "las", "y", "se", "no", "con", "por", "para", "su", "al", "lo", "como", "más", "o", "pero", "sus", "si", "una", "del",
)

#: Measure, least and most (None: open). A text is kept if all hold; measures are in ``measures``.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_length", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.05, None),
    ("upper_share", None, 0.3),
    ("emphatic_word_share", None, 0.1),
    ("stutter_share", None, 0.3),
    ("duplicate_line_share", None, 0.6),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.3),
)

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def with_window_hashes(rows: DataFrame, words: str, out: str) -> DataFrame:
    """``rows`` with the hashes of all windows of ``WINDOW`` words, a power of two, as array ``out``.

    A window's hash comes from those of its halves, so each doubling is one pass over the array before.
    """
    rows = rows.withColumn(out, F.transform(words, lambda w: F.xxhash64(w)))
    size = 1
    while size < WINDOW:
        ahead = F.slice(out, size + 1, F.greatest(F.size(out) - size, F.lit(0)))
        rows = rows.withColumn(out, F.zip_with(out, ahead, lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return rows.withColumn(out, F.slice(out, 1, F.greatest(F.size(out) - (WINDOW - 1), F.lit(0))))


def repeated_words(rows: DataFrame, hashes: str, out: str) -> DataFrame:
    """``rows`` with the number of words in windows whose hash occurs twice or more, first ones included.

    Texts whose hashes are all different, which most are, have none; only the others are sorted, and twins are
    neighbours then.
    """
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    by_hash = F.when(some, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_s", by_hash)
    twins = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"]))
    rows = rows.withColumn("_p", F.sort_array(F.transform(twins, lambda x: x["i"])))
    each = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(each, F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop("_s", "_p")


def measures(docs: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``docs`` with the counts and ratios that rules may name; a null text counts as empty. Ratios of nothing are 0."""
    classes = F.regexp_replace(F.col("_t"), r"[^\p{Lu}#*$%&|<>\x20\x09-\x0D]+", "")
    taken = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_w", _words(F.col("_t")))
    hashed = repeated_words(with_window_hashes(taken, "_w", "_h"), "_h", "n_repeat_words").drop("_h")
    split = hashed.withColumn("_l", _lines_with_words(F.col("_t"))).withColumn("_c", classes)
    count = lambda c: c.cast("long")
    less = lambda chars: F.length("_c") - F.length(F.translate(F.col("_c"), chars, ""))
    counted = split.select(
        *docs.columns,
        count(F.size("_w")).alias("n_words"),
        count(F.length("_t") - less(SPACES)).alias("word_chars"),
        count(less(SYMBOLS)).alias("n_symbols"),
        count(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        "n_repeat_words",
        count(F.size(F.filter("_w", lambda w: w.isin(*stop_words)))).alias("n_stop_words"),
        count(F.length("_c") - less(SPACES) - less(SYMBOLS)).alias("n_upper"),
        count(F.size(F.filter("_w", lambda w: w.endswith("!")))).alias("n_emphatic"),
        count(F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1)))).alias("n_stutter"),
        count(F.size("_l")).alias("n_lines"),
        count(F.size(F.filter("_l", lambda x: F.ltrim(x).rlike(r"^[-*•]")))).alias("n_bullet_lines"),
        count(F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")))).alias("n_ellipsis_lines"),
    )
    col = F.col
    return counted.select(
        "*",
        _share(col("word_chars"), col("n_words")).alias("mean_word_length"),
        _share(col("n_symbols"), col("n_words")).alias("symbols_per_word"),
        _share(col("n_stop_words"), col("n_words")).alias("stop_word_share"),
        _share(col("n_upper"), col("word_chars")).alias("upper_share"),
        _share(col("n_emphatic"), col("n_words")).alias("emphatic_word_share"),
        _share(col("n_stutter"), col("n_words")).alias("stutter_share"),
        _share(col("n_dup_lines"), col("n_lines")).alias("duplicate_line_share"),
        _share(col("n_bullet_lines"), col("n_lines")).alias("bullet_line_share"),
        _share(col("n_ellipsis_lines"), col("n_lines")).alias("ellipsis_line_share"),
    )


def compiled(rules: tuple[tuple[str, float | None, float | None], ...]) -> Column:
    """The names of the rules that a row breaks, in the table's order."""
    broken = []
    for name, least, most in rules:
        fails = [F.col(name) < least] if least is not None else []
        fails += [F.col(name) > most] if most is not None else []
        for fail in fails:
            broken.append(F.when(fail, F.lit(name)))
    return F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its measures, the rules it breaks and the verdict.

    ``base_failed``: under 20 words, or over 30 % of them in repeated windows. Null and empty texts have 0 words and
    fail. Rows are judged each for itself, so repeated rows get equal verdicts; an empty table gives no rows.
    """
    rows = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = rows.withColumn("base_failed", failed).withColumn("broken", compiled(rules))
    kept = ~F.col("base_failed") & (F.size("broken") == 0)
    return judged.withColumn("kept", kept).drop("text")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *(F.round(c, 9).alias(c) for c in ("stop_word_share", "upper_share", "emphatic_word_share")), F.array_join("broken", ",").alias("broken"),
    )


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
e AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM e) WHERE c > 1),
q AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words,
  len([x FOR x IN w IF x IN ({_STOPS})]) AS n_stop, len([i FOR i IN range(2, len(w) + 1) IF w[i] = w[i-1]]) AS n_stut,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len([x FOR x IN w IF x LIKE '%!']) AS n_emph, len(l) AS n_lines,
  len([x FOR x IN l IF regexp_matches(x, '^ *[-*\x{{2022}}]')]) AS n_bullet,
  len([x FOR x IN l IF regexp_matches(x, '(\.\.\.|\x{{2026}}) *$')]) AS n_ell FROM w LEFT JOIN q USING (doc_id)),
s AS (SELECT *, coalesce(1.0 * word_chars / nullif(n_words, 0), 0) AS mwl, coalesce(1.0 * n_symbols / nullif(n_words, 0), 0) AS spw,
  coalesce(1.0 * n_stop / nullif(n_words, 0), 0) AS stop, coalesce(1.0 * n_upper / nullif(word_chars, 0), 0) AS up,
  coalesce(1.0 * n_emph / nullif(n_words, 0), 0) AS emph, coalesce(1.0 * n_stut / nullif(n_words, 0), 0) AS stut, coalesce(1.0 * n_dup_lines / nullif(n_lines, 0), 0) AS dup,
  coalesce(1.0 * n_bullet / nullif(n_lines, 0), 0) AS bul, coalesce(1.0 * n_ell / nullif(n_lines, 0), 0) AS ell,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
b AS (SELECT *, concat_ws(',', CASE WHEN n_words < 20 THEN 'n_words' END, CASE WHEN mwl < 2 THEN 'mean_word_length' END,
  CASE WHEN mwl > 14 THEN 'mean_word_length' END, CASE WHEN spw > 0.1 THEN 'symbols_per_word' END,
  CASE WHEN stop < 0.05 THEN 'stop_word_share' END, CASE WHEN up > 0.3 THEN 'upper_share' END,
  CASE WHEN emph > 0.1 THEN 'emphatic_word_share' END, CASE WHEN stut > 0.3 THEN 'stutter_share' END, CASE WHEN dup > 0.6 THEN 'duplicate_line_share' END,
  CASE WHEN bul > 0.9 THEN 'bullet_line_share' END, CASE WHEN ell > 0.3 THEN 'ellipsis_line_share' END) AS broken FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept,
  round(stop, 9) AS stop_word_share, round(up, 9) AS upper_share, round(emph, 9) AS emphatic_word_share, broken FROM b
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": OP4_SQL}
