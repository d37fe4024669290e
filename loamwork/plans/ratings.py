"""Agreement, resampling, study and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.operators import agreement, resample, splits, study
from loamwork.operators.multinomial import cell_weights, value_replicates
from loamwork.plans.bindings import GOLD_SQL, LABELS, RATER_SQL, STUDY_SQL, gold, raters
from loamwork.plans.bindings import study as study_rows
from loamwork.plans.evaluation import nine
from loamwork.sources.tables import table

_U = lambda key: f"('0x' || substr(sha256({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
R = 60


def kappa(spark, sf_dir):
    return nine(agreement.kappa(raters(spark, sf_dir), "first", "second", ("lang",)), "observed", "expected", "kappa")


KAPPA_SQL = f"""WITH r AS ({RATER_SQL}), x AS (SELECT lang, first, second FROM r UNION ALL SELECT NULL, first, second FROM r), c AS (SELECT unnest(['yes', 'no', 'unsure']) AS k),
m AS (SELECT coalesce(lang, '*') AS l, k, count(*) FILTER (first = k) AS a, count(*) FILTER (second = k) AS b, count(*) FILTER (first = k AND second = k) AS same FROM x, c GROUP BY ALL),
s AS (SELECT l, sum(a) AS n, sum(same) / sum(a) AS o, sum(a * b) / (sum(a) * sum(a)) AS e FROM m GROUP BY l)
SELECT nullif(l, '*') AS lang, CAST(n AS BIGINT) AS n, round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e = 1 THEN 1 ELSE (o - e) / (1 - e) END, 6) AS kappa FROM s"""


def rating_table(spark, sf_dir):
    """Ratings of one against the other as a pivot."""
    return raters(spark, sf_dir).groupBy("first").pivot("second", ["yes", "no", "unsure"]).count().na.fill(0)


RATING_SQL = f"WITH r AS ({RATER_SQL}) SELECT first, count(*) FILTER (second = 'yes') AS yes, count(*) FILTER (second = 'no') AS no, count(*) FILTER (second = 'unsure') AS unsure FROM r GROUP BY first"


def adjudication(spark, sf_dir):
    rows = agreement.adjudicated(raters(spark, sf_dir), "first", "second", "third")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("final") == "yes").alias("supported"), F.count_if(F.col("final_source") == "adjudication").alias("adjudicated"))
    ci = agreement.wilson(F.col("supported"), F.col("n"))
    return counts.select("*", F.round(F.col("supported") / F.col("n"), 6).alias("share"), F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


_Z = agreement.Z95
ADJUDICATION_SQL = f"""WITH r AS ({RATER_SQL}), f AS (SELECT lang, CASE WHEN first = second THEN first ELSE third END AS final, first <> second AS adj FROM r),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (final = 'yes') AS supported, count(*) FILTER (adj) AS adjudicated FROM f GROUP BY lang), p AS (SELECT *, CAST(supported AS DOUBLE) / n AS share FROM c)
SELECT lang, n, supported, adjudicated, round(share, 6) AS share, round(greatest(0, ((share + {_Z * _Z} / (2 * n)) - {_Z} * sqrt(share * (1 - share) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS low,
  round(least(1, ((share + {_Z * _Z} / (2 * n)) + {_Z} * sqrt(share * (1 - share) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS high FROM p"""


def _correct(spark, sf_dir):
    return gold(spark, sf_dir).select("doc_id", "source", "lang", "gold", "pred", (F.col("gold") == F.col("pred")).cast("int").alias("ok"))


_OK = f"g AS (SELECT doc_id, source, lang, gold, pred, CAST(gold = pred AS INT) AS ok FROM ({GOLD_SQL}))"


def bootstrap_items(spark, sf_dir):
    return nine(resample.bootstrap_mean(_correct(spark, sf_dir), "ok", "doc_id", R, 11), "estimate")


ITEMS_SQL = f"""WITH {_OK}, u AS (SELECT ok, row_number() OVER (ORDER BY doc_id) - 1 AS unit FROM g), n AS (SELECT count(*) AS n FROM g),
d AS (SELECT replicate, CAST(floor({_U("'11|' || replicate || '|' || draw")} * n) AS BIGINT) AS unit FROM (SELECT unnest(range({R})) AS replicate), (SELECT n, unnest(range(n)) AS draw FROM n))
SELECT CAST(replicate AS INT) AS replicate, round(avg(ok), 6) AS estimate FROM d JOIN u USING (unit) GROUP BY replicate"""


def bootstrap_interval(spark, sf_dir):
    out = resample.bootstrap_mean(_correct(spark, sf_dir), "ok", "doc_id", R, 11)
    linear = resample.interval(out, "estimate").withColumn("method", F.lit("linear"))
    return nine(linear.unionByName(resample.interval(out, "estimate", method="nearest").withColumn("method", F.lit("nearest"))), "low", "high")


INTERVAL_SQL = f"""WITH e AS ({ITEMS_SQL.replace('round(avg(ok), 6)', 'avg(ok)')}), o AS (SELECT list_sort(list(estimate)) AS v FROM e)
SELECT round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, count(*) AS replicates, 'linear' AS method FROM e
UNION ALL SELECT round(v[CAST(floor(0.025 * {R}) AS INT) + 1], 6), round(v[CAST(floor(0.975 * {R}) AS INT) + 1], 6), {R}, 'nearest' FROM o"""


CELL_R = 2000


def _cell_replicates(weights, *by):
    """Accuracy and macro-F1 of every replicate from the weights of (gold|pred) cells."""
    w = weights.select("replicate", *by, F.split("cell", r"\|").alias("c"), "weight").select("replicate", *by, F.col("c")[0].alias("gold"), F.col("c")[1].alias("pred"), "weight")
    side = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("weight").alias("b")), F.struct(F.col("pred").alias("label"), F.col("weight").alias("b"))))
    hit = F.when((F.col("gold") == F.col("pred")), F.col("weight") / 2).otherwise(0)  # both sides of a hit are rows
    labels = w.select("*", side.alias("s")).groupBy("replicate", "s.label").agg(F.sum("s.b").alias("b"), F.sum(hit).alias("tp"))
    f1 = labels.groupBy("replicate").agg((F.sum(2 * F.col("tp") / F.col("b")) / len(LABELS)).alias("macro_f1"))
    total = w.groupBy("replicate").agg((F.sum(F.when(F.col("gold") == F.col("pred"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("accuracy"))
    return total.join(f1, "replicate")


def bootstrap_cells(spark, sf_dir):
    """Accuracy and macro-F1 of 2,000 replicates of all items, their draws split over the cells of gold and predicted labels."""
    cells = _correct(spark, sf_dir).groupBy(F.concat_ws("|", "gold", "pred").alias("cell")).agg(F.count("*").alias("n"))
    return nine(_cell_replicates(cell_weights(cells, "cell", "n", CELL_R, 29)), "accuracy", "macro_f1")


def bootstrap_cells_by_source(spark, sf_dir):
    """The same with items drawn within their source, as (low, high) of the percentile interval."""
    cells = _correct(spark, sf_dir).groupBy("source", F.concat_ws("|", "gold", "pred").alias("cell")).agg(F.count("*").alias("n"))
    out = _cell_replicates(cell_weights(cells, "cell", "n", CELL_R, 31, "source"))
    accuracy, f1 = (resample.interval(out, c).withColumn("measure", F.lit(c)) for c in ("accuracy", "macro_f1"))
    return nine(accuracy.unionByName(f1), "low", "high")


def _split_sql(seed: int, stratum: str) -> str:
    """Weights (replicate, s, cell, w) of the cells ``c`` (s, cell, n): sequential binomial splits by their distribution function."""
    key = f"'{seed}|' || replicate{stratum} || '|' || c.cell"
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY cell) AS k, sum(n) OVER (PARTITION BY s) AS total, sum(n) OVER (PARTITION BY s ORDER BY cell ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM c),
u AS (SELECT replicate, c.s, c.cell, c.k, c.n::DOUBLE / c.rest AS p, (('0x' || substr(sha256({key}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE AS u, c.total FROM o c, (SELECT unnest(range({CELL_R})) AS replicate)),
w(replicate, s, k, cell, left_, w) AS (SELECT replicate, s, 0::BIGINT, NULL::VARCHAR, total::BIGINT, 0::BIGINT FROM u WHERE k = 1
  UNION ALL SELECT replicate, s, k, any_value(cell), any_value(left_) - x, x FROM (SELECT *, CASE WHEN p >= 1 OR left_ = 0 THEN left_ ELSE least(high, low + count(*) FILTER (cum <= u * whole) OVER (PARTITION BY replicate, s)) END AS x FROM (
    SELECT *, sum(pmf) OVER (PARTITION BY replicate, s ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(pmf) OVER (PARTITION BY replicate, s) AS whole FROM (
    SELECT *, CASE WHEN p >= 1 THEN 1 ELSE exp(lgamma(left_ + 1) - lgamma(v + 1) - lgamma(left_ - v + 1) + v * ln(least(p, 0.5 + p / 2)) + (left_ - v) * ln(greatest(1 - p, 1e-300))) END AS pmf FROM (
    SELECT *, unnest(range(low, high + 1)) AS v FROM (SELECT u.replicate, u.s, u.k, u.cell, u.p, u.u, w.left_,
      CASE WHEN p >= 1 THEN w.left_ ELSE greatest(0, CAST(floor(w.left_ * p - 12 * sqrt(w.left_ * p * (1 - p)) - 12) AS BIGINT)) END AS low,
      CASE WHEN p >= 1 THEN w.left_ ELSE least(w.left_, CAST(ceil(w.left_ * p + 12 * sqrt(w.left_ * p * (1 - p)) + 12) AS BIGINT)) END AS high
      FROM w JOIN u ON u.replicate = w.replicate AND u.s IS NOT DISTINCT FROM w.s AND u.k = w.k + 1))))) GROUP BY replicate, s, k, x),
x AS (SELECT replicate, string_split(cell, '|')[1] AS gold, string_split(cell, '|')[2] AS pred, w FROM w WHERE k > 0),
a AS (SELECT replicate, sum(w) FILTER (gold = pred) / sum(w) AS accuracy FROM x GROUP BY replicate),
l AS (SELECT replicate, label, sum(CASE WHEN gold = label AND pred = label THEN w ELSE 0 END) AS tp, sum(CASE WHEN gold = label THEN w ELSE 0 END) + sum(CASE WHEN pred = label THEN w ELSE 0 END) AS b FROM x, (SELECT unnest({list(LABELS)}) AS label) GROUP BY ALL),
f AS (SELECT replicate, sum(coalesce(2.0 * tp / nullif(b, 0), 0)) / {len(LABELS)} AS macro_f1 FROM l GROUP BY replicate)"""


CELLS_SQL = f"""WITH RECURSIVE {_OK}, c AS (SELECT 1 AS s, gold || '|' || pred AS cell, count(*) AS n FROM g GROUP BY ALL), {_split_sql(29, "")}
SELECT a.replicate, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM a JOIN f USING (replicate)"""
CELLS_SOURCE_SQL = f"""WITH RECURSIVE {_OK}, c AS (SELECT source AS s, gold || '|' || pred AS cell, count(*) AS n FROM g GROUP BY ALL), {_split_sql(31, " || '|' || c.s")}
SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS replicates, measure FROM (SELECT 'accuracy' AS measure, accuracy AS v FROM a UNION ALL SELECT 'macro_f1', macro_f1 FROM f) GROUP BY measure"""


def bootstrap_values(spark, sf_dir):
    """Percentile interval of the mean number of characters of all documents, from 2,000 replicates."""
    out = value_replicates(table(spark, sf_dir, "documents"), "n_chars", "doc_id", CELL_R, 37)
    return nine(resample.interval(out, "estimate"), "low", "high")


def bootstrap_two_stage(spark, sf_dir):
    rows = _correct(spark, sf_dir)
    weights = resample.two_stage_weights(rows, "source", "doc_id", R, 13)
    mean = resample.weighted_mean(weights, rows, "doc_id", "ok").withColumnRenamed("estimate", "accuracy")
    f1 = resample.weighted_macro_f1(weights, rows, "doc_id", "gold", "pred", LABELS).withColumnRenamed("estimate", "macro_f1")
    return nine(mean.join(f1, "replicate"), "accuracy", "macro_f1")


TWO_STAGE_SQL = f"""WITH {_OK}, s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) - 1 AS unit FROM g GROUP BY source), k AS (SELECT count(*) AS k FROM s),
d AS (SELECT replicate, CAST(floor({_U("'13|' || replicate || '|' || draw")} * k) AS BIGINT) AS unit FROM (SELECT unnest(range({R})) AS replicate), (SELECT k, unnest(range(k)) AS draw FROM k)),
t AS (SELECT replicate, unit, row_number() OVER (PARTITION BY replicate, unit) AS turn FROM d),
i AS (SELECT replicate, source, CAST(floor({_U("'13|item|' || replicate || '|' || source || '|' || turn || '|' || draw")} * n) AS BIGINT) AS item FROM (SELECT t.replicate, t.turn, s.source, s.n, unnest(range(s.n)) AS draw FROM t JOIN s USING (unit))),
u AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS item FROM g), x AS (SELECT replicate, ok, gold, pred FROM i JOIN u USING (source, item)),
l AS (SELECT replicate, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) + count(*) FILTER (pred = label) AS b FROM x, (SELECT unnest({list(LABELS)}) AS label) GROUP BY ALL),
f AS (SELECT replicate, sum(coalesce(2.0 * tp / nullif(b, 0), 0)) / 4 AS macro_f1 FROM l GROUP BY replicate)
SELECT CAST(x.replicate AS INT) AS replicate, round(avg(ok), 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1 FROM x JOIN f USING (replicate) GROUP BY x.replicate"""


def bootstrap_strata(spark, sf_dir):
    return nine(resample.bootstrap_strata(_correct(spark, sf_dir), "gold", "doc_id", "ok", R, 17), "estimate")


STRATA_SQL = f"""WITH {_OK}, u AS (SELECT gold, ok, row_number() OVER (PARTITION BY gold ORDER BY doc_id) - 1 AS unit, count(*) OVER (PARTITION BY gold) AS n FROM g), s AS (SELECT gold, any_value(n) AS n FROM u GROUP BY gold),
d AS (SELECT replicate, gold, CAST(floor({_U("'17|' || replicate || '|' || gold || '|' || draw")} * n) AS BIGINT) AS unit FROM (SELECT unnest(range({R})) AS replicate), (SELECT gold, n, unnest(range(n)) AS draw FROM s))
SELECT CAST(replicate AS INT) AS replicate, round(avg(ok), 6) AS estimate FROM d JOIN u USING (gold, unit) GROUP BY replicate"""


def paired_difference(spark, sf_dir):
    rows = gold(spark, sf_dir).select("source", (F.col("gold") == "SUPPORTED").cast("int").alias("g"), (F.col("pred") == "SUPPORTED").cast("int").alias("a"), (F.element_at("probs", 1) >= 0.55).cast("int").alias("b"))
    return nine(resample.paired_f1(rows, "source", "g", "a", "b", R, 19), "difference")


PAIRED_SQL = f"""WITH g AS (SELECT source, CAST(gold = 'SUPPORTED' AS INT) AS g, CAST(pred = 'SUPPORTED' AS INT) AS a, CAST(p1 >= 0.55 AS INT) AS b FROM ({GOLD_SQL})),
s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS unit, sum(g * a) AS ta, sum((1 - g) * a) AS fa, sum(g * (1 - a)) AS na, sum(g * b) AS tb, sum((1 - g) * b) AS fb, sum(g * (1 - b)) AS nb FROM g GROUP BY source), k AS (SELECT count(*) AS k FROM s),
d AS (SELECT replicate, CAST(floor({_U("'19|' || replicate || '|' || draw")} * k) AS BIGINT) AS unit FROM (SELECT unnest(range({R})) AS replicate), (SELECT k, unnest(range(k)) AS draw FROM k))
SELECT CAST(replicate AS INT) AS replicate, round(2.0 * sum(ta) / (2 * sum(ta) + sum(fa) + sum(na)) - 2.0 * sum(tb) / (2 * sum(tb) + sum(fb) + sum(nb)), 6) AS difference FROM d JOIN s USING (unit) GROUP BY replicate"""


def bootstrap_clusters(spark, sf_dir):
    return nine(resample.bootstrap_clusters(_correct(spark, sf_dir), "source", "ok", R, 23), "estimate")


CLUSTERS_SQL = f"""WITH {_OK}, s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS unit, sum(ok) AS s, count(*) AS c FROM g GROUP BY source), k AS (SELECT count(*) AS k FROM s),
d AS (SELECT replicate, CAST(floor({_U("'23|' || replicate || '|' || draw")} * k) AS BIGINT) AS unit FROM (SELECT unnest(range({R})) AS replicate), (SELECT k, unnest(range(k)) AS draw FROM k))
SELECT CAST(replicate AS INT) AS replicate, round(CAST(sum(s.s) AS DOUBLE) / sum(s.c), 6) AS estimate FROM d JOIN s USING (unit) GROUP BY replicate"""


def _pairs(spark, sf_dir):
    return study.paired(study_rows(spark, sf_dir), "participant", "system", "score", ("click", "view"), ("role",))


_PAIR = f"s AS ({STUDY_SQL}), w AS (SELECT participant, role, avg(score) FILTER (system = 'click') AS click, avg(score) FILTER (system = 'view') AS view FROM s GROUP BY ALL), p AS (SELECT *, click - view AS difference FROM w WHERE click IS NOT NULL AND view IS NOT NULL)"


def paired_study(spark, sf_dir):
    return nine(study.paired_statistics(_pairs(spark, sf_dir), ("role",)), "mean", "sd", "se", "t", "dz")


STUDY_T_SQL = f"""WITH {_PAIR}, a AS (SELECT role, count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd FROM p GROUP BY role)
SELECT role, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(n), 6) AS se, round(mean / (sd / sqrt(n)), 6) AS t, n - 1 AS df, round(mean / sd, 6) AS dz FROM a"""


def paired_tests(spark, sf_dir):
    """With p-values and t intervals."""
    return nine(study.with_tests(study.paired_statistics(_pairs(spark, sf_dir))), "mean", "sd", "se", "t", "dz", "p_value", "low", "high")


#: The t distribution by the trapezoid rule over its angle: with t = sqrt(df) * tan(a) its density is cos(a) ** (df - 1).
TESTS_SQL = f"""WITH {_PAIR}, st AS (SELECT count(*) AS n, avg(difference) AS mean, stddev_samp(difference) AS sd, stddev_samp(difference) / sqrt(count(*)) AS se, count(*) - 1 AS df FROM p),
a AS (SELECT i, i / 200000.0::DOUBLE * pi() / 2 AS a, pow(greatest(cos(i / 200000.0::DOUBLE * pi() / 2), 0), df - 1) AS f FROM st, (SELECT unnest(range(200001)) AS i)),
c AS (SELECT i, a, sum(f) OVER (ORDER BY i) - f / 2 - 0.5 AS c FROM a), whole AS (SELECT max(c) AS c FROM c),
x AS (SELECT c.i, c.a, c.c / whole.c AS c, lead(c.a) OVER (ORDER BY c.i) AS a2, lead(c.c / whole.c) OVER (ORDER BY c.i) AS c2 FROM c, whole),
q AS (SELECT sqrt(df) * tan(a + (a2 - a) * (0.95 - c) / (c2 - c)) AS q FROM x, st WHERE c <= 0.95 AND c2 > 0.95),
t AS (SELECT 1 - (c + (c2 - c) * (atan(abs(mean / se) / sqrt(df)) - a) / (a2 - a)) AS p FROM x, st WHERE a <= atan(abs(mean / se) / sqrt(df)) AND a2 > atan(abs(mean / se) / sqrt(df)))
SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(se, 6) AS se, round(mean / se, 6) AS t, df, round(mean / sd, 6) AS dz, round(t.p, 6) AS p_value, round(mean - q * se, 6) AS low, round(mean + q * se, 6) AS high FROM st, q, t"""


def log_ratio(spark, sf_dir):
    """Geometric mean ratio of two systems."""
    rows = _pairs(spark, sf_dir).where("click > 0 AND view > 0").select(F.log(F.col("click") / F.col("view")).alias("difference"))
    return study.paired_statistics(rows).select("n", F.round(F.exp("mean"), 6).alias("ratio"), F.round("t", 6).alias("t"))


LOG_SQL = f"WITH {_PAIR}, l AS (SELECT ln(click / view) AS d FROM p WHERE click > 0 AND view > 0) SELECT count(*) AS n, round(exp(avg(d)), 6) AS ratio, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t FROM l"


def study_anova(spark, sf_dir):
    return nine(study.anova(_pairs(spark, sf_dir), "role", "difference"), "ss_between", "ss_within", "f")


ANOVA_SQL = f"""WITH {_PAIR}, m AS (SELECT avg(difference) AS gm FROM p), r AS (SELECT role, count(*) AS n, avg(difference) AS m FROM p GROUP BY role),
b AS (SELECT sum(n * (m - gm) * (m - gm)) AS ssb, count(*) - 1 AS d1 FROM r, m), within AS (SELECT sum((difference - m) * (difference - m)) AS ssw, count(*) - (SELECT count(*) FROM r) AS d2 FROM p JOIN r USING (role))
SELECT round(ssb, 6) AS ss_between, round(ssw, 6) AS ss_within, d1 AS df_between, d2 AS df_within, round((ssb / d1) / (ssw / d2), 6) AS f FROM b, within"""


def study_reliability(spark, sf_dir):
    return nine(study.reliability(_pairs(spark, sf_dir), "participant", "click", "view"), "icc_single", "icc_average", "pearson", "mean_abs_difference")


ICC_SQL = f"""WITH {_PAIR}, l AS (SELECT participant, click AS x, 1 AS k FROM p UNION ALL SELECT participant, view, 2 FROM p), g AS (SELECT avg(x) AS gm, count(*) / 2 AS n FROM l),
t AS (SELECT participant, avg(x) AS m FROM l GROUP BY 1), c AS (SELECT k, avg(x) AS m FROM l GROUP BY 1),
r AS (SELECT 2 * sum((m - gm) * (m - gm)) / (any_value(n) - 1) AS msr FROM t, g), q AS (SELECT any_value(n) * sum((m - gm) * (m - gm)) AS msc FROM c, g),
e AS (SELECT sum(pow(x - t.m - c.m + gm, 2)) / (any_value(n) - 1) AS mse FROM l JOIN t USING (participant) JOIN c USING (k), g)
SELECT (SELECT count(*) FROM p) AS n, round((msr - mse) / (msr + mse + 2 * (msc - mse) / n), 6) AS icc_single, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc_average,
  round((SELECT corr(click, view) FROM p), 6) AS pearson, round((SELECT avg(abs(click - view)) FROM p), 6) AS mean_abs_difference FROM r, q, e, g"""


def study_summary(spark, sf_dir):
    return nine(study.describe(study_rows(spark, sf_dir), "score", "participant", ("system", "role")), "mean", "geometric_mean", "median", "q1", "q3", "least", "most")


SUMMARY_SQL = f"""WITH s AS ({STUDY_SQL}) SELECT system, role, count(score) AS n, count(DISTINCT participant) AS n_keys, round(avg(score), 6) AS mean, round(exp(avg(ln(score)) FILTER (score > 0)), 6) AS geometric_mean, round(quantile_cont(score, 0.5), 6) AS median,
  round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.75), 6) AS q3, round(min(score), 6) AS least, round(max(score), 6) AS most FROM s GROUP BY ALL"""


def holm(spark, sf_dir):
    tests = study_rows(spark, sf_dir).groupBy("role", "system").agg((F.count("*") % 97 / 500).alias("p")).select(F.concat_ws("-", "role", "system").alias("name"), "p")
    return nine(study.holm(tests), "p", "adjusted")


HOLM_SQL = f"""WITH s AS ({STUDY_SQL}), t AS (SELECT role || '-' || system AS name, count(*) % 97 / 500.0 AS p FROM s GROUP BY role, system), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM t)
SELECT name, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(max(least(1, p * (m - i + 1))) OVER (ORDER BY i) AS DOUBLE), 6) AS adjusted FROM r"""


def preference(spark, sf_dir):
    """Exact binomial p-value."""
    return nine(study.preference(_pairs(spark, sf_dir), "click", "view"), "p_value")


PREFERENCE_SQL = f"""WITH {_PAIR}, k AS (SELECT count(*) FILTER (click > view) AS k, count(*) FILTER (click <> view) AS n FROM p),
l AS (SELECT k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5) AS l FROM (SELECT k, n, unnest(range(n + 1)) AS i FROM k)), a AS (SELECT l AS here FROM l WHERE i = k)
SELECT k, n, round(least(1.0, sum(exp(l)) FILTER (l <= here + 1e-7)), 6) AS p_value FROM l, a GROUP BY k, n"""


def study_inputs(spark, sf_dir):
    """Durations, totals, weighted ratings and numbers out of task logs, by system."""
    e = table(spark, sf_dir, "events")
    k = study.number(F.get_json_object("props", "$.k"))
    raw = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    scores = [k, F.when(F.col("event_id") % 7 > 0, F.col("value")), F.col("user_id").cast("double")]
    weights = [(F.col("event_id") % 4).cast("double"), (F.col("user_id") % 2).cast("double"), F.lit(0.0)]
    rows = e.select("event_type", study.duration(raw, F.col("ts"), F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 1000).cast("long"))).alias("seconds"), study.row_total(F.when(F.col("user_id") % 5 == 0, "y"), scores).alias("total"), study.weighted_rating([F.col("value"), k, k], weights).alias("rating"), study.number(F.col("event_type")).alias("none"))
    out = rows.groupBy("event_type").agg(*(f(c).alias(f"{name}_{c}") for c in ("seconds", "total", "rating") for name, f in (("n", F.count), ("mean", F.avg))), F.count("none").alias("n_none"))
    return nine(out, "mean_seconds", "mean_total", "mean_rating")


INPUTS_SQL = """WITH x AS (SELECT event_type, event_id, user_id, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 3 = 0 THEN value ELSE event_id / 1000.0::DOUBLE END AS seconds FROM events),
y AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN NULL ELSE k + CASE WHEN event_id % 7 > 0 THEN value END + user_id END AS total, (value * (event_id % 4) + k * (user_id % 2)) / nullif(event_id % 4 + user_id % 2, 0) AS rating FROM x)
SELECT event_type, count(seconds) AS n_seconds, round(avg(seconds), 6) AS mean_seconds, count(total) AS n_total, round(avg(total), 6) AS mean_total, count(rating) AS n_rating, round(avg(rating), 6) AS mean_rating, count(TRY_CAST(event_type AS DOUBLE)) AS n_none FROM y GROUP BY event_type"""


_H = lambda seed: f"sha256('{seed}|' || doc_id)"


def stratified_sample(spark, sf_dir):
    return splits.fixed_per_stratum(_correct(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 4, 31)


SAMPLE_SQL = f"WITH {_OK} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_H(31)}, doc_id) AS rn FROM g) WHERE rn <= 4"


def split_positions(spark, sf_dir):
    return splits.split_by_position(_correct(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", 37)


_EVEN = lambda x: f"round_even({x}, 0)"
SPLIT_SQL = f"""WITH {_OK}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H(37)}, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM g)
SELECT doc_id, lang, CASE WHEN i <= greatest(1, {_EVEN('n * 0.2::DOUBLE')}) THEN 'test' WHEN i <= greatest(1, {_EVEN('n * 0.2::DOUBLE')}) + greatest(1, {_EVEN('n * 0.1::DOUBLE')}) THEN 'dev' ELSE 'train' END AS split FROM r"""


def allocation(spark, sf_dir):
    return splits.root_allocation(_correct(spark, sf_dir).groupBy("source").agg(F.count("*").alias("size")), "source", "size", 103)


ALLOCATION_SQL = f"""WITH {_OK}, c AS (SELECT source, count(*) AS size FROM g GROUP BY source), s AS (SELECT *, 103 * sqrt(size) / sum(sqrt(size)) OVER () AS share FROM c), f AS (SELECT *, floor(share) AS fl FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY share - fl DESC, source) AS place, 103 - sum(fl) OVER () AS spare FROM f)
SELECT source, size, CAST(least(fl + CASE WHEN place <= spare THEN 1 ELSE 0 END, size) AS BIGINT) AS allocated FROM p"""


def folds(spark, sf_dir):
    """Folds by source with even labels."""
    return splits.group_folds(gold(spark, sf_dir).select("doc_id", "source", "gold"), "source", "gold", LABELS, 5)


#: A step a source, largest first; ``h`` holds five folds of four counts. All sources are units of their own here.
_GAIN = "round(list_sum([pow((h[j + 1] + CASE WHEN j // 4 = f THEN c[j % 4 + 1] ELSE 0 END) / t[j % 4 + 1], 2) FOR j IN range(20)]), 9)"
FOLDS_SQL = f"""WITH RECURSIVE g AS ({GOLD_SQL}), n AS (SELECT source, [{', '.join(f"count(*) FILTER (gold = '{x}')::DOUBLE" for x in LABELS)}] AS c, count(*) AS s FROM g GROUP BY source),
u AS (SELECT source, c, row_number() OVER (ORDER BY s DESC, source) AS rk FROM n), w AS (SELECT [{', '.join(f"greatest(count(*) FILTER (gold = '{x}'), 1)::DOUBLE" for x in LABELS)}] AS t FROM g),
r AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([0 FOR i IN range(20)] AS DOUBLE[]) AS h, '' AS source, CAST(-1 AS BIGINT) AS fold
UNION ALL SELECT rk, [h[j + 1] + CASE WHEN j // 4 = b THEN c[j % 4 + 1] ELSE 0 END FOR j IN range(20)], source, b FROM (SELECT u.rk, u.source, c, h, list_sort([{{'s': {_GAIN}, 'n': list_sum(h[f * 4 + 1:f * 4 + 4]), 'f': f}} FOR f IN range(5)])[1].f AS b FROM r JOIN u ON u.rk = r.rk + 1, w))
SELECT doc_id, g.source, gold, CAST(fold AS INT) AS fold FROM g JOIN r ON r.source = g.source"""


def balanced_trial(spark, sf_dir):
    g = _correct(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("ok") == 1).alias("yes"), F.count_if(F.col("ok") == 0).alias("no"))
    return splits.balanced_split(g, "source", ("yes", "no"), 50, 0.3, 41).select("trial", F.round("error", 6).alias("error"), F.array_join("chosen", ",").alias("chosen"))


BALANCED_SQL = f"""WITH {_OK}, c AS (SELECT source, count(*) FILTER (ok = 1) AS yes, count(*) FILTER (ok = 0) AS no FROM g GROUP BY source), t AS (SELECT unnest(range(50)) AS trial),
o AS (SELECT trial, source, yes, no, row_number() OVER (PARTITION BY trial ORDER BY sha256('41|' || trial || '|' || source), source) AS place, count(*) OVER (PARTITION BY trial) AS n FROM c, t),
s AS (SELECT trial, sum(yes) AS ay, sum(no) AS an, sum(yes) FILTER (place <= ceil(n * 0.3)) AS iy, sum(no) FILTER (place <= ceil(n * 0.3)) AS ino, list_sort(list(source) FILTER (place <= ceil(n * 0.3))) AS chosen FROM o GROUP BY trial),
e AS (SELECT *, round(abs(iy / (iy + ino) - ay / (ay + an)) + abs(ino / (iy + ino) - an / (ay + an)) + CASE WHEN iy = 0 THEN 1 ELSE 0 END + CASE WHEN ino = 0 THEN 1 ELSE 0 END, 12) AS error FROM s)
SELECT trial, round(error, 6) AS error, array_to_string(chosen, ',') AS chosen FROM e ORDER BY e.error, trial LIMIT 1"""


def shuffled(spark, sf_dir):
    return splits.derangement(_correct(spark, sf_dir).select("doc_id", "lang"), "doc_id", "doc_id", 43, "lang")


SHUFFLED_SQL = f"""WITH {_OK} SELECT doc_id, lang, coalesce(lead(doc_id) OVER (PARTITION BY lang ORDER BY {_H(43)}, doc_id), first_value(doc_id) OVER (PARTITION BY lang ORDER BY {_H(43)}, doc_id)) AS next_doc_id FROM g"""


def prompt_batches(spark, sf_dir):
    return splits.batches(_correct(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"], 12)


BATCH_SQL = f"WITH {_OK} SELECT doc_id, source, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12 AS INT) AS batch FROM g"

QUERIES = {
    "kappa": kappa, "rating_table": rating_table, "adjudication": adjudication, "bootstrap_items": bootstrap_items, "bootstrap_interval": bootstrap_interval, "bootstrap_cells": bootstrap_cells, "bootstrap_cells_by_source": bootstrap_cells_by_source, "bootstrap_values": bootstrap_values, "bootstrap_two_stage": bootstrap_two_stage,
    "bootstrap_strata": bootstrap_strata, "paired_difference": paired_difference, "bootstrap_clusters": bootstrap_clusters, "paired_study": paired_study, "paired_tests": paired_tests, "study_inputs": study_inputs, "log_ratio": log_ratio,
    "study_anova": study_anova, "study_reliability": study_reliability, "study_summary": study_summary, "holm": holm, "preference": preference, "stratified_sample": stratified_sample, "split_positions": split_positions,
    "allocation": allocation, "folds": folds, "balanced_trial": balanced_trial, "shuffled": shuffled, "prompt_batches": prompt_batches,
}
ORACLES = {
    "kappa": KAPPA_SQL, "rating_table": RATING_SQL, "adjudication": ADJUDICATION_SQL, "bootstrap_items": ITEMS_SQL, "bootstrap_clusters": CLUSTERS_SQL, "folds": FOLDS_SQL, "paired_tests": TESTS_SQL, "preference": PREFERENCE_SQL, "study_inputs": INPUTS_SQL, "bootstrap_interval": INTERVAL_SQL, "bootstrap_cells": CELLS_SQL, "bootstrap_cells_by_source": CELLS_SOURCE_SQL, "bootstrap_two_stage": TWO_STAGE_SQL,
    "bootstrap_strata": STRATA_SQL, "paired_difference": PAIRED_SQL, "paired_study": STUDY_T_SQL, "log_ratio": LOG_SQL, "study_anova": ANOVA_SQL, "study_reliability": ICC_SQL, "study_summary": SUMMARY_SQL,
    "holm": HOLM_SQL, "stratified_sample": SAMPLE_SQL, "split_positions": SPLIT_SQL, "allocation": ALLOCATION_SQL, "balanced_trial": BALANCED_SQL, "shuffled": SHUFFLED_SQL, "prompt_batches": BATCH_SQL,
}
