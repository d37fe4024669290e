"""Evaluation queries: gold labels of documents against deterministic predictions and probability vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators import calibration, decide, metrics
from loamwork.plans.bindings import GOLD_SQL, LABEL_LIST_SQL, LABELS, gold

_G = f"WITH g AS ({GOLD_SQL}), d AS (SELECT unnest({LABEL_LIST_SQL}) AS label)"
_V = f"""WITH g AS ({GOLD_SQL}), n AS (SELECT *, [p1, p2, p3, p4] AS p, greatest(p1, p2, p3, p4) AS conf,
  CASE WHEN p1 >= p2 AND p1 >= p3 AND p1 >= p4 THEN 1 WHEN p2 >= p3 AND p2 >= p4 THEN 2 WHEN p3 >= p4 THEN 3 ELSE 4 END AS top,
  list_position({LABEL_LIST_SQL}, gold) AS gi FROM g), s AS (SELECT *, CAST(top = gi AS INT) AS ok, p[gi] AS pg FROM n)"""


def nine(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


def macro_f1(spark, sf_dir):
    return nine(metrics.macro(gold(spark, sf_dir), "gold", "pred", LABELS), "macro_f1", "weighted_f1", "accuracy")


_CLASS = """, c AS (SELECT label, (SELECT count(*) FROM g WHERE gold = label AND pred = label) AS tp,
  (SELECT count(*) FROM g WHERE pred = label) AS np, (SELECT count(*) FROM g WHERE gold = label) AS ns FROM d)"""
MACRO_SQL = f"""{_G}{_CLASS}, f AS (SELECT *, coalesce(2.0 * tp / nullif(np + ns, 0), 0) AS f1 FROM c)
SELECT CAST(sum(ns) AS BIGINT) AS n, round(sum(f1) / 4, 6) AS macro_f1, round(sum(f1 * ns) / sum(ns), 6) AS weighted_f1, round(1.0 * sum(tp) / sum(ns), 6) AS accuracy FROM f"""


def per_class(spark, sf_dir):
    return nine(metrics.per_class(gold(spark, sf_dir), "gold", "pred", LABELS), "precision", "recall", "f1")


PER_CLASS_SQL = f"""{_G}{_CLASS} SELECT label, tp, np AS n_pred, ns AS support, round(coalesce(1.0 * tp / nullif(np, 0), 0), 6) AS precision,
  round(coalesce(1.0 * tp / nullif(ns, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(np + ns, 0), 0), 6) AS f1 FROM c"""


def macro_by_source(spark, sf_dir):
    return nine(metrics.macro(gold(spark, sf_dir), "gold", "pred", LABELS, ("source",)), "macro_f1", "weighted_f1", "accuracy")


BY_SOURCE_SQL = f"""{_G}, c AS (SELECT s.source, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS np, count(*) FILTER (gold = label) AS ns
  FROM d, (SELECT DISTINCT source FROM g) s JOIN g USING (source) GROUP BY s.source, label), f AS (SELECT *, coalesce(2.0 * tp / nullif(np + ns, 0), 0) AS f1 FROM c)
SELECT source, CAST(sum(ns) AS BIGINT) AS n, round(sum(f1) / 4, 6) AS macro_f1, round(sum(f1 * ns) / sum(ns), 6) AS weighted_f1, round(1.0 * sum(tp) / sum(ns), 6) AS accuracy FROM f GROUP BY source"""


def confusion(spark, sf_dir):
    return metrics.confusion(gold(spark, sf_dir), "gold", "pred", LABELS)


CONFUSION_SQL = f"{_G} SELECT a.label AS gold, b.label AS pred, (SELECT count(*) FROM g WHERE gold = a.label AND pred = b.label) AS n FROM d a, d b"


def three_decisions(spark, sf_dir):
    rows = gold(spark, sf_dir).select(metrics.decision(F.col("gold")).alias("gold"), metrics.decision(F.col("pred")).alias("pred"))
    return nine(metrics.macro(rows, "gold", "pred", ("PRESENT", "ABSENT", "ABSTAIN")), "macro_f1", "weighted_f1", "accuracy")


_THREE = lambda c: f"CASE {c} WHEN 'SUPPORTED' THEN 'PRESENT' WHEN 'NOT_SUPPORTED' THEN 'ABSENT' ELSE 'ABSTAIN' END"
THREE_SQL = f"""WITH g AS (SELECT {_THREE('gold')} AS gold, {_THREE('pred')} AS pred FROM ({GOLD_SQL})), d AS (SELECT unnest(['PRESENT','ABSENT','ABSTAIN']) AS label){_CLASS},
f AS (SELECT *, coalesce(2.0 * tp / nullif(np + ns, 0), 0) AS f1 FROM c)
SELECT CAST(sum(ns) AS BIGINT) AS n, round(sum(f1) / 3, 6) AS macro_f1, round(sum(f1 * ns) / sum(ns), 6) AS weighted_f1, round(1.0 * sum(tp) / sum(ns), 6) AS accuracy FROM f"""


def abstention(spark, sf_dir):
    return metrics.abstention(gold(spark, sf_dir), "gold", "pred", ("lang",))


_AP = lambda c: f"{c} IN ('INSUFFICIENT_CONTEXT', 'ENTITY_OR_TYPE_ERROR')"
_SH = lambda of, where: f"round(avg(CAST({of} AS DOUBLE)) FILTER ({where}), 9)"
ABSTENTION_SQL = f"""{_G} SELECT lang, count(*) AS items, count(*) FILTER ({_AP('gold')}) AS gold_abstentions, {_SH('NOT ' + _AP('pred'), 'true')} AS coverage,
  {_SH('gold = pred', 'NOT ' + _AP('pred'))} AS covered_accuracy, {_SH("gold <> 'SUPPORTED'", "pred = 'SUPPORTED'")} AS admission_error, {_SH(_AP('pred'), _AP('gold'))} AS any_abstention_recall,
  {_SH("pred = 'SUPPORTED'", _AP('gold'))} AS false_present_rate, {_SH("pred = 'SUPPORTED'", "gold = 'SUPPORTED'")} AS supported_recall,
  {_SH("pred = 'INSUFFICIENT_CONTEXT'", "gold = 'INSUFFICIENT_CONTEXT'")} AS insufficient_correct_recall, {_SH(_AP('pred'), "gold = 'INSUFFICIENT_CONTEXT'")} AS insufficient_any_recall,
  {_SH("pred = 'ENTITY_OR_TYPE_ERROR'", "gold = 'ENTITY_OR_TYPE_ERROR'")} AS entity_correct_recall, {_SH(_AP('pred'), "gold = 'ENTITY_OR_TYPE_ERROR'")} AS entity_any_recall FROM g GROUP BY lang"""


def calibration_summary(spark, sf_dir):
    return nine(calibration.summary(gold(spark, sf_dir), "gold", "probs", LABELS), "log_loss", "brier", "calibration_error", "mean_confidence", "accuracy")


CALIBRATION_SQL = f"""{_V}, b AS (SELECT least(floor(conf * 15), 14) AS bin, count(*) AS n, sum(conf) AS c, sum(ok) AS r FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS items, round((SELECT avg(-ln(pg)) FROM s), 6) AS log_loss,
  round((SELECT avg(pow(p1 - CAST(gi = 1 AS INT), 2) + pow(p2 - CAST(gi = 2 AS INT), 2) + pow(p3 - CAST(gi = 3 AS INT), 2) + pow(p4 - CAST(gi = 4 AS INT), 2)) FROM s), 6) AS brier,
  round((SELECT sum(abs(r - c)) / sum(n) FROM b), 6) AS calibration_error, round((SELECT avg(conf) FROM s), 6) AS mean_confidence, round((SELECT avg(ok) FROM s), 6) AS accuracy"""


def calibration_bins(spark, sf_dir):
    return nine(calibration.bins(gold(spark, sf_dir), "gold", "probs", LABELS), "mean_confidence", "accuracy")


BINS_SQL = f"{_V} SELECT CAST(least(floor(conf * 15), 14) AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(ok), 6) AS accuracy FROM s GROUP BY 1"


def risk_coverage(spark, sf_dir):
    return nine(calibration.risk_coverage(gold(spark, sf_dir), "gold", "probs", LABELS, "doc_id"), "coverage", "accuracy", "risk", "least_confidence")


_RISK = f"""{_V}, o AS (SELECT ok, conf, row_number() OVER (ORDER BY conf DESC, doc_id) AS rk, count(*) OVER () AS n FROM s), r AS (SELECT *, sum(ok) OVER (ORDER BY rk) AS good FROM o),
k AS (SELECT point, CAST(ceil(n * point / 10.0 - 1e-12) AS BIGINT) AS keep FROM (SELECT unnest(range(1, 11)) AS point), (SELECT count(*) AS n FROM s)),
curve AS (SELECT CAST(point AS INT) AS point, 1.0 * rk / n AS coverage, CAST(good AS DOUBLE) / rk AS accuracy, 1 - CAST(good AS DOUBLE) / rk AS risk, conf AS least_confidence FROM r JOIN k ON floor(n * point / 10.0 + 1e-12) = rk)"""
RISK_SQL = f"{_RISK} SELECT point, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy, round(risk, 6) AS risk, round(least_confidence, 6) AS least_confidence FROM curve"


def risk_area(spark, sf_dir):
    return nine(calibration.area(calibration.risk_coverage(gold(spark, sf_dir), "gold", "probs", LABELS, "doc_id")), "area")


AREA_SQL = f"{_RISK} SELECT round(sum(x), 6) AS area FROM (SELECT (coverage - lag(coverage) OVER (ORDER BY coverage)) * (risk + lag(risk) OVER (ORDER BY coverage)) / 2 AS x FROM curve)"


def staged_decisions(spark, sf_dir):
    rows = gold(spark, sf_dir).select("gold", decide.staged(F.col("probs"), 0.10, 0.2, 0.5).alias("staged"), decide.judged(F.col("probs"), 0.7, 0.6).alias("judged"))
    return rows.groupBy("gold", "staged", "judged").count().withColumnRenamed("count", "n")


_SUP = "p1 / greatest(p1 + p2, 1e-12)"
STAGED_SQL = f"""{_G} SELECT gold, CASE WHEN p4 >= 0.10 THEN 'ENTITY_OR_TYPE_ERROR' WHEN p3 >= 0.2 THEN 'INSUFFICIENT_CONTEXT' WHEN {_SUP} >= 0.5 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS staged,
  CASE WHEN p1 + p2 < 0.7 THEN CASE WHEN p3 >= p4 THEN 'INSUFFICIENT_CONTEXT' ELSE 'ENTITY_OR_TYPE_ERROR' END WHEN {_SUP} >= 0.6 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS judged, count(*) AS n FROM g GROUP BY ALL"""


def rejector(spark, sf_dir):
    limits = {"SUPPORTED": 0.6, "NOT_SUPPORTED": 0.5, "INSUFFICIENT_CONTEXT": 0.4, "ENTITY_OR_TYPE_ERROR": 0.3}
    score = (F.col("n_chars") % 100) / 100.0
    return gold(spark, sf_dir).groupBy("gold", decide.rejected(F.col("probs"), score, limits).alias("decision")).count().withColumnRenamed("count", "n")


REJECTOR_SQL = f"""{_V}, x AS (SELECT gold, {LABEL_LIST_SQL}[top] AS best, (n_chars % 100) / 100.0 AS r FROM s)
SELECT gold, CASE WHEN r > CASE best WHEN 'SUPPORTED' THEN 0.6 WHEN 'NOT_SUPPORTED' THEN 0.5 WHEN 'INSUFFICIENT_CONTEXT' THEN 0.4 ELSE 0.3 END THEN 'INSUFFICIENT_CONTEXT' ELSE best END AS decision, count(*) AS n FROM x GROUP BY ALL"""


def schema_guard(spark, sf_dir):
    """Relations and types from language and source; unknown relations pass."""
    rows = gold(spark, sf_dir).select("doc_id", "probs", F.col("lang").alias("relation"), F.when(F.col("doc_id") % 2 == 0, "A").otherwise("B").alias("head_type"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("C").alias("tail_type"))
    signatures = spark.createDataFrame([("en", "A", "C"), ("en", "B", "C"), ("fr", "A", "A"), ("de", "B", "A")], "relation string, head_type string, tail_type string")
    out = decide.guarded(rows, signatures)
    return out.groupBy("relation", "signature_valid").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("probs", 4)), 6).alias("error_mass"))


GUARD_SQL = f"""{_G}, r AS (SELECT p4, lang AS relation, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END || CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'C' END AS t FROM g),
v AS (SELECT *, CASE relation WHEN 'en' THEN t IN ('AC', 'BC') WHEN 'fr' THEN t = 'AA' WHEN 'de' THEN t = 'BA' ELSE true END AS signature_valid FROM r)
SELECT relation, signature_valid, count(*) AS n, round(sum(CASE WHEN signature_valid THEN p4 ELSE 1.0 END), 6) AS error_mass FROM v GROUP BY ALL"""


def vector_features(spark, sf_dir):
    """Entropy, margin, judgeability, support, distances of experts, distinct votes."""
    rows = gold(spark, sf_dir).withColumn("other", V.tempered(F.col("probs"), 2.0))
    p, q = F.col("probs"), F.col("other")
    blend = V.blended([p, q], [0.25, 0.75])
    r6 = lambda c: F.round(c, 6)
    return rows.select(
        "doc_id", r6(V.entropy(p)).alias("entropy"), r6(V.margin(p)).alias("margin"), r6(V.judgeability(p)).alias("judgeability"), r6(V.support_given_judgeable(p)).alias("support"),
        r6(V.l1(p, q)).alias("distance"), F.size(F.array_distinct(F.array("gold", "pred", V.argmax(p, LABELS)))).alias("votes"), r6(F.get(blend, F.lit(0))).alias("blend"), r6(F.get(q, F.lit(1))).alias("tempered"),
    )


_Q = lambda i: f"sqrt(p{i}) / (sqrt(p1) + sqrt(p2) + sqrt(p3) + sqrt(p4))"
FEATURES_SQL = f"""{_V}, t AS (SELECT *, {_Q(1)} AS q1, {_Q(2)} AS q2, {_Q(3)} AS q3, {_Q(4)} AS q4 FROM s)
SELECT doc_id, round(-(p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3) + p4 * ln(p4)), 6) AS entropy, round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin, round(p1 + p2, 6) AS judgeability,
  round({_SUP}, 6) AS support, round(abs(p1 - q1) + abs(p2 - q2) + abs(p3 - q3) + abs(p4 - q4), 6) AS distance, CAST(len(list_distinct([gold, pred, {LABEL_LIST_SQL}[top]])) AS INT) AS votes,
  round(0.25 * p1 + 0.75 * q1, 6) AS blend, round(q2, 6) AS tempered FROM t"""


def threshold_search(spark, sf_dir):
    rows = gold(spark, sf_dir).select("lang", F.element_at("probs", 1).alias("score"), (F.col("gold") == "SUPPORTED").alias("positive"))
    return decide.threshold_search(rows, "score", "positive", [i / 20 for i in range(1, 20)], ("lang",), 5)


THRESHOLD_SQL = f"""{_G}, t AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS threshold), c AS (SELECT lang, threshold, count(*) FILTER (p1 >= threshold AND gold = 'SUPPORTED') AS tp,
  count(*) FILTER (p1 >= threshold AND gold <> 'SUPPORTED') AS fp, count(*) FILTER (gold = 'SUPPORTED' AND p1 < threshold) AS fn, count(*) FILTER (gold = 'SUPPORTED') AS pos, count(*) AS n FROM g, t GROUP BY ALL),
f AS (SELECT *, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 12) AS f1, round(coalesce(1.0 * tp / nullif(tp + fn, 0), 0), 12) AS recall, round(coalesce(1.0 * tp / nullif(tp + fp, 0), 0), 12) AS precision FROM c WHERE pos >= 5 AND n - pos >= 5)
SELECT lang, f1, recall, precision, threshold, tp, fp, fn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, recall DESC, precision DESC, threshold DESC) AS rn FROM f) WHERE rn = 1"""


TEMPERATURES = [0.5 + 0.05 * i for i in range(51)]
THRESHOLDS = [i / 20 for i in range(21)]


def grid_search(spark, sf_dir):
    """The temperature of the least loss, then all pairs of 21 thresholds on the tempered vectors."""
    rows = gold(spark, sf_dir)
    t = decide.best_temperature(rows, "gold", TEMPERATURES).first()["temperature"]
    scaled = rows.withColumn("probs", F.transform(V.tempered(F.col("probs"), t), lambda x: F.round(x, 9)))
    return decide.judged_grid_search(scaled, "gold", THRESHOLDS, THRESHOLDS).withColumn("temperature", F.lit(round(t, 6)))


GRID_SQL = f"""{_G}, ts AS (SELECT unnest({[round(t, 6) for t in TEMPERATURES]})::DOUBLE AS t), w AS (SELECT t, doc_id, gold, pow(p1, 1 / t) AS a, pow(p2, 1 / t) AS b, pow(p3, 1 / t) AS c, pow(p4, 1 / t) AS e FROM g, ts),
z AS (SELECT t, doc_id, gold, a / (a + b + c + e) AS p1, b / (a + b + c + e) AS p2, c / (a + b + c + e) AS p3, e / (a + b + c + e) AS p4 FROM w),
n AS (SELECT t, round(avg(-ln(CASE gold WHEN 'SUPPORTED' THEN p1 WHEN 'NOT_SUPPORTED' THEN p2 WHEN 'INSUFFICIENT_CONTEXT' THEN p3 ELSE p4 END)), 9) AS nll FROM z GROUP BY t),
h AS (SELECT t, doc_id, gold, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3, round(p4, 9) AS p4 FROM z WHERE t = (SELECT t FROM n ORDER BY nll, t LIMIT 1)), j AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS j), s AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS s),
k AS (SELECT t, j, s, gold, CASE WHEN p1 + p2 < j THEN CASE WHEN p3 >= p4 THEN 'INSUFFICIENT_CONTEXT' ELSE 'ENTITY_OR_TYPE_ERROR' END WHEN p1 / (p1 + p2) >= s THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS pred FROM h, j, s),
c AS (SELECT t, j, s, label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) + count(*) FILTER (pred = label) AS gp, count(*) FILTER (gold = label) AS ns FROM k, d GROUP BY ALL)
SELECT j AS judgeability, s AS support, round(sum(coalesce(2.0 * tp / nullif(gp, 0), 0)) / 4, 9) AS macro_f1, round(1.0 * sum(tp) / sum(ns), 9) AS accuracy, t AS temperature FROM c GROUP BY t, j, s"""


def training_weights(spark, sf_dir):
    """Source weights count ** -0.5 with mean 1 over rows, class weights sqrt(N / (C * n))."""
    rows = gold(spark, sf_dir)
    by_source = rows.groupBy("source").count().withColumn("raw", F.pow("count", F.lit(-0.5)))
    mean = by_source.agg(F.sum("count").alias("items"), F.sum(F.col("raw") * F.col("count")).alias("mass"))
    sources = by_source.join(F.broadcast(mean)).select(F.lit("source").alias("kind"), F.col("source").alias("name"), F.round(F.col("raw") * F.col("items") / F.col("mass"), 6).alias("weight"))
    by_class = rows.groupBy("gold").count()
    size = by_class.agg(F.sum("count").alias("items"), F.count("*").alias("classes"))
    classes = by_class.join(F.broadcast(size)).select(F.lit("class").alias("kind"), F.col("gold").alias("name"), F.round(F.sqrt(F.col("items") / (F.col("classes") * F.col("count"))), 6).alias("weight"))
    return sources.unionByName(classes)


WEIGHTS_SQL = f"""{_G}, s AS (SELECT source, count(*) AS c, pow(count(*), -0.5) AS raw FROM g GROUP BY source), k AS (SELECT gold, count(*) AS c FROM g GROUP BY gold)
SELECT 'source' AS kind, source AS name, round(raw * (SELECT sum(c) FROM s) / (SELECT sum(raw * c) FROM s), 6) AS weight FROM s
UNION ALL SELECT 'class', gold, round(sqrt((SELECT sum(c) FROM k) / ((SELECT count(*) FROM k) * c)), 6) FROM k"""


def set_scores(spark, sf_dir):
    g = gold(spark, sf_dir)
    return metrics.set_scores(g.where("gold = 'SUPPORTED'").select("doc_id", "lang"), g.where("pred = 'SUPPORTED'").select("doc_id", "lang"), ("doc_id", "lang"), "lang")


SET_SQL = f"""{_G}, x AS (SELECT lang, CAST(gold = 'SUPPORTED' AND pred = 'SUPPORTED' AS INT) AS tp, CAST(gold <> 'SUPPORTED' AND pred = 'SUPPORTED' AS INT) AS fp, CAST(gold = 'SUPPORTED' AND pred <> 'SUPPORTED' AS INT) AS fn FROM g WHERE gold = 'SUPPORTED' OR pred = 'SUPPORTED')
SELECT lang, CAST(grouping(lang) AS INT) AS in_all, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(1.0 * sum(tp) / (sum(tp) + sum(fp)), 9) AS precision,
  round(1.0 * sum(tp) / (sum(tp) + sum(fn)), 9) AS recall, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1 FROM x GROUP BY ROLLUP (lang)"""


def average_precision(spark, sf_dir):
    rows = gold(spark, sf_dir).select(F.element_at("probs", 1).alias("score"), (F.col("gold") == "SUPPORTED").alias("positive"))
    return nine(metrics.average_precision(rows, "score", "positive"), "average_precision")


AP_SQL = f"""{_G}, s AS (SELECT p1, sum(CAST(gold = 'SUPPORTED' AS INT)) AS p, count(*) AS n FROM g GROUP BY p1), r AS (SELECT p, sum(p) OVER (ORDER BY p1 DESC) AS rp, sum(n) OVER (ORDER BY p1 DESC) AS rn FROM s)
SELECT round(sum(1.0 * p * rp / rn) / sum(p), 6) AS average_precision FROM r"""

QUERIES = {
    "macro_f1": macro_f1, "per_class": per_class, "macro_by_source": macro_by_source, "confusion": confusion, "three_decisions": three_decisions, "abstention": abstention,
    "calibration_summary": calibration_summary, "calibration_bins": calibration_bins, "risk_coverage": risk_coverage, "risk_area": risk_area, "staged_decisions": staged_decisions,
    "rejector": rejector, "schema_guard": schema_guard, "vector_features": vector_features, "threshold_search": threshold_search, "grid_search": grid_search,
    "training_weights": training_weights, "set_scores": set_scores, "average_precision": average_precision,
}
ORACLES = {
    "macro_f1": MACRO_SQL, "per_class": PER_CLASS_SQL, "macro_by_source": BY_SOURCE_SQL, "confusion": CONFUSION_SQL, "three_decisions": THREE_SQL, "abstention": ABSTENTION_SQL,
    "calibration_summary": CALIBRATION_SQL, "calibration_bins": BINS_SQL, "risk_coverage": RISK_SQL, "risk_area": AREA_SQL, "staged_decisions": STAGED_SQL,
    "rejector": REJECTOR_SQL, "schema_guard": GUARD_SQL, "vector_features": FEATURES_SQL, "threshold_search": THRESHOLD_SQL, "grid_search": GRID_SQL,
    "training_weights": WEIGHTS_SQL, "set_scores": SET_SQL, "average_precision": AP_SQL,
}
