"""Queries over policies, selection scores, encoded paths, mentions, query texts and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.functions import vectors as V
from loamwork.operators import decide, learning, logistic, metrics, passages, paths, rules, splits
from loamwork.operators.extra_trees import extra_trees
from loamwork.plans.bindings import EDGES_SQL, GOLD_SQL, LABELS, edges, gold
from loamwork.plans.graph import _PATHS, _paths, rule_b1, B1_SQL
from loamwork.sources.staging import staged
from loamwork.sources.tables import table

_D = f"d AS (SELECT unnest({list(LABELS)}) AS label)"


# -- policies ---------------------------------------------------------------------------------------

def _scored(spark, sf_dir):
    """Three scores, a language model's label and a threshold of every labelled document."""
    p = lambda i: F.get("probs", F.lit(i))
    label = F.when(F.col("pred") == "SUPPORTED", "supported").when(F.col("pred") == "NOT_SUPPORTED", "unsupported").otherwise("plausible")
    return gold(spark, sf_dir).select("doc_id", (F.col("gold") == "SUPPORTED").alias("positive"), F.round(p(0), 6).alias("local"), F.round(p(1), 6).alias("heuristic"), F.round(p(2) + p(3), 6).alias("llm"), label.alias("label"), F.when(F.col("lang") == "en", 0.5).otherwise(0.4).alias("threshold"))


def policy_search(spark, sf_dir):
    return decide.policy_search(_scored(spark, sf_dir), "positive", "local", "llm", "heuristic", "label", "threshold")


_N = lambda parts: " || ',' || ".join(f"'{k}=' || {v}" for k, v in parts)
_FLAGS = "(SELECT unnest([false, true]) AS pl) pls"
_LIST = lambda values: f"unnest({[float(v) for v in values]})::DOUBLE"
_ACCEPT = "(label = 'supported' OR (pl AND label = 'plausible'))"
POLICIES_SQL = f"""WITH r AS (SELECT gold = 'SUPPORTED' AS g, round(p1, 6) AS x, round(p2, 6) AS h, round(p3 + p4, 6) AS m, CASE pred WHEN 'SUPPORTED' THEN 'supported' WHEN 'NOT_SUPPORTED' THEN 'unsupported' ELSE 'plausible' END AS label,
  CASE lang WHEN 'en' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS o FROM ({GOLD_SQL})),
e AS (SELECT 'local_only' AS family, {_N([('threshold', 't')])} AS parameters, g, x >= t AS yes FROM r, (SELECT {_LIST(decide.LOCAL_GRID)} AS t)
UNION ALL SELECT 'local_relation_thresholds', 'own', g, x >= o FROM r
UNION ALL SELECT 'relation_threshold_llm_rescue_veto', {_N([('rescue', 'rm'), ('plausible', 'pl'), ('veto', "coalesce(CAST(vm AS VARCHAR), 'none')")])}, g,
  (x >= o OR (x < o AND {_ACCEPT} AND o - x <= rm)) AND NOT coalesce(x >= o AND label = 'unsupported' AND x < o + vm, false)
  FROM r, (SELECT {_LIST(decide.RESCUE_MARGINS)} AS rm), {_FLAGS}, (SELECT NULL::DOUBLE AS vm UNION ALL SELECT {_LIST(decide.VETO_MARGINS)})
UNION ALL SELECT 'weighted_score', {_N([('local', 'a'), ('llm', 'b'), ('heuristic', 'c'), ('threshold', 't')])}, g, round(a * x + b * m + c * h, 9) >= t
  FROM r, (SELECT a, b, abs(round(1 - a - b, 1)) AS c FROM (SELECT {_LIST(decide.WEIGHTS)} AS a), (SELECT {_LIST(decide.WEIGHTS)} AS b) WHERE round(1 - a - b, 1) >= 0), (SELECT {_LIST(decide.WEIGHTED_GRID)} AS t)
UNION ALL SELECT 'protected_local_gate', {_N([('lower', 'lo'), ('upper', 'up'), ('plausible', 'pl')])}, g, x >= up OR (x >= lo AND {_ACCEPT})
  FROM r, (SELECT {_LIST(decide.LOWER_GRID)} AS lo), (SELECT {_LIST(decide.UPPER_GRID)} AS up), {_FLAGS} WHERE round(up - lo, 6) >= 0.1),
s AS (SELECT family, parameters, count(*) FILTER (g AND yes) AS tp, count(*) FILTER (NOT g AND yes) AS fp, count(*) FILTER (g AND NOT yes) AS fn FROM e GROUP BY ALL)
SELECT *, round(coalesce(1.0 * tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(1.0 * tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM s"""


def best_policy(spark, sf_dir):
    return decide.best_policy(policy_search(spark, sf_dir))


BEST_POLICY_SQL = f"SELECT family, parameters, tp, fp, fn, precision, recall, f1 FROM ({POLICIES_SQL}) ORDER BY f1 DESC, recall DESC, precision DESC, family, parameters LIMIT 1"


def selection_score(spark, sf_dir):
    """Scores in all and over sources that no nation's suppliers name; half of the sources are known."""
    rows = gold(spark, sf_dir)
    known = rows.groupBy("source").agg(F.count("*").alias("n")).where("n % 2 = 0").select("source")
    return metrics.selection_score(rows, "gold", "pred", "source", known, LABELS)


_THREE = lambda c: f"CASE {c} WHEN 'SUPPORTED' THEN 'PRESENT' WHEN 'NOT_SUPPORTED' THEN 'ABSENT' ELSE 'ABSTAIN' END"
_F1 = lambda rows, labels: f"(SELECT sum(coalesce(2.0 * tp / nullif(b, 0), 0)) / {len(labels)} FROM (SELECT label, count(*) FILTER (g = label AND p = label) AS tp, count(*) FILTER (g = label) + count(*) FILTER (p = label) AS b FROM {rows}, (SELECT unnest({list(labels)}) AS label) GROUP BY label))"
SELECTION_SQL = f"""WITH r AS ({GOLD_SQL}), k AS (SELECT source FROM r GROUP BY source HAVING count(*) % 2 = 0), f AS (SELECT gold AS g, pred AS p FROM r), t AS (SELECT {_THREE('gold')} AS g, {_THREE('pred')} AS p FROM r),
u AS (SELECT {_THREE('gold')} AS g, {_THREE('pred')} AS p FROM r WHERE source NOT IN (SELECT source FROM k)),
s AS (SELECT {_F1('f', LABELS)} AS f, {_F1('t', ('PRESENT', 'ABSENT', 'ABSTAIN'))} AS t, CASE WHEN (SELECT count(*) FROM u) > 0 THEN {_F1('u', ('PRESENT', 'ABSENT', 'ABSTAIN'))} END AS u, (SELECT count(*) FROM u) AS n)
SELECT round(f, 9) AS four_class, round(t, 9) AS three_decision, round(coalesce(u, t), 9) AS unseen_three_decision, round(coalesce(2 * t * coalesce(u, t) / nullif(t + coalesce(u, t), 0), 0), 9) AS harmonic, n AS unseen_items FROM s"""


# -- rules and paths ----------------------------------------------------------------------------------

_B1_RELATIONS = ("entersmeridian", "correspondsToOrgan", "affectsOrgan")


def rule_sets(spark, sf_dir):
    return rules.propagated(edges(spark, sf_dir, (*_B1_RELATIONS, "containsIngredient", "treats", "treatedByRecipe")))


RULE_SETS_SQL = EDGES_SQL + """, x AS (SELECT DISTINCT relation, head, tail FROM e)
SELECT DISTINCT 'B1' AS rule, a.head AS head, c.head AS tail FROM x a JOIN x b ON a.tail = b.head JOIN x c ON c.tail = b.tail WHERE a.relation = 'entersmeridian' AND b.relation = 'correspondsToOrgan' AND c.relation = 'affectsOrgan'
UNION SELECT 'B2', a.head, b.tail FROM x a JOIN x b ON a.tail = b.head WHERE a.relation = 'containsIngredient' AND b.relation = 'treats'
UNION SELECT 'B3', b.tail, a.head FROM x a JOIN x b ON a.tail = b.head WHERE a.relation = 'treatedByRecipe' AND b.relation = 'containsIngredient'"""


def flattened_candidates(spark, sf_dir):
    flat = rules.flattened(rule_b1(spark, sf_dir), edges(spark, sf_dir, _B1_RELATIONS), _B1_RELATIONS)
    return flat.select("head", "tail", "edge1_tail", "edge1_authority_rank", "edge2_tail", "edge3_head", "path_authority", "path_books")


FLATTENED_SQL = f"""WITH f AS ({B1_SQL}), e AS (SELECT * FROM ({EDGES_SQL} SELECT *, row_number() OVER (PARTITION BY relation, edge_id ORDER BY authority_rank DESC, books DESC, support DESC, confidence DESC, head DESC, tail DESC) AS rn FROM e) WHERE rn = 1)
SELECT f.head, f.tail, a.tail AS edge1_tail, a.authority_rank AS edge1_authority_rank, b.tail AS edge2_tail, c.head AS edge3_head, least(a.authority_rank, b.authority_rank, c.authority_rank) AS path_authority,
  array_to_string([a.books::VARCHAR] || CASE WHEN b.books <> a.books THEN [b.books::VARCHAR] ELSE []::VARCHAR[] END || CASE WHEN c.books <> a.books AND c.books <> b.books THEN [c.books::VARCHAR] ELSE []::VARCHAR[] END, ';') AS path_books
FROM f JOIN e a ON a.relation = 'entersmeridian' AND a.edge_id = f.path[1] JOIN e b ON b.relation = 'correspondsToOrgan' AND b.edge_id = f.path[2] JOIN e c ON c.relation = 'affectsOrgan' AND c.edge_id = f.path[3]"""

_TOKENS = [("edge", t, i) for i, t in enumerate(("inRegion", "inverse::inRegion", "inverse::sells", "mentioned_in", "mentions", "sells"), 1)] + [("type", t, i) for i, t in enumerate("NPR_", 1)]


def encoded_paths(spark, sf_dir):
    """Fixed-size arrays of each item's paths, as texts; a node's type is its first letter."""
    tokens = spark.createDataFrame(_TOKENS, "kind string, token string, id int")
    out = paths.encoded(_paths(spark, sf_dir), tokens, lambda node: F.substring(node, 1, 1), 4)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("item_id", joined("edge_ids").alias("edge_ids"), joined("type_ids").alias("type_ids"), F.size(F.filter("hop_mask", lambda x: x)).alias("hops"), F.size(F.filter("path_mask", lambda x: x)).alias("paths"),
        F.round(F.aggregate("path_features", F.lit(0.0), lambda a, x: a + x), 6).alias("path_features"), *(F.round(F.get("graph_features", F.lit(i)), 6).alias(f"graph{i + 1}") for i in range(3)))


_ID = lambda kind, x: "CASE " + x + " " + " ".join(f"WHEN '{t}' THEN '{i}'" for k, t, i in _TOKENS if k == kind) + " ELSE '0' END"
ENCODED_SQL = _PATHS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY passage_conditioned DESC, semantic_edges DESC, hops, array_to_string(edges, '|'), array_to_string(nodes, '|')) AS nth FROM allp),
k AS (SELECT item_id, nth, hops, list_resize([{_ID('edge', 'x')} FOR x IN edges], 3, '0') AS es, list_resize([{_ID('type', 'substr(x, 1, 1)')} FOR x IN nodes], 4, '0') AS ts, CAST(passage_conditioned AS INT) + semantic_edges / 3.0 + hops / 3.0 AS f FROM o WHERE nth <= 4),
a AS (SELECT item_id, array_to_string(list_resize(flatten(list(es ORDER BY nth)), 12, '0'), ',') AS edge_ids, array_to_string(list_resize(flatten(list(ts ORDER BY nth)), 16, '0'), ',') AS type_ids, CAST(sum(hops) AS INT) AS hops, CAST(count(*) AS INT) AS paths, round(sum(f), 6) AS path_features FROM k GROUP BY item_id),
c AS (SELECT item_id, count(*) AS n, count(*) FILTER (passage_conditioned) AS p FROM allp GROUP BY item_id)
SELECT a.*, round(ln(1 + n) / ln(33), 6) AS graph1, round(p / n, 6) AS graph2, round((n - p) / n, 6) AS graph3 FROM a JOIN c USING (item_id)"""


# -- mentions and texts -------------------------------------------------------------------------------

def span_flags(spark, sf_dir):
    """Flags of a part's type within its name, with suppliers' and nations' names as titles."""
    titles = passages.source_titles(table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(". "), "n_name", F.lit(".pdf")).alias("name")), ("name",))
    ending = F.element_at(F.array(*map(F.lit, ("汤", "经", "", "方"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    quote = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("《"), F.lower("p_brand"), ending, F.lit("》"))).otherwise(F.concat(F.lower("p_brand"), ending))
    nation = F.when(F.col("p_partkey") % 5 == 0, F.lit("FRANCE")).otherwise(F.concat(F.lower("p_brand"), ending))
    rows = table(spark, sf_dir, "part").select("p_partkey", nation.alias("head_text"), F.concat("p_name", F.lit(" "), quote, F.lit("。"), nation).alias("passage"))
    out = passages.span_flags(rows, titles, "head", "passage")
    return out.drop("head_text", "passage").withColumn("head_visible", F.round("head_visible", 6))


SPAN_FLAGS_SQL = r"""WITH t AS (SELECT DISTINCT lower(regexp_replace(n_name, '[^\p{L}\p{N}]+', '', 'g')) AS title FROM nation),
b AS (SELECT p_partkey, p_name, lower(p_brand) || ['汤', '经', '', '方'][p_partkey % 4 + 1] AS own FROM part),
r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'FRANCE' ELSE own END AS head, p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '《' || own || '》' ELSE own END || '。' || CASE WHEN p_partkey % 5 = 0 THEN 'FRANCE' ELSE own END AS passage FROM b),
s AS (SELECT *, lower(regexp_replace(head, '[^\p{L}\p{N}]+', '', 'g')) AS s, lower(regexp_replace(passage, '[^\p{L}\p{N}]+', '', 'g')) AS np FROM r)
SELECT p_partkey, CAST(length(s) <= 2 AS INT) AS head_short, round(1.0 * length(regexp_replace(head, '[^\p{L}\p{N}]', '', 'g')) / length(head), 6) AS head_visible, CAST((length(np) - length(replace(np, s, ''))) / length(s) AS INT) AS head_occurrences,
  CAST(s IN (SELECT title FROM t) AS INT) AS head_known_title, CAST(contains(passage, '《' || head || '》') AS INT) AS head_quoted, CAST(right(s, 1) IN ('方', '汤', '丸', '散', '羹', '粥', '酒', '饮') AS INT) AS head_recipe_ending, CAST(right(s, 1) = '经' AS INT) AS head_meridian_ending FROM s"""


def query_texts(spark, sf_dir):
    """Query and structured texts of documents, and what interventions leave of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", F.array("lang", "source").alias("paths"))
    shuffled = splits.derangement(d, "doc_id", "text", 47, "lang")
    out = None
    for kind in ("none", "shuffled", "empty", "no_paths"):
        rows = shuffled.withColumns(X.intervened(kind, "text", "paths", "next_text"))
        fields = {"head_type": F.lit("Source"), "head_text": F.col("source"), "relation": F.lit("writtenIn"), "tail_type": F.lit("Language"), "tail_text": F.col("lang")}
        text = X.packed_text(X.structured_text(fields, F.col("text")), F.col("paths"))
        part = rows.select("doc_id", F.lit(kind).alias("kind"), F.md5(text).alias("digest"), F.length(X.query_text(fields)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


_QT = "'Source ' || source || ' writtenIn   Language ' || lang"
QUERY_TEXTS_SQL = f"""WITH n AS (SELECT doc_id, lang, source, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM documents WINDOW w AS (PARTITION BY lang ORDER BY sha256('47|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT *, unnest(['none', 'shuffled', 'empty', 'no_paths']) AS kind FROM n)
SELECT doc_id, kind, md5('[QUERY] ' || {_QT} || ' [HEAD] ' || source || ' [RELATION] writtenIn [TAIL] ' || lang || ' [PASSAGE] ' || CASE kind WHEN 'shuffled' THEN next_text WHEN 'empty' THEN '' ELSE text END || ' [GRAPH] ' || CASE kind WHEN 'no_paths' THEN '' ELSE lang || ' ' || source END || ' [/GRAPH]') AS digest,
  CAST(length({_QT}) AS INT) AS n FROM k"""


# -- models -------------------------------------------------------------------------------------------

def _framed(spark, sf_dir):
    rows = gold(spark, sf_dir).select("doc_id", "source", "lang", "pred", F.col("n_chars").cast("double").alias("chars"), V.margin(F.col("probs")).alias("margin"), "gold")
    rows = learning.with_frequent(rows, rows, ["lang", "pred"])
    return learning.fit_frame(rows, ["lang", "pred"], ["chars", "margin"]).transform(rows).select("doc_id", "source", "gold", "features")


def forest_probabilities(spark, sf_dir):
    """Rows only: mean probabilities of forests of five seeds; trees are random."""
    rows = _framed(spark, sf_dir)
    out = learning.forest_ensemble(rows, rows, "gold", LABELS, trees=10, depth=4)
    return out.select("doc_id", *(F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i + 1}") for i in range(4)))


def extra_trees_probabilities(spark, sf_dir):
    """Mean class shares of extremely randomised trees of two seeds; no SQL, as cuts come from a generator's stream."""
    rows = staged(_framed(spark, sf_dir).withColumn("features", vector_to_array("features")), "tree-rows")
    out = extra_trees(rows, rows, "gold", LABELS, seeds=(11, 23), trees=40, depth=6)
    return out.select("doc_id", *(F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i + 1}") for i in range(4)))


def logistic_probabilities(spark, sf_dir):
    """Balanced one-against-rest logistic regressions by a Newton method; no SQL, as they are fitted by iteration."""
    dense = _framed(spark, sf_dir).withColumn("x", vector_to_array("features"))
    rows = staged(dense.select("doc_id", "gold", F.sequence(F.lit(0), F.size("x") - 1).alias("at"), "x"), "logistic-frame")
    out = logistic.probabilities(rows, logistic.fitted(rows, "gold", LABELS))
    return out.select("doc_id", *(F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i + 1}") for i in range(4)))


def penalty_selection(spark, sf_dir):
    """Rows only: penalties by cross-validation over folds of whole sources; solvers differ."""
    rows = splits.group_folds(_framed(spark, sf_dir), "source", "gold", LABELS, 2)
    return learning.selected_penalty(rows, "gold", LABELS, "fold", (0.1, 1.0))


def cascade_probabilities(spark, sf_dir):
    """Rows only: the cascade with rows whose evidence was left out, which weigh a half."""
    rows = _framed(spark, sf_dir).withColumn("w", F.lit(1.0))
    out = learning.cascade(rows, rows, "gold", LABELS, omitted=rows.where("gold = 'SUPPORTED'"), weight="w")
    return out.select("doc_id", *(F.round(F.get("probs", F.lit(i)), 6).alias(f"p{i + 1}") for i in range(4)))


QUERIES = {
    "policy_search": policy_search, "best_policy": best_policy, "selection_score": selection_score, "rule_sets": rule_sets, "flattened_candidates": flattened_candidates, "encoded_paths": encoded_paths,
    "span_flags": span_flags, "query_texts": query_texts, "forest_probabilities": forest_probabilities, "extra_trees_probabilities": extra_trees_probabilities, "logistic_probabilities": logistic_probabilities, "penalty_selection": penalty_selection, "cascade_probabilities": cascade_probabilities,
}
ORACLES = {
    "policy_search": POLICIES_SQL, "best_policy": BEST_POLICY_SQL, "selection_score": SELECTION_SQL, "rule_sets": RULE_SETS_SQL, "flattened_candidates": FLATTENED_SQL, "encoded_paths": ENCODED_SQL,
    "span_flags": SPAN_FLAGS_SQL, "query_texts": QUERY_TEXTS_SQL,
}
