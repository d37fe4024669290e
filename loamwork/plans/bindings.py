"""How the concepts of the library bind to the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.sources.tables import table

# -- graph ----------------------------------------------------------------------------------------

#: Edges of all relations: one row an edge record, several records a (head, tail) pair. Ingredients are parts, recipes
#: are customers (of all that they bought), diseases are nations of customers, meridians are nations of suppliers.
EDGES_SQL = """
WITH line AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS edge_id, CASE WHEN l_quantity >= 40 THEN 4 WHEN l_quantity >= 25 THEN 3 WHEN l_quantity >= 10 THEN 2 ELSE 1 END AS authority_rank,
  CAST(l_orderkey % 3 + 1 AS INT) AS books, CAST(l_linenumber AS INT) AS support, l_discount AS confidence, o_custkey, 'd' || CAST(c_nationkey AS VARCHAR) AS disease, l_partkey, l_suppkey, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
e AS (
SELECT edge_id, 'entersmeridian' AS relation, 'Ingredient' AS head_type, CAST(l_partkey AS VARCHAR) AS head, 'Meridian' AS tail_type, CAST(s_nationkey AS VARCHAR) AS tail, authority_rank, books, support, confidence FROM line JOIN supplier ON l_suppkey = s_suppkey
UNION ALL SELECT edge_id, 'containsIngredient', 'Recipe', CAST(o_custkey AS VARCHAR), 'Ingredient', CAST(l_partkey AS VARCHAR), authority_rank, books, support, confidence FROM line
UNION ALL SELECT edge_id, 'treats', 'Ingredient', CAST(l_partkey AS VARCHAR), 'Disease', disease, authority_rank, books, support, confidence FROM line WHERE l_returnflag = 'R'
UNION ALL SELECT edge_id, 'contraindicates', 'Ingredient', CAST(l_partkey AS VARCHAR), 'Disease', disease, authority_rank, books, support, confidence FROM line WHERE l_returnflag = 'A'
UNION ALL SELECT c_custkey, 'affectsOrgan', 'Disease', 'd' || CAST(c_nationkey AS VARCHAR), 'Organ', CAST(n_regionkey AS VARCHAR), 1, 1, 1, 0.5 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey, 'correspondsToOrgan', 'Meridian', CAST(n_nationkey AS VARCHAR), 'Organ', CAST(n_regionkey AS VARCHAR), 4, 2, 3, 0.9 FROM nation
UNION ALL SELECT o_orderkey, 'treatedByRecipe', 'Disease', 'd' || CAST(c_nationkey AS VARCHAR), 'Recipe', CAST(o_custkey AS VARCHAR), 1, 1, 1, 0.25 FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT p_partkey, 'hasNature', 'Ingredient', CAST(p_partkey AS VARCHAR), 'Nature', p_brand, 2, 1, 1, 0.5 FROM part
UNION ALL SELECT p_partkey, 'hasFlavor', 'Ingredient', CAST(p_partkey AS VARCHAR), 'Flavor', p_type, 2, 1, 1, 0.5 FROM part)
"""


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...]) -> DataFrame:
    """Edge records of the named relations, of all rows: only the tables these need are read."""
    t = lambda name: table(spark, sf_dir, name)
    own = ("authority_rank", "books", "support", "confidence")
    text = lambda c: F.col(c).cast("string")
    disease = F.concat(F.lit("d"), text("c_nationkey"))
    quantity = F.col("l_quantity")
    line = t("lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("edge_id"),
        F.when(quantity >= 40, 4).when(quantity >= 25, 3).when(quantity >= 10, 2).otherwise(1).alias("authority_rank"),
        (F.col("l_orderkey") % 3 + 1).cast("int").alias("books"), F.col("l_linenumber").alias("support"), F.col("l_discount").alias("confidence"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag",
    )
    bought = lambda: line.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    people = lambda: t("customer").select("c_custkey", "c_nationkey")
    owned = lambda: t("orders").select("o_orderkey", "o_custkey").join(people(), F.col("o_custkey") == F.col("c_custkey"))
    flagged = lambda flag: line.where(F.col("l_returnflag") == flag).join(owned(), F.col("l_orderkey") == F.col("o_orderkey"))

    def edge(df, relation, edge_id, head_type, head, tail_type, tail, score=own):
        fixed = dict(zip(own, score, strict=True)) if score is not own else None
        columns = [F.lit(fixed[c]).alias(c) for c in own] if fixed else [F.col(c) for c in own]
        return df.select(F.col(edge_id).cast("long").alias("edge_id"), F.lit(relation).alias("relation"), F.lit(head_type).alias("head_type"), head.alias("head"), F.lit(tail_type).alias("tail_type"), tail.alias("tail"), *columns)

    build = {
        "entersmeridian": lambda r: edge(line.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")), r, "edge_id", "Ingredient", text("l_partkey"), "Meridian", text("s_nationkey")),
        "containsIngredient": lambda r: edge(bought(), r, "edge_id", "Recipe", text("o_custkey"), "Ingredient", text("l_partkey")),
        "treats": lambda r: edge(flagged("R"), r, "edge_id", "Ingredient", text("l_partkey"), "Disease", disease),
        "contraindicates": lambda r: edge(flagged("A"), r, "edge_id", "Ingredient", text("l_partkey"), "Disease", disease),
        "affectsOrgan": lambda r: edge(people().join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")), r, "c_custkey", "Disease", disease, "Organ", text("n_regionkey"), (1, 1, 1, 0.5)),
        "correspondsToOrgan": lambda r: edge(t("nation"), r, "n_nationkey", "Meridian", text("n_nationkey"), "Organ", text("n_regionkey"), (4, 2, 3, 0.9)),
        "treatedByRecipe": lambda r: edge(t("orders").join(people(), F.col("o_custkey") == F.col("c_custkey")), r, "o_orderkey", "Disease", disease, "Recipe", text("o_custkey"), (1, 1, 1, 0.25)),
        "hasNature": lambda r: edge(t("part"), r, "p_partkey", "Ingredient", text("p_partkey"), "Nature", F.col("p_brand"), (2, 1, 1, 0.5)),
        "hasFlavor": lambda r: edge(t("part"), r, "p_partkey", "Ingredient", text("p_partkey"), "Flavor", F.col("p_type"), (2, 1, 1, 0.5)),
    }
    out = None
    for relation in relations:
        part = build[relation](relation)
        out = part if out is None else out.unionByName(part)
    return out


# -- labels, predictions, probabilities ------------------------------------------------------------

LABELS = ("SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_CONTEXT", "ENTITY_OR_TYPE_ERROR")
LABEL_LIST_SQL = "['SUPPORTED','NOT_SUPPORTED','INSUFFICIENT_CONTEXT','ENTITY_OR_TYPE_ERROR']"

#: doc_id, source, lang, n_chars, gold, pred, p1..p4 (a probability vector, argmax is pred2)
GOLD_SQL = f"""
SELECT doc_id, source, lang, n_chars, gold, pred, w1 / (w1 + w2 + w3 + w4) AS p1, w2 / (w1 + w2 + w3 + w4) AS p2,
  w3 / (w1 + w2 + w3 + w4) AS p3, w4 / (w1 + w2 + w3 + w4) AS p4 FROM (
SELECT doc_id, source, lang, n_chars,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' WHEN quality = 0 AND toxic = 0 THEN 'NOT_SUPPORTED'
       WHEN quality = 0 THEN 'INSUFFICIENT_CONTEXT' ELSE 'ENTITY_OR_TYPE_ERROR' END AS gold,
  CASE WHEN doc_id % 11 = 0 THEN 'ENTITY_OR_TYPE_ERROR' WHEN n_chars < 400 THEN 'INSUFFICIENT_CONTEXT'
       WHEN n_chars % 5 = 0 THEN 'NOT_SUPPORTED' ELSE 'SUPPORTED' END AS pred,
  CAST(n_chars % 97 + 40 AS DOUBLE) AS w1, CAST(doc_id % 53 + 1 AS DOUBLE) AS w2, CAST(n_chars % 31 + 1 AS DOUBLE) AS w3, CAST(doc_id % 17 + 1 AS DOUBLE) AS w4
FROM labels JOIN documents USING (doc_id))
"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a labelled document: gold from (quality, toxic), a prediction and a probability vector from length and id."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    named = F.when(good & ~toxic, LABELS[0]).when(~good & ~toxic, LABELS[1]).when(~good, LABELS[2]).otherwise(LABELS[3])
    predicted = F.when(F.col("doc_id") % 11 == 0, LABELS[3]).when(F.col("n_chars") < 400, LABELS[2]).when(F.col("n_chars") % 5 == 0, LABELS[1]).otherwise(LABELS[0])
    weights = (F.col("n_chars") % 97 + 40, F.col("doc_id") % 53 + 1, F.col("n_chars") % 31 + 1, F.col("doc_id") % 17 + 1)
    rows = labels.join(docs, "doc_id").select("doc_id", "source", "lang", "n_chars", named.alias("gold"), predicted.alias("pred"), *(w.cast("double").alias(f"w{i}") for i, w in enumerate(weights, 1)))
    total = F.col("w1") + F.col("w2") + F.col("w3") + F.col("w4")
    return rows.withColumn("probs", F.array(*(F.col(f"w{i}") / total for i in range(1, 5)))).drop("w1", "w2", "w3", "w4")


# -- raters ----------------------------------------------------------------------------------------

RATER_SQL = """
SELECT doc_id, source, lang, CASE WHEN quality = 1 THEN 'yes' WHEN toxic = 1 THEN 'unsure' ELSE 'no' END AS first,
  CASE WHEN doc_id % 7 = 0 THEN 'unsure' WHEN quality = 1 OR doc_id % 5 = 0 THEN 'yes' ELSE 'no' END AS second,
  CASE WHEN n_chars > 1500 THEN 'yes' ELSE 'no' END AS third FROM labels JOIN documents USING (doc_id)
"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deterministic raters and an adjudicator of every labelled document."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    first = F.when(F.col("quality") == 1, "yes").when(F.col("toxic") == 1, "unsure").otherwise("no")
    second = F.when(F.col("doc_id") % 7 == 0, "unsure").when((F.col("quality") == 1) | (F.col("doc_id") % 5 == 0), "yes").otherwise("no")
    third = F.when(F.col("n_chars") > 1500, "yes").otherwise("no")
    return labels.join(docs, "doc_id").select("doc_id", "source", "lang", first.alias("first"), second.alias("second"), third.alias("third"))


# -- study -----------------------------------------------------------------------------------------

STUDY_SQL = """
SELECT user_id AS participant, CASE WHEN user_id % 3 = 0 THEN 'expert' ELSE 'novice' END AS role, event_type AS system, value AS score, ts
FROM events WHERE event_type IN ('click', 'view')
"""


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task logs: participants score two systems."""
    role = F.when(F.col("user_id") % 3 == 0, "expert").otherwise("novice")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").alias("participant"), role.alias("role"), F.col("event_type").alias("system"), F.col("value").alias("score"), "ts"
    )
