"""Graph and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwork.operators import paths, rules
from loamwork.plans.bindings import EDGES_SQL, edges
from loamwork.sources.staging import staged
from loamwork.sources.tables import table

_BEST = EDGES_SQL + """, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, head, tail ORDER BY authority_rank DESC, books DESC, support DESC, confidence DESC, edge_id DESC) AS rn FROM e) WHERE rn = 1)
"""
_ASSERTED = ", asserted AS (SELECT DISTINCT head, tail FROM e WHERE relation = 'treats')"


def _candidate_sql(path: str) -> str:
    return f"""{_BEST}{_ASSERTED}, p AS ({path}),
q AS (SELECT *, count(*) OVER (PARTITION BY head, tail) AS path_count, row_number() OVER (PARTITION BY head, tail ORDER BY least_rank DESC, ranks DESC, books DESC, support DESC, confidence DESC, path DESC) AS rn
  FROM p WHERE NOT EXISTS (SELECT 1 FROM asserted a WHERE a.head = p.head AND a.tail = p.tail))
SELECT head, tail, path_count, least_rank, ranks, books, support, confidence, path FROM q WHERE rn = 1"""


def _sums(*names: str) -> str:
    total = lambda c: " + ".join(f"{n}.{c}" for n in names)
    return (
        f"least({', '.join(f'{n}.authority_rank' for n in names)}) AS least_rank, {total('authority_rank')} AS ranks, {total('books')} AS books, "
        f"{total('support')} AS support, round(CAST({total('confidence')} AS DOUBLE), 9) AS confidence, [{', '.join(f'{n}.edge_id' for n in names)}] AS path"
    )


B1_SQL = _candidate_sql(
    f"SELECT x.head AS head, z.head AS tail, {_sums('x', 'y', 'z')} FROM b x JOIN b y ON x.relation = 'entersmeridian' AND y.relation = 'correspondsToOrgan' AND x.tail = y.head JOIN b z ON z.relation = 'affectsOrgan' AND z.tail = y.tail"
)
B2_SQL = _candidate_sql(
    f"SELECT x.head AS head, y.tail AS tail, {_sums('x', 'y')} FROM b x JOIN b y ON x.relation = 'containsIngredient' AND y.relation = 'treats' AND x.tail = y.head"
)
B3_SQL = _candidate_sql(
    f"SELECT y.tail AS head, x.head AS tail, {_sums('x', 'y')} FROM b x JOIN b y ON x.relation = 'treatedByRecipe' AND y.relation = 'containsIngredient' AND x.tail = y.head"
)


def rule_b1(spark, sf_dir):
    return rules.b1(edges(spark, sf_dir, ("entersmeridian", "correspondsToOrgan", "affectsOrgan", "treats")))


def rule_b2(spark, sf_dir):
    return rules.b2(edges(spark, sf_dir, ("containsIngredient", "treats")))


def rule_b3(spark, sf_dir):
    return rules.b3(edges(spark, sf_dir, ("treatedByRecipe", "containsIngredient", "treats")))


def rule_a(spark, sf_dir):
    """A1 to A3 with a vocabulary of natures and flavours that a dozen parts have."""
    e = edges(spark, sf_dir, ("containsIngredient", "hasNature", "hasFlavor", "entersmeridian"))
    often = lambda rule, c: table(spark, sf_dir, "part").groupBy(F.lit(rule).alias("rule"), F.col(c).alias("tail")).count().where("count >= 12").drop("count")
    meridians = table(spark, sf_dir, "nation").select(F.lit("A3").alias("rule"), F.col("n_nationkey").cast("string").alias("tail"))
    return rules.inherited(e, often("A1", "p_brand").unionByName(often("A2", "p_type")).unionByName(meridians))


RULE_A_SQL = EDGES_SQL + """, v AS (SELECT 'A1' AS rule, p_brand AS tail FROM part GROUP BY p_brand HAVING count(*) >= 12 UNION SELECT 'A2', p_type FROM part GROUP BY p_type HAVING count(*) >= 12
  UNION SELECT 'A3', CAST(n_nationkey AS VARCHAR) FROM nation),
p AS (SELECT DISTINCT head AS ingredient, tail, CASE relation WHEN 'hasNature' THEN 'A1' WHEN 'hasFlavor' THEN 'A2' ELSE 'A3' END AS rule FROM e WHERE relation IN ('hasNature', 'hasFlavor', 'entersmeridian'))
SELECT DISTINCT p.rule, c.head, p.tail FROM e c JOIN p ON c.relation = 'containsIngredient' AND c.tail = p.ingredient JOIN v ON v.rule = p.rule AND v.tail = p.tail"""


def rule_c(spark, sf_dir):
    """C1 by keyword overlap, C2 by the lack of it, C3 by contradiction."""
    e = edges(spark, sf_dir, ("hasNature", "entersmeridian", "treats", "contraindicates"))
    last = lambda c: F.substring(c, -1, 1)
    c1 = rules.keyword_conflicts(e, "hasNature", "C1", F.contains(F.col("disease"), last("property")))
    c2 = rules.keyword_conflicts(e, "entersmeridian", "C2", ~F.contains(F.col("disease"), last("property")))
    c3 = rules.contradictions(e).select("rule", "ingredient", F.lit("contraindicates").alias("property"), "disease")
    return c1.unionByName(c2).unionByName(c3)


RULE_C_SQL = EDGES_SQL + """, t AS (SELECT DISTINCT head, tail FROM e WHERE relation = 'treats'), n AS (SELECT DISTINCT head, tail FROM e WHERE relation = 'hasNature'),
m AS (SELECT DISTINCT head, tail FROM e WHERE relation = 'entersmeridian'), c AS (SELECT DISTINCT head, tail FROM e WHERE relation = 'contraindicates')
SELECT 'C1' AS rule, n.head AS ingredient, n.tail AS property, t.tail AS disease FROM n JOIN t ON n.head = t.head WHERE contains(t.tail, right(n.tail, 1))
UNION ALL SELECT 'C2', m.head, m.tail, t.tail FROM m JOIN t ON m.head = t.head WHERE NOT contains(t.tail, right(m.tail, 1))
UNION ALL SELECT 'C3', t.head, 'contraindicates', t.tail FROM t JOIN c ON t.head = c.head AND t.tail = c.tail"""


def role_views(spark, sf_dir):
    """Edges and mean support that each role sees, by relation."""
    e = edges(spark, sf_dir, ("entersmeridian", "affectsOrgan", "treats", "correspondsToOrgan"))
    out = None
    for role in ("general", "professional", "researcher"):
        part = rules.role_view(e, role, "Organ").groupBy("relation").agg(F.count("*").alias("n_edges"), F.round(F.avg("support"), 6).alias("mean_support")).withColumn("role", F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out


ROLE_VIEWS_SQL = EDGES_SQL + """, x AS (SELECT * FROM e WHERE relation IN ('entersmeridian', 'affectsOrgan', 'treats', 'correspondsToOrgan')),
r AS (SELECT 'general' AS role, * FROM x WHERE head_type <> 'Organ' AND tail_type <> 'Organ' AND authority_rank > 1
  UNION ALL SELECT 'professional', * FROM x WHERE head_type <> 'Organ' AND tail_type <> 'Organ' UNION ALL SELECT 'researcher', * FROM x)
SELECT role, relation, count(*) AS n_edges, round(avg(support), 6) AS mean_support FROM r GROUP BY role, relation"""


def best_edge(spark, sf_dir):
    e = edges(spark, sf_dir, ("entersmeridian", "containsIngredient", "treats"))
    return rules.best_edges(e, ("relation", "head", "tail"))


BEST_EDGE_SQL = _BEST + "SELECT relation, head, tail, authority_rank, books, support, confidence, edge_id FROM b WHERE relation IN ('entersmeridian', 'containsIngredient', 'treats')"

_PATH_EDGES = """
WITH ed AS (SELECT 'N' || n_nationkey AS head, 'inRegion' AS relation, 'R' || n_regionkey AS tail FROM nation
  UNION SELECT DISTINCT 'N' || s_nationkey, 'sells', 'P' || l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
item AS (SELECT x.n_nationkey * 100 + y.n_nationkey AS item_id, 'N' || x.n_nationkey AS head, 'inRegion' AS relation, CASE WHEN (x.n_nationkey + y.n_nationkey) % 2 = 0 THEN 'R' || x.n_regionkey ELSE 'N' || y.n_nationkey END AS tail
  FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey),
men AS (SELECT item_id, head AS node FROM item UNION SELECT item_id, tail FROM item UNION SELECT item_id, ed.tail FROM item JOIN ed ON ed.head = item.head AND ed.relation = 'sells'),
adj AS (SELECT DISTINCT head AS node, relation AS token, tail AS nb, relation FROM ed UNION SELECT DISTINCT tail, 'inverse::' || relation, head, relation FROM ed),
step AS (SELECT NULL::BIGINT AS item_id, a.node, a.token, a.nb, a.relation, 1 AS sem FROM adj a
  UNION ALL SELECT item_id, node, 'mentioned_in', '__PASSAGE__', NULL, 0 FROM men UNION ALL SELECT item_id, '__PASSAGE__', 'mentions', node, NULL, 0 FROM men),
f0 AS (SELECT item_id, head, relation, tail, head AS node, [head] AS nodes, CAST([] AS VARCHAR[]) AS edges, 0 AS sem FROM item)
"""


def _hop_sql(n: int) -> str:
    return f""", r{n} AS (SELECT f.item_id, f.head, f.relation, f.tail, s.nb AS node, list_append(f.nodes, s.nb) AS nodes, list_append(f.edges, s.token) AS edges, f.sem + s.sem AS sem
  FROM f{n - 1} f JOIN step s ON s.node = f.node {'AND s.nb = f.tail ' if n == 3 else ''}AND (s.item_id IS NULL OR s.item_id = f.item_id)
  WHERE NOT coalesce(s.relation = f.relation AND ((f.node = f.head AND s.nb = f.tail) OR (f.node = f.tail AND s.nb = f.head)), false) AND NOT list_contains(f.nodes, s.nb)),
f{n} AS (SELECT * FROM r{n} WHERE node <> tail)"""


_PATHS = _PATH_EDGES + "".join(_hop_sql(n) for n in (1, 2, 3)) + """, allp AS (SELECT DISTINCT item_id, nodes, edges, len(edges) AS hops, sem AS semantic_edges, list_contains(nodes, '__PASSAGE__') AS passage_conditioned
  FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) WHERE node = tail AND sem > 0)
"""


def _bound(spark, sf_dir):
    """Items, edges and mentions of the path queries."""
    nation = table(spark, sf_dir, "nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    sold = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.select("s_nationkey", "l_partkey").repartition("l_partkey").distinct()  # a part's sellers in one task, where its mentions are united
    sells = staged(sold.select(name("N", "s_nationkey").alias("head"), F.lit("sells").alias("relation"), name("P", "l_partkey").alias("tail")), "paths-sells")
    graph = nation.select(name("N", "n_nationkey").alias("head"), F.lit("inRegion").alias("relation"), name("R", "n_regionkey").alias("tail")).unionByName(sells)
    other = nation.select(F.col("n_nationkey").alias("k2"), F.col("n_regionkey").alias("n_regionkey"))
    pair = nation.join(other, "n_regionkey").where("n_nationkey < k2")
    tail = F.when((F.col("n_nationkey") + F.col("k2")) % 2 == 0, name("R", "n_regionkey")).otherwise(name("N", "k2"))
    items = pair.select((F.col("n_nationkey") * 100 + F.col("k2")).cast("long").alias("item_id"), name("N", "n_nationkey").alias("head"), F.lit("inRegion").alias("relation"), tail.alias("tail"))
    mentions = items.select("item_id", F.explode(F.array("head", "tail")).alias("node")).unionByName(items.join(sells.select("head", F.col("tail").alias("node")), "head").select("item_id", "node"))
    return items, graph, mentions


def _paths(spark, sf_dir):
    return paths.enumerate_paths(*_bound(spark, sf_dir), 3)


def _shared(spark, sf_dir):
    ways, index, _ = paths.shared_paths(*_bound(spark, sf_dir), 3)  # the pairs of nations have ids of their own
    return ways, index


def target_deleted_paths(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("item_id", F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), "hops", "semantic_edges", "passage_conditioned")


PATHS_SQL = _PATHS + "SELECT item_id, array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges, hops, semantic_edges, passage_conditioned FROM allp"


def selected_paths(spark, sf_dir):
    p = paths.select_shared(*_shared(spark, sf_dir), 8, 4, 4)
    return p.select("item_id", "rank", F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), "passage_conditioned")


SELECTED_SQL = _PATHS + """, q AS (SELECT *, row_number() OVER (PARTITION BY item_id, passage_conditioned ORDER BY hops, semantic_edges DESC, edges, nodes) <= 4 AS in_quota FROM allp),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY in_quota DESC, hops, semantic_edges DESC, edges, nodes) AS place FROM q)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hops, passage_conditioned DESC, edges, nodes) AS INT) AS rank, array_to_string(nodes, '>') AS nodes, array_to_string(edges, '>') AS edges, passage_conditioned FROM k WHERE place <= 8"""


def path_coverage(spark, sf_dir):
    return paths.path_counts(paths.counted(*_shared(spark, sf_dir), "hops", "passage_conditioned"), F.col("n"))


COVERAGE_SQL = _PATHS + "SELECT item_id, count(*) AS path_count, count(*) FILTER (passage_conditioned) AS passage_paths, count(*) FILTER (NOT passage_conditioned) AS semantic_paths, min(hops) AS least_hops FROM allp GROUP BY item_id"

def path_features(spark, sf_dir):
    return paths.path_features(paths.counted(*_shared(spark, sf_dir), "edges", "hops", "passage_conditioned"), F.col("n"))


FEATURES_SQL = _PATHS + """, f AS (SELECT item_id, 'edge=' || unnest(edges) AS feature FROM allp UNION ALL SELECT item_id, 'hops=' || hops FROM allp
  UNION ALL SELECT item_id, CASE WHEN passage_conditioned THEN 'kind=passage' ELSE 'kind=semantic' END FROM allp UNION ALL SELECT item_id, 'paths' FROM allp)
SELECT item_id, feature, count(*) AS value FROM f GROUP BY ALL"""


def path_relevance(spark, sf_dir):
    """The most relevant path of each item against a passage that names its regions."""
    passage = F.lit("R0 R1 R2 R3 R4 P1 P2 P3")
    ways, index = _shared(spark, sf_dir)
    scored = paths.counted(ways, index, F.round(paths.relevance(passage, ends=False), 6).alias("score"))
    mean = F.sum(F.col("score").cast("decimal(12,6)") * F.col("n")).cast("double") / F.sum("n")
    return scored.groupBy("item_id").agg(F.max("score").alias("best"), F.round(mean, 6).alias("mean"))


RELEVANCE_SQL = _PATHS + """, r AS (SELECT item_id, round(4.0 * CAST(passage_conditioned AS INT) + 1.5 * len([n FOR n IN nodes[2:-2] IF n <> '__PASSAGE__' AND contains('R0 R1 R2 R3 R4 P1 P2 P3', n)]) + 0.25 * semantic_edges - 0.15 * hops, 6) AS score FROM allp)
SELECT item_id, CAST(max(score) AS DOUBLE) AS best, round(CAST(avg(score) AS DOUBLE), 6) AS mean FROM r GROUP BY item_id"""

QUERIES = {
    "path_features": path_features, "path_relevance": path_relevance,
    "rule_b1": rule_b1, "rule_b2": rule_b2, "rule_b3": rule_b3, "rule_a": rule_a, "rule_c": rule_c, "role_views": role_views, "best_edge": best_edge,
    "target_deleted_paths": target_deleted_paths, "selected_paths": selected_paths, "path_coverage": path_coverage,
}
ORACLES = {
    "path_features": FEATURES_SQL, "path_relevance": RELEVANCE_SQL,
    "rule_b1": B1_SQL, "rule_b2": B2_SQL, "rule_b3": B3_SQL, "rule_a": RULE_A_SQL, "rule_c": RULE_C_SQL, "role_views": ROLE_VIEWS_SQL, "best_edge": BEST_EDGE_SQL,
    "target_deleted_paths": PATHS_SQL, "selected_paths": SELECTED_SQL, "path_coverage": COVERAGE_SQL,
}
