"""Bounded simple paths between the ends of a query whose own edge is taken out.

Joins extend all items' fronts together, one hop a round, so that Spark spreads the work by node.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.sources.staging import staged

PASSAGE = "__PASSAGE__"


def adjacency(edges: DataFrame, *tokens: str) -> DataFrame:
    """(node, token, neighbour, relation): every edge and its inverse; parallel edges of a relation count once.

    ``tokens`` names the columns that tell edges apart, without which (token, relation) do.
    """
    kept = ("node", *(tokens or ("token", "relation")), "neighbour")
    forward = edges.select(F.col("head").alias("node"), F.col("relation").alias("token"), F.col("tail").alias("neighbour"), "relation")
    backward = edges.select(F.col("tail").alias("node"), F.concat(F.lit("inverse::"), "relation").alias("token"), F.col("head").alias("neighbour"), "relation")
    return forward.unionByName(backward).select(*kept).distinct()


def _edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``adjacency`` by token, and (node, token, leaving, entering): a node's edges of a kind, from one exchange of the edges."""
    once = staged(edges.select("head", "relation", "tail").distinct(), "paths-edges")
    inverse = F.concat(F.lit("inverse::"), "relation")
    near = once.select(F.col("head").alias("node"), F.col("relation").alias("token"), F.col("tail").alias("neighbour")).unionByName(once.select(F.col("tail").alias("node"), inverse.alias("token"), F.col("head").alias("neighbour")))
    if not once.where(F.col("relation").isNull() | F.startswith("relation", F.lit("inverse::"))).isEmpty():
        near = staged(adjacency(once, "token"), "paths-near")  # an edge may be another one's inverse
    ends = once.select(F.col("head").alias("node"), "relation", F.lit(True).alias("ahead")).unionByName(once.select(F.col("tail").alias("node"), "relation", F.lit(False).alias("ahead")))
    n = staged(ends.groupBy("node", "relation", "ahead").agg(F.count("*").alias("n")), "paths-degrees")
    side = lambda token, leaving: n.select("node", token.alias("token"), F.when(leaving, F.col("n")).otherwise(0).alias("leaving"), F.when(leaving, 0).otherwise(F.col("n")).alias("entering"))
    return near, side(F.col("relation"), F.col("ahead")).unionByName(side(inverse, ~F.col("ahead")))


def _indexed(items: DataFrame, n: int) -> DataFrame:
    """``items`` with ``word`` and ``bit``: words hold 64 items each, those of a head together as far as may be.

    Fixed value: words are dealt within hashed groups of about 4,096 items, so that no task orders them all.
    """
    group = F.pmod(F.xxhash64("item_id"), F.lit(n // 4096 + 1))
    place = F.row_number().over(Window.partitionBy("g").orderBy("head", "tail", "item_id", "relation")) - 1
    placed = items.withColumn("g", group).withColumn("place", place)
    word = F.col("g") * F.lit(1 << 32) + F.floor(F.col("place") / 64)
    return placed.select(word.cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64).alias("bit"), "item_id", "head", "relation", "tail")


def _shared(rows: DataFrame, bits, *keys: str) -> DataFrame:
    """One row of united bits for rows that agree in ``keys``."""
    return rows.groupBy(*keys).agg(F.bit_or(bits).alias("mask"))


def _own(side: DataFrame, local: DataFrame) -> DataFrame:
    """``side`` with the items alone that mention its node."""
    m = local.select("word", "node", F.col("mask").alias("mentioning"))
    both = F.col("mask").bitwiseAND(F.col("mentioning"))
    return side.join(m, ["word", "node"]).withColumn("mask", both).where("mask <> 0").drop("mentioning")


def _step(front: DataFrame, near: DataFrame, local: DataFrame, ends: DataFrame, forward: bool, first: bool) -> DataFrame:
    """``front`` one edge on from the head, or one edge back from the tail; simple paths that reach no end of their item."""
    here, there = ("node", "neighbour") if forward else ("neighbour", "node")
    join = lambda part, more: F.concat(part, more) if forward else F.concat(more, part)

    def on(rows: DataFrame, node, token, semantic: int, mask=F.col("f.mask")) -> DataFrame:
        return rows.select(
            "f.word", node.alias("node"), join(F.col("f.nodes"), F.array(node)).alias("nodes"), join(F.col("f.path"), F.array(token)).alias("path"),
            (F.col("f.semantic") + semantic).alias("semantic"), mask.alias("mask"), F.col("f.nodes").alias("before"),
        )

    tokens = ("mentioned_in", "mentions") if forward else ("mentions", "mentioned_in")
    reached = on(front.alias("f").join(near.alias("n"), F.col("f.node") == F.col(f"n.{here}")), F.col(f"n.{there}"), F.col("n.token"), 1)
    reached = reached.unionByName(on(_own(front, local).alias("f"), F.lit(PASSAGE), F.lit(tokens[0]), 0))
    if not first:  # no end is the passage
        from_passage = front.where(F.col("node") == PASSAGE).alias("f").join(local.alias("m"), F.col("f.word") == F.col("m.word"))
        reached = reached.unionByName(on(from_passage, F.col("m.node"), F.lit(tokens[1]), 0, F.col("f.mask").bitwiseAND(F.col("m.mask"))))
        reached = reached.where(~F.array_contains("before", F.col("node")))
    merged = _shared(reached.where("mask <> 0"), "mask", "word", "node", "nodes", "path", "semantic")
    closed = ends.select("word", "node", F.col("mask").alias("closed"))
    open_ = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("closed", F.lit(0).cast("long"))))
    return merged.join(closed, ["word", "node"], "left").withColumn("mask", open_).where("mask <> 0").drop("closed")


def _met(front: DataFrame, back: DataFrame, near: DataFrame, local: DataFrame, degrees: DataFrame, one: bool) -> DataFrame:
    """Paths of a front, one edge, and a back of the same items.

    For every word of items and kind of edge, the edges that leave the front's nodes and those that enter the back's are
    counted. Kinds that one side lacks are not followed at all, and the others from the side with fewer edges, so that a
    hub is left by its edges only where the other side has still more.
    """
    leaving = front.join(degrees, "node").groupBy("word", "token").agg(F.sum("leaving").alias("out"))
    entering = back.join(degrees, "node").groupBy("word", "token").agg(F.sum("entering").alias("in"))
    followed = leaving.where("out > 0").join(entering.where(F.col("in") > 0), ["word", "token"]).select("word", "token", (F.col("out") <= F.col("in")).alias("ahead"))
    followed = staged(followed, "paths-followed")

    def whole(rows: DataFrame, token, semantic: int) -> DataFrame:
        mask = F.col("f.mask").bitwiseAND(F.col("b.mask"))
        open_ = rows.where((mask != 0) & ~F.arrays_overlap("f.nodes", "b.nodes"))
        return open_.select(
            "f.word", mask.alias("mask"), F.concat("f.nodes", "b.nodes").alias("nodes"), F.concat("f.path", F.array(token), "b.path").alias("path"),
            (F.col("f.semantic") + F.col("b.semantic") + semantic).alias("semantic"),
        )

    word = F.col("f.word") == F.col("b.word")
    kinds = lambda which: near.join(followed.where(which).select("token").distinct(), "token", "left_semi").hint("merge")
    ahead = front.join(followed.where("ahead"), "word").join(kinds("ahead"), ["node", "token"]).alias("f").join(back.alias("b"), word & (F.col("f.neighbour") == F.col("b.node")))
    turned = kinds("not ahead").select(F.col("node").alias("before"), "token", F.col("neighbour").alias("node")).hint("merge")
    behind = back.join(followed.where("not ahead"), "word").join(turned, ["node", "token"]).alias("b").join(front.alias("f"), word & (F.col("b.before") == F.col("f.node")))
    # a word has one front or back of one edge at its passage
    at_passage = lambda side: F.broadcast(side.where(F.col("node") == PASSAGE)) if one else side.where(F.col("node") == PASSAGE)
    into = _own(front, local).alias("f").join(at_passage(back).alias("b"), word)
    out = at_passage(front).alias("f").join(_own(back, local).alias("b"), word)
    parts = (whole(ahead, F.col("f.token"), 1), whole(behind, F.col("b.token"), 1), whole(into, F.lit("mentioned_in"), 0), whole(out, F.lit("mentions"), 0))
    return functools.reduce(DataFrame.unionByName, parts)


def shared_paths(items: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 3) -> tuple[DataFrame, DataFrame, bool]:
    """All simple paths of at most ``hops`` edges, those of 64 items at once; the items; and whether items share an id.

    ``items``: item_id, head, relation, tail. ``mentions``: item_id, node; the passage is a node that all of them touch,
    and no edge's. The first table: word, mask (bits of the items whose path it is), nodes (those between the ends),
    edges, hops, semantic_edges, passage_conditioned. The second: word, bit, item_id, head, relation, tail.

    Paths grow from both ends and meet in the middle: one of n edges is a front of half of the others from the head, one
    edge, and a back of the rest from the tail. Fronts and backs of three hops are one edge long each; a front meets
    all its backs at once. Ends are left out of a path's nodes, so that items which reach a node alike share a row.
    Edges, mentions, fronts and backs are staged, so that no join computes them anew; files say little of a table's size
    in memory, so no join but those with the items, their ends and the kinds of edges may broadcast them. As each path
    has one such parting, an item's paths differ without a comparison of them all, unless items share an id.
    """
    near, degrees = _edges(edges)
    items = staged(items.select("item_id", "head", "relation", "tail").where("head <> tail").distinct(), "paths-items")
    n, most = items.groupBy("item_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    index = staged(_indexed(items, n), "paths-index")
    local = staged(_shared(mentions.join(index.select("item_id", "word", "bit"), "item_id"), "bit", "word", "node"), "paths-local")
    ends = staged(_shared(index.select("word", "bit", F.explode(F.array("head", "tail")).alias("node")), "bit", "word", "node"), "paths-ends")
    none = F.array().cast("array<string>")
    start = lambda end: staged(_shared(index, "bit", "word", end), f"paths-{end}").select("word", F.col(end).alias("node"), none.alias("nodes"), none.alias("path"), F.lit(0).alias("semantic"), "mask")
    fronts, backs = [start("head")], [start("tail")]
    far = near.hint("merge")
    for k in range(1, hops // 2 + 1):
        fronts.append(staged(_step(fronts[-1], near if k == 1 else far, local, ends, True, k == 1), "paths-front"))
        if k <= (hops - 1) // 2:
            backs.append(staged(_step(backs[-1], near if k == 1 else far, local, ends, False, k == 1), "paths-back"))
    # the queried relation between the two ends is taken out both ways, and only paths of one edge could use it
    direct = index.alias("i").join(near.alias("n"), (F.col("i.head") == F.col("n.node")) & (F.col("i.tail") == F.col("n.neighbour")))
    met = [direct.where(~F.regexp_replace("token", "^inverse::", "").eqNullSafe(F.col("relation"))).select("word", F.col("bit").alias("mask"), none.alias("nodes"), F.array("token").alias("path"), F.lit(1).alias("semantic"))]
    for i, front in enumerate(fronts[1:], 1):  # a front of i edges meets backs of as many and of one less
        back = functools.reduce(DataFrame.unionByName, (backs[j] for j in (i - 1, i) if j < len(backs) and i + j < hops))
        met.append(_met(front, back, near, local, degrees, i == 1))
    found = functools.reduce(DataFrame.unionByName, met)
    ways = found.where("semantic > 0").select(
        "word", "mask", "nodes", F.col("path").alias("edges"), F.size("path").alias("hops"), F.col("semantic").alias("semantic_edges"),
        F.array_contains("nodes", PASSAGE).alias("passage_conditioned"),
    )
    return ways, index, most > 1


def of_items(shared: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``shared``, one for every item whose bit its mask has, with item_id, head and tail."""
    rows = shared.join(index.drop("relation"), "word").where(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    return rows.drop("word", "mask", "bit")


def counted(ways: DataFrame, index: DataFrame, *keys) -> DataFrame:
    """item_id, the keys and ``n``, in parts: an item's paths that agree in ``keys`` are counted before they go to items."""
    return of_items(ways.groupBy("word", "mask", *keys).agg(F.count("*").alias("n")), index).drop("head", "tail")


def enumerate_paths(items: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 3) -> DataFrame:
    """All simple paths of at most ``hops`` edges: item_id, nodes, edges, hops, semantic_edges, passage_conditioned.

    ``items``: item_id, head, relation, tail. ``mentions``: item_id, node; the passage is a node that all of them touch.
    The queried relation between the two ends is taken out both ways. A path ends at the tail, visits no node twice
    and has an edge that is not a mention. Unlike a search with a cap, the result does not depend on an order.
    """
    ways, index, repeated = shared_paths(items, edges, mentions, hops)
    return _whole(ways, index, repeated)


def _whole(ways: DataFrame, index: DataFrame, repeated: bool = False) -> DataFrame:
    nodes = F.concat(F.array("head"), F.col("nodes"), F.array("tail"))
    paths = of_items(ways, index).select("item_id", nodes.alias("nodes"), "edges", "hops", "semantic_edges", "passage_conditioned")
    return paths.distinct() if repeated else paths


_ORDER = ("hops", "-semantic_edges", "edges", "nodes")


def select_paths(paths: DataFrame, most: int = 32, passage_quota: int = 16, semantic_quota: int = 16) -> DataFrame:
    """At most ``most`` paths an item: each kind's best up to its quota, then the best of the rest; with ``rank``.

    No path beyond the ``most`` best of its kind can be among them, as the better ones of its kind go first.
    """
    order = [F.expr(c) for c in _ORDER]
    quota = F.when(F.col("passage_conditioned"), passage_quota).otherwise(semantic_quota)
    kind = Window.partitionBy("item_id", "passage_conditioned").orderBy(*order)
    ranked = paths.withColumn("nth", F.row_number().over(kind)).where(F.col("nth") <= most).withColumn("in_quota", F.col("nth") <= quota)
    fill = Window.partitionBy("item_id").orderBy(F.desc("in_quota"), *order)
    kept = ranked.withColumn("place", F.row_number().over(fill)).where(F.col("place") <= most)
    final = Window.partitionBy("item_id").orderBy("hops", F.desc("passage_conditioned"), "edges", "nodes")
    return kept.withColumn("rank", F.row_number().over(final)).drop("nth", "in_quota", "place")


def select_shared(ways: DataFrame, index: DataFrame, most: int = 32, passage_quota: int = 16, semantic_quota: int = 16) -> DataFrame:
    """``select_paths`` of shared paths of items with ids of their own.

    Items keep the order of a way among others, as their ends are first and last in all; so of ways that the same
    items share, those beyond the ``most`` best of a kind go before items are told apart.
    """
    alike = Window.partitionBy("word", "mask", "passage_conditioned").orderBy(*(F.expr(c) for c in _ORDER))
    best = ways.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= most).drop("nth")
    return select_paths(_whole(best, index), most, passage_quota, semantic_quota)


def path_counts(paths: DataFrame, n=None) -> DataFrame:
    """Paths an item, in all and by kind; ``n`` is how many a row stands for, one by default."""
    n = F.lit(1) if n is None else n
    of = lambda kind: F.sum(F.when(kind, n).otherwise(0))
    return paths.groupBy("item_id").agg(F.sum(n).alias("path_count"), of(F.col("passage_conditioned")).alias("passage_paths"), of(~F.col("passage_conditioned")).alias("semantic_paths"), F.min("hops").alias("least_hops"))


def relevance(passage, nodes="nodes", ends: bool = True):
    """How well a path fits a passage: it goes through it, the passage names its inner nodes, semantic edges, few hops.

    ``ends``: whether ``nodes`` holds the ends too. Fixed values: the four weights 4, 1.5, 0.25 and 0.15.
    """
    between = F.slice(nodes, 2, F.greatest(F.size(nodes) - 2, F.lit(0))) if ends else nodes
    inner = F.filter(between, lambda n: (n != PASSAGE) & (n != "") & F.contains(passage, n))
    return 4.0 * F.col("passage_conditioned").cast("int") + 1.5 * F.size(inner) + 0.25 * F.col("semantic_edges") - 0.15 * F.col("hops")


def path_features(paths: DataFrame, n=None) -> DataFrame:
    """(item_id, feature, value): how often each edge token and each number of hops occurs, and both kinds' counts.

    ``n`` is how many paths a row stands for, one by default.
    """
    kind = F.when(F.col("passage_conditioned"), "kind=passage").otherwise("kind=semantic")
    names = F.concat(F.transform("edges", lambda e: F.concat(F.lit("edge="), e)), F.array(F.concat(F.lit("hops="), F.col("hops").cast("string")), kind, F.lit("paths")))
    alike = paths.groupBy("item_id", "edges", "hops", "passage_conditioned").agg(F.sum(F.lit(1) if n is None else n).alias("n"))  # their features are too
    return alike.select("item_id", "n", F.explode(names).alias("feature")).groupBy("item_id", "feature").agg(F.sum("n").alias("value"))


def encoded(paths: DataFrame, tokens: DataFrame, node_type, most: int = 16, hops: int = 3) -> DataFrame:
    """item_id, edge_ids, type_ids, hop_mask, path_mask, path_features, graph_features: arrays of one size for every item.

    ``tokens``: (kind, token, id) of edges and node types from 1; ids that are not known and padding are 0. Paths go by
    passage first, then more semantic edges, fewer hops and their edges. ``node_type`` maps a node column to its type.
    Fixed values: counts are scaled by the logarithm of 33.
    """
    order = F.struct((-F.col("passage_conditioned").cast("int")).alias("a"), (-F.col("semantic_edges")).alias("b"), F.col("hops").alias("c"), F.array_join("edges", "|").alias("d"), F.array_join("nodes", "|").alias("e"), "nodes", "edges", "passage_conditioned", "semantic_edges")
    place = Window.partitionBy("item_id").orderBy("order")
    first = paths.select("item_id", order.alias("order")).withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= most)
    long = first.select("item_id", "nth", F.posexplode(F.concat(F.transform(F.slice("order.edges", 1, hops), lambda x: F.struct(F.lit("edge").alias("kind"), x.alias("token"))), F.transform(F.slice("order.nodes", 1, hops + 1), lambda x: F.struct(F.lit("type").alias("kind"), node_type(x).alias("token"))))).alias("at", "x")).select("item_id", "nth", "at", "x.*")
    known = long.join(tokens, ["kind", "token"], "left").groupBy("item_id", "nth").agg(F.sort_array(F.collect_list(F.struct("kind", "at", F.coalesce("id", F.lit(0)).alias("id")))).alias("ids"))
    ids = lambda kind, size: F.slice(F.concat(F.transform(F.filter("ids", lambda x: x["kind"] == kind), lambda x: x["id"]), F.array_repeat(F.lit(0), size)), 1, size)
    own = F.size(F.filter("ids", lambda x: x["kind"] == "edge"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(hops - 1)), lambda i: i < own)
    features = F.array(F.col("order.passage_conditioned").cast("double"), F.col("order.semantic_edges") / float(hops), own / float(hops))
    rows = known.join(first, ["item_id", "nth"]).select("item_id", F.struct("nth", ids("edge", hops).alias("edges"), ids("type", hops + 1).alias("types"), mask.alias("mask"), features.alias("features")).alias("p"))
    packed = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    counts = path_counts(paths).withColumn("n", F.col("path_count").cast("double"))
    graph = F.array(F.log1p("n") / math.log(33.0), F.col("passage_paths") / F.greatest("n", F.lit(1.0)), F.col("semantic_paths") / F.greatest("n", F.lit(1.0)))

    def padded(part: str, empty):
        return F.flatten(F.slice(F.concat(F.transform("ps", lambda p: p[part]), F.array_repeat(empty, most)), 1, most))

    zeros = lambda size, kind: F.array_repeat(F.lit(0).cast(kind), size)
    return packed.join(counts, "item_id").select(
        "item_id", padded("edges", zeros(hops, "int")).alias("edge_ids"), padded("types", zeros(hops + 1, "int")).alias("type_ids"), padded("mask", F.array_repeat(F.lit(False), hops)).alias("hop_mask"),
        F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: i <= F.size("ps")).alias("path_mask"), padded("features", zeros(3, "double")).alias("path_features"), graph.alias("graph_features"),
    )
