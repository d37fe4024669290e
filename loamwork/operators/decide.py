"""Guards, thresholds, routers and searches over grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import vectors as V
from loamwork.operators.metrics import ratio

LABELS = ("SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_CONTEXT", "ENTITY_OR_TYPE_ERROR")


def staged(p: Column, error: Column | float = 0.30, insufficient: Column | float = 0.40, support: Column | float = 0.50) -> Column:
    """Entity error, then insufficient context, then supported, else not; each by its threshold on the stage view."""
    at = lambda x: x if isinstance(x, Column) else F.lit(x)
    view = V.stage_view(p)
    return (
        F.when(F.get(view, F.lit(2)) >= at(error), LABELS[3]).when(F.get(view, F.lit(1)) >= at(insufficient), LABELS[2]).when(F.get(view, F.lit(0)) >= at(support), LABELS[0]).otherwise(LABELS[1])
    )


def judged(p: Column, judgeability: Column | float, support: Column | float) -> Column:
    """Not judgeable: the likelier of the two reasons; else by support among the judgeable."""
    at = lambda x: x if isinstance(x, Column) else F.lit(x)
    reason = F.when(F.get(p, F.lit(2)) >= F.get(p, F.lit(3)), LABELS[2]).otherwise(LABELS[3])
    return F.when(V.judgeability(p) < at(judgeability), reason).when(V.support_given_judgeable(p) >= at(support), LABELS[0]).otherwise(LABELS[1])


def rejected(p: Column, reject: Column, thresholds: Mapping[str, float]) -> Column:
    """Argmax, but insufficient context where the reject score is above the label's own threshold."""
    best = V.argmax(p, LABELS)
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in thresholds.items() for x in pair)), best)
    return F.when(reject > limit, LABELS[2]).otherwise(best)


def guarded(rows: DataFrame, signatures: DataFrame, probs: str = "probs") -> DataFrame:
    """All mass goes to the type error where a relation's (head_type, tail_type) is none of its signatures.

    ``signatures``: relation, head_type, tail_type, a fixed table. Relations without a signature pass.
    """
    known = signatures.groupBy("relation").agg(F.collect_set(F.struct("head_type", "tail_type")).alias("_allowed"))
    joined = rows.join(known, "relation", "left")
    fits = F.col("_allowed").isNull() | F.exists("_allowed", lambda s: (s["head_type"] == F.col("head_type")) & (s["tail_type"] == F.col("tail_type")))
    forced = F.array(*(F.lit(1.0 if label == LABELS[3] else 0.0) for label in LABELS))
    return joined.withColumn("signature_valid", fits).withColumn(probs, F.when(fits, F.col(probs)).otherwise(forced)).drop("_allowed")


def routed(group: Column, experts: Mapping[str, Column], default: Column) -> Column:
    """The expert's vector of the row's group."""
    out = default
    for name, vector in experts.items():
        out = F.when(group == name, vector).otherwise(out)
    return out


def soft_routed(weight: Column, left: Column, right: Column) -> Column:
    """``weight * left + (1 - weight) * right``, elementwise."""
    return F.zip_with(left, right, lambda x, y: weight * x + (1 - weight) * y)


def threshold_search(rows: DataFrame, score: str, positive: str, grid: Sequence[float], by: Sequence[str] = (), least_each: int = 0) -> DataFrame:
    """The threshold of the greatest (F1, recall, precision, threshold) a group, with its counts.

    Scores are first counted by the number of grid points they reach, so the grid is applied to ``len(grid) + 1``
    counts a group and not to every row. Groups with fewer than ``least_each`` of a class are left out.
    """
    points = sorted(grid)
    reach = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in points[1:]), F.when(F.col(score) >= points[0], 1).otherwise(0))
    counts = rows.groupBy(*by, reach.alias("reach")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count("*").alias("n"))
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(points, 1))))
    long = counts.select(*by, "reach", "pos", "n", every.alias("g")).select(*by, "g.threshold", (F.col("reach") >= F.col("g.at")).cast("int").alias("on"), "pos", "n")
    sums = long.groupBy(*by, "threshold").agg(F.sum(F.col("on") * F.col("pos")).alias("tp"), F.sum(F.col("on") * (F.col("n") - F.col("pos"))).alias("fp"), F.sum("pos").alias("positives"), F.sum("n").alias("n"))
    sums = sums.where((F.col("positives") >= least_each) & (F.col("n") - F.col("positives") >= least_each))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp")
    scored = sums.select(*by, "threshold", F.struct(F.round(ratio(2 * tp, 2 * tp + fp + fn), 12).alias("f1"), F.round(ratio(tp, tp + fn), 12).alias("recall"), F.round(ratio(tp, tp + fp), 12).alias("precision"), F.col("threshold").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).alias("best"))
    return scored.groupBy(*by).agg(F.max("best").alias("best")).select(*by, "best.*")


def judged_grid_search(rows: DataFrame, gold: str, judgeability: Sequence[float], support: Sequence[float], by: Sequence[str] = (), probs: str = "probs", labels: Sequence[str] = LABELS) -> DataFrame:
    """``by``, judgeability, support, macro_f1, accuracy of ``judged`` at every pair of thresholds.

    Rows are first counted by how many points of either grid they reach and by the likelier reason, so the grid is
    applied to these cells, whose number the grid bounds, and no row meets it.
    """
    p = F.col(probs)
    reach = lambda x, points: sum((F.when(x >= t, 1).otherwise(0) for t in sorted(points)[1:]), F.when(x >= sorted(points)[0], 1).otherwise(0))
    reason = F.when(F.get(p, F.lit(2)) >= F.get(p, F.lit(3)), LABELS[2]).otherwise(LABELS[3])
    cells = rows.groupBy(*by, F.col(gold).alias("gold"), reach(V.judgeability(p), judgeability).alias("rj"), reach(V.support_given_judgeable(p), support).alias("rs"), reason.alias("reason")).agg(F.count("*").alias("n"))
    points = lambda grid, name: F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(float(t)).alias("t")) for i, t in enumerate(sorted(grid), 1)))).alias(name)
    each = cells.select("*", points(judgeability, "j")).select("*", points(support, "s"))
    decision = F.when(F.col("rj") < F.col("j.at"), F.col("reason")).when(F.col("rs") >= F.col("s.at"), LABELS[0]).otherwise(LABELS[1])
    counts = each.groupBy(*by, F.col("j.t").alias("judgeability"), F.col("s.t").alias("support"), "gold", decision.alias("pred")).agg(F.sum("n").alias("n"))
    return counted_scores(counts, [*by, "judgeability", "support"], labels)


def counted_scores(counts: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """``by``, macro_f1, accuracy from rows of (``by``, gold, pred, n), one each."""
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.col("n").alias("g"), zero.alias("p")), F.struct(F.col("pred").alias("label"), zero.alias("g"), F.col("n").alias("p"))))
    hit = F.when((F.col("gold") == F.col("pred")) & (F.col("side.g") > 0), F.col("n")).otherwise(0)
    by_label = counts.select(*by, "gold", "pred", "n", sides.alias("side")).groupBy(*by, "side.label").agg(F.sum("side.g").alias("g"), F.sum("side.p").alias("p"), F.sum(hit).alias("tp"))
    return by_label.groupBy(*by).agg(F.round(F.sum(ratio(2 * F.col("tp"), F.col("g") + F.col("p"))) / len(labels), 9).alias("macro_f1"), F.round(ratio(F.sum("tp"), F.sum("g")), 9).alias("accuracy"))


def best_temperature(rows: DataFrame, gold: str, temperatures: Sequence[float], probs: str = "probs", labels: Sequence[str] = LABELS) -> DataFrame:
    """(temperature, nll) of the least mean negative log-likelihood; one row, ties to the smaller temperature.

    All temperatures are sums over the rows in one pass, so nothing but their sums is shuffled.
    """
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(gold)).cast("int")
    loss = lambda t: F.avg(-F.ln(F.greatest(F.element_at(V.tempered(F.col(probs), t), place), F.lit(V.FLOOR))))
    sums = rows.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(temperatures)))
    each = F.explode(F.array(*(F.struct(F.round(f"t{i}", 9).alias("nll"), F.lit(float(t)).alias("temperature")) for i, t in enumerate(temperatures))))
    return sums.select(each.alias("x")).agg(F.min("x").alias("x")).select("x.temperature", "x.nll")


def safest(results: DataFrame, feasible: Column, order: Sequence[Column]) -> DataFrame:
    """One row: the best feasible one, or the best of all if none is."""
    return results.orderBy(F.desc(feasible), *order).limit(1)


def accepted(rows: DataFrame, family: str, local: str = "local_score", comparator: str = "comparator_score", llm: str = "llm_score", threshold: float = 0.5, relation_thresholds: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """``rows`` with ``accepted`` by one of five policies: local, comparator, llm, blend, both."""
    limit = F.lit(threshold)
    if relation_thresholds is not None:
        rows = rows.join(relation_thresholds.select("relation", F.col("threshold").alias("_t")), "relation", "left")
        limit = F.coalesce("_t", limit)
    test = {
        "local": F.col(local) >= limit,
        "comparator": F.col(comparator) >= limit,
        "llm": F.col(llm) >= limit,
        "blend": weight * F.col(local) + (1 - weight) * F.col(llm) >= limit,
        "both": (F.col(local) >= limit) & (F.col(llm) >= limit),
    }[family]
    out = rows.withColumn("accepted", test)
    return out.drop("_t") if relation_thresholds is not None else out


def reached(value: Column, points: Sequence[float]) -> Column:
    """How many of the points, in rising order, the value reaches."""
    return F.size(F.filter(F.array(*(F.lit(float(t)) for t in points)), lambda t: value >= t))


#: The grids of the five families of policies, as fractions.
LOCAL_GRID = [i / 40 for i in range(2, 39)]
RESCUE_MARGINS, VETO_MARGINS = [i / 20 for i in range(1, 7)], [0.0, 0.05, 0.10]
WEIGHTS, WEIGHTED_GRID = [i / 10 for i in range(11)], [i / 40 for i in range(4, 37)]
LOWER_GRID, UPPER_GRID = [i / 20 for i in range(2, 13)], [i / 20 for i in range(10, 20)]


def policy_search(rows: DataFrame, gold: str, local: str, llm: str, heuristic: str, label: str, threshold: str) -> DataFrame:
    """family, parameters, tp, fp, fn, precision, recall, f1 of every policy of five families.

    ``local_only``: a score against a threshold. ``local_relation_thresholds``: against the row's own.
    ``relation_threshold_llm_rescue_veto``: the row's own, but what a label accepts is rescued within a margin below, and
    what it rejects is vetoed within a margin above. ``weighted_score``: a weighted sum of three scores against a
    threshold. ``protected_local_gate``: above the upper threshold, or above the lower one if the label accepts.

    Rows are first counted in cells, by the points that their scores reach and their label; policies meet the cells,
    whose number the grids bound. Only the weighted sums are computed for each pair of weights, and counted in the task.
    """
    g, x, own = F.col(gold), F.col(local), F.col(threshold)
    n = F.count("*").alias("n")
    accepts = lambda plausible: (F.col("label") == "supported") | (plausible & (F.col("label") == "plausible"))
    name = lambda *parts: F.concat_ws(",", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("none"))) for k, v in parts))
    points = lambda values: F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(float(v)).alias("v")) for i, v in enumerate(values, 1))))
    flags = F.explode(F.array(F.lit(False), F.lit(True)))

    by_local = rows.groupBy(g.alias("gold"), reached(x, LOCAL_GRID).alias("r")).agg(n).select("*", points(LOCAL_GRID).alias("t"))
    one = by_local.select(F.lit("local_only").alias("family"), name(("threshold", F.col("t.v"))).alias("parameters"), "gold", (F.col("r") >= F.col("t.at")).alias("yes"), "n")

    base = rows.groupBy(g.alias("gold"), (x >= own).alias("base"), F.col(label).alias("label"), reached(-F.greatest(own - x, F.lit(0.0)), [-m for m in RESCUE_MARGINS[::-1]]).alias("rescue"), F.size(F.filter(F.array(*map(F.lit, VETO_MARGINS)), lambda m: x < own + m)).alias("veto")).agg(n)
    two = base.select(F.lit("local_relation_thresholds").alias("family"), F.lit("own").alias("parameters"), "gold", F.col("base").alias("yes"), "n")
    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("double").alias("v"))
    vetoes = F.explode(F.array(none, *(F.struct(F.lit(i).alias("at"), F.lit(v).alias("v")) for i, v in enumerate(VETO_MARGINS, 1))))
    each = base.select("*", points(RESCUE_MARGINS).alias("m")).select("*", vetoes.alias("o")).select("*", flags.alias("plausible"))
    # of the margins in rising order, those from the smallest sufficient one on rescue; a veto needs the score below its margin
    rescued = ~F.col("base") & accepts(F.col("plausible")) & (F.col("rescue") > len(RESCUE_MARGINS) - F.col("m.at"))
    vetoed = F.col("base") & (F.col("label") == "unsupported") & (F.col("o.at") > 0) & (F.col("veto") > len(VETO_MARGINS) - F.col("o.at"))
    three = each.select(F.lit("relation_threshold_llm_rescue_veto").alias("family"), name(("rescue", F.col("m.v")), ("plausible", F.col("plausible")), ("veto", F.col("o.v"))).alias("parameters"), "gold", ((F.col("base") | rescued) & ~vetoed).alias("yes"), "n")

    pairs = [(a, b, round(1 - a - b, 1)) for a in WEIGHTS for b in WEIGHTS if round(1 - a - b, 1) >= 0]
    weights = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in pairs)))
    mixed = F.col("w.a") * x + F.col("w.b") * F.col(llm) + F.col("w.c") * F.col(heuristic)
    sums = rows.select("*", weights.alias("w")).groupBy("w", g.alias("gold"), reached(F.round(mixed, 9), WEIGHTED_GRID).alias("r")).agg(n).select("*", points(WEIGHTED_GRID).alias("t"))
    four = sums.select(F.lit("weighted_score").alias("family"), name(("local", F.col("w.a")), ("llm", F.col("w.b")), ("heuristic", F.col("w.c")), ("threshold", F.col("t.v"))).alias("parameters"), "gold", (F.col("r") >= F.col("t.at")).alias("yes"), "n")

    gate = rows.groupBy(g.alias("gold"), F.col(label).alias("label"), reached(x, LOWER_GRID).alias("low"), reached(x, UPPER_GRID).alias("high")).agg(n)
    gate = gate.select("*", points(LOWER_GRID).alias("l")).select("*", points(UPPER_GRID).alias("u")).where(F.round(F.col("u.v") - F.col("l.v"), 6) >= 0.1).select("*", flags.alias("plausible"))
    open_ = (F.col("high") >= F.col("u.at")) | ((F.col("low") >= F.col("l.at")) & accepts(F.col("plausible")))
    five = gate.select(F.lit("protected_local_gate").alias("family"), name(("lower", F.col("l.v")), ("upper", F.col("u.v")), ("plausible", F.col("plausible"))).alias("parameters"), "gold", open_.alias("yes"), "n")

    every = one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = every.groupBy("family", "parameters").agg(count(F.col("gold") & F.col("yes")).alias("tp"), count(~F.col("gold") & F.col("yes")).alias("fp"), count(F.col("gold") & ~F.col("yes")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("*", F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))


def best_policy(policies: DataFrame) -> DataFrame:
    """The policy of the greatest (f1, recall, precision); ties go to the first family and parameters in order."""
    key = F.struct((-F.col("f1")).alias("a"), (-F.col("recall")).alias("b"), (-F.col("precision")).alias("c"), "family", "parameters", "tp", "fp", "fn", "f1", "recall", "precision")
    return policies.agg(F.min(key).alias("x")).select("x.family", "x.parameters", "x.tp", "x.fp", "x.fn", "x.precision", "x.recall", "x.f1")


def best_epoch(log: DataFrame, run: Sequence[str], epoch: str, score: str, patience: int, least: float = 1e-6) -> DataFrame:
    """``run``, best_epoch, best_score, last_epoch: a run ends when ``patience`` epochs in a row gain no more than ``least``.

    A run's epochs are folded in order; a null score gains nothing.
    """
    kind = "struct<best:double,at:long,waited:int,last:long>"
    start = F.struct(F.lit(None).alias("best"), F.lit(None).alias("at"), F.lit(0).alias("waited"), F.lit(None).alias("last")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        gains = F.coalesce(acc["best"].isNull() & x["score"].isNotNull() | (x["score"] > acc["best"] + least), F.lit(False))
        better = F.struct(x["score"].alias("best"), x["epoch"].alias("at"), F.lit(0).alias("waited"), x["epoch"].alias("last")).cast(kind)
        worse = F.struct(acc["best"].alias("best"), acc["at"].alias("at"), (acc["waited"] + 1).alias("waited"), x["epoch"].alias("last")).cast(kind)
        return F.when(acc["waited"] >= patience, acc).when(gains, better).otherwise(worse)

    rows = log.groupBy(*run).agg(F.sort_array(F.collect_list(F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(score).cast("double").alias("score")))).alias("log"))
    return rows.select(*run, F.aggregate("log", start, step).alias("r")).select(*run, F.col("r.at").alias("best_epoch"), F.col("r.best").alias("best_score"), F.col("r.last").alias("last_epoch"))
