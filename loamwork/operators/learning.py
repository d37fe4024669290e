"""Linear models through MLlib: one against the rest, and a cascade of three decisions.

Coefficients differ from other libraries' solvers; the estimators are the same. Text enters as hashed character n-grams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.functions import text as X
from loamwork.functions import vectors as V
from loamwork.operators.decide import counted_scores
from loamwork.sources.staging import staged


def with_frequent(train: DataFrame, rows: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """``rows`` with nulls of the categories replaced by the most frequent value in ``train``, the first in order on ties."""
    filled = {}
    for c in categorical:
        best = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
        if best is not None:
            filled[c] = best[0]
    return rows.na.fill(filled) if filled else rows


def frame_stages(categorical: Sequence[str], numeric: Sequence[str], out: str = "features") -> list:
    """Median imputation and scaling of numbers, one-hot columns of categories, unseen ones apart."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep") for c in categorical]
    stages += [OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical])] if categorical else []
    filled = [f"{c}_m" for c in numeric]
    stages += [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)] if numeric else []
    return [*stages, VectorAssembler(inputCols=[*(["_scaled"] if numeric else []), *(f"{c}_v" for c in categorical)], outputCol=out)]


def text_features(rows: DataFrame, text_col: str, low: int = 1, high: int = 3, size: int = 1 << 14, out: str = "features") -> DataFrame:
    grams = rows.withColumn("_grams", X.all_ngrams(F.coalesce(F.col(text_col), F.lit("")), low, high))
    return HashingTF(inputCol="_grams", outputCol=out, numFeatures=size).transform(grams).drop("_grams")


def balanced(rows: DataFrame, positive: str) -> DataFrame:
    """``rows`` with ``weight``: both classes weigh the same in sum."""
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("double")).alias("p")).first()
    p = n["p"] or 0.0
    return rows.withColumn("weight", F.when(F.col(positive), n["n"] / (2 * p) if p else 0.0).otherwise(n["n"] / (2 * (n["n"] - p)) if n["n"] > p else 0.0))


def binary(rows: DataFrame, positive: str, c: float = 1.0, features: str = "features"):
    """Balanced logistic regression of a boolean column; ``c`` is the inverse strength of its penalty."""
    ready = balanced(rows, positive).withColumn("_y", F.col(positive).cast("double"))
    if "_own" in rows.columns:
        ready = ready.withColumn("weight", F.col("weight") * F.col("_own"))
    return LogisticRegression(featuresCol=features, labelCol="_y", weightCol="weight", regParam=1.0 / (c * max(1, ready.count())), maxIter=100).fit(ready)


def probability(model, rows: DataFrame, name: str) -> DataFrame:
    out = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction")


def one_against_rest(train: DataFrame, rows: DataFrame, label: str, labels: Sequence[str], c: float = 1.0) -> DataFrame:
    """``rows`` with ``probs``, the models' probabilities brought to sum one."""
    out = rows
    for i, name in enumerate(labels):
        out = probability(binary(train.withColumn("_is", F.col(label) == name), "_is", c), out, f"_p{i}")
    total = sum((F.col(f"_p{i}") for i in range(1, len(labels))), F.col("_p0"))
    return out.withColumn("probs", F.array(*(F.col(f"_p{i}") / total for i in range(len(labels))))).drop(*(f"_p{i}" for i in range(len(labels))))


def cascade(train: DataFrame, rows: DataFrame, label: str, labels: Sequence[str], c: float = 1.0, omitted: DataFrame | None = None, omitted_weight: float = 0.5, weight: str | None = None) -> DataFrame:
    """``rows`` with ``probs`` from three decisions: a type error, else too little context, else supported.

    ``omitted``: rows whose evidence was left out, with the columns of ``train``; they teach the second decision that
    the context is too little, each with ``omitted_weight``. ``weight``: a column of weights of the rows of ``train``.
    """
    own = F.col(weight) if weight else F.lit(1.0)
    train = train.withColumn("_own", own.cast("double"))
    error = binary(train.withColumn("_is", F.col(label) == labels[3]), "_is", c)
    rest = train.where(F.col(label) != labels[3])
    judged_rows = rest.withColumn("_is", F.col(label) == labels[2])
    if omitted is not None:
        more = omitted.withColumn("_own", F.lit(float(omitted_weight))).withColumn("_is", F.lit(True))
        judged_rows = judged_rows.unionByName(more.select(*judged_rows.columns))
    context = binary(judged_rows, "_is", c)
    support = binary(rest.where(F.col(label) != labels[2]).withColumn("_is", F.col(label) == labels[0]), "_is", c)
    out = probability(support, probability(context, probability(error, rows, "_e"), "_i"), "_s")
    judged = (1 - F.col("_e")) * (1 - F.col("_i"))
    probs = F.array(judged * F.col("_s"), judged * (1 - F.col("_s")), (1 - F.col("_e")) * F.col("_i"), F.col("_e"))
    return out.withColumn("probs", probs).drop("_e", "_i", "_s")


def fit_frame(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> PipelineModel:
    return Pipeline(stages=frame_stages(categorical, numeric)).fit(train)


def forest_ensemble(train: DataFrame, rows: DataFrame, label: str, labels: Sequence[str], seeds: Sequence[int] = (11, 23, 37, 53, 71), trees: int = 50, depth: int = 8, features: str = "features") -> DataFrame:
    """``rows`` with ``probs``: the mean over seeds of a random forest's probabilities.

    Trees choose their thresholds by impurity, as MLlib has no trees with random ones; the ensemble is the same otherwise.
    """
    index = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("double") - 1
    ready = train.withColumn("_y", index).where(F.col("_y") >= 0)
    out, names = rows, []
    for i, seed in enumerate(seeds):
        model = RandomForestClassifier(featuresCol=features, labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(ready)
        name = f"_f{i}"
        names.append(name)
        out = model.transform(out).withColumn(name, vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    seen = lambda v, k: F.coalesce(F.get(v, F.lit(k)), F.lit(0.0))
    mean = F.array(*(sum((seen(F.col(n), k) for n in names[1:]), seen(F.col(names[0]), k)) / len(names) for k in range(len(labels))))
    return out.withColumn("probs", mean).drop(*names)


def selected_penalty(rows: DataFrame, label: str, labels: Sequence[str], fold: str, grid: Sequence[float] = (0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """(c, macro_f1, accuracy) of one-against-rest models, each fold predicted by a model of the other folds; the best first.

    Folds hold whole groups (``splits.group_folds``). Ties go to the smaller ``c``. Rows are staged slim, so that the passes
    of a fit have the few tasks that these files fill, each of which reports to the driver.
    """
    rows = staged(rows.select(fold, label, "features"), "penalty-rows")
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    scored = None
    for c in grid:
        for k in folds:
            part = one_against_rest(rows.where(F.col(fold) != k), rows.where(F.col(fold) == k), label, labels, c)
            part = part.select(F.lit(float(c)).alias("c"), F.col(label).alias("gold"), V.argmax(F.col("probs"), labels).alias("pred"))
            scored = part if scored is None else scored.unionByName(part)
    counts = scored.groupBy("c", "gold", "pred").agg(F.count("*").alias("n"))
    return counted_scores(counts, ["c"], labels).orderBy(F.desc("macro_f1"), "c")
