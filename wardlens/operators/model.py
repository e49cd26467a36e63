"""Model fitting and evaluation on Spark ML.

Estimators train distributed (Spark ML); scoring returns a long
(key, label, score) table that the metric operators consume.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.operators import metrics as mt
from wardlens.operators import split as sp
from wardlens.session import kept


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Balanced weights n / (k n_c) as a column. Rows without a label cannot be fitted
    and are left out. The weights (one row per class) are broadcast: a join by label
    would put each class's rows in one task."""
    w = sp.class_weights(df.where(F.col(label).isNotNull()), label).select(label, F.col("weight").alias(name))
    return df.join(F.broadcast(w), label)


def spread(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` dealt evenly into tasks of about ``rows`` rows. Fits keep their input in
    memory, wider than it is stored (a forest holds a count per tree for every row), and
    read it once an iteration, task by task: so tasks are cut by rows, not by file size."""
    return df.repartition(max(1, -(-df.count() // rows)))


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


# Sizes are parameters; the defaults are 50 and 30 iterations, 20 boosting rounds of
# depth 3 and 100 trees of depth 5.
ESTIMATORS = {
    "logreg": lambda p: LogisticRegression(maxIter=p.get("maxIter", 50), regParam=p.get("regParam", 0.0),
                                           elasticNetParam=p.get("elasticNetParam", 0.0), weightCol="weight"),
    "svc": lambda p: LinearSVC(maxIter=p.get("maxIter", 30), regParam=p.get("regParam", 0.01), weightCol="weight"),
    "gbt": lambda p: GBTClassifier(maxIter=p.get("maxIter", 20), maxDepth=p.get("maxDepth", 3), weightCol="weight", seed=42),
    "rf": lambda p: RandomForestClassifier(numTrees=p.get("numTrees", 100), maxDepth=p.get("maxDepth", 5),
                                           weightCol="weight", seed=42),
}


#: Penalties of logistic regression.
PENALTIES = {
    "none": {"regParam": 0.0}, "l1": {"regParam": 0.01, "elasticNetParam": 1.0},
    "l2": {"regParam": 0.01, "elasticNetParam": 0.0}, "elastic_net": {"regParam": 0.01, "elasticNetParam": 0.5},
}


def positive_score(pred: DataFrame) -> F.Column:
    """Probability of class 1 when the model gives one, else the raw margin."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def fit_and_score(train: DataFrame, test: DataFrame, key: str, label: str, features: Sequence[str],
                  estimator: str = "logreg", params: dict | None = None) -> DataFrame:
    """Fit on ``train`` (balanced weights) and return (key, label, score) on ``test``."""
    est = ESTIMATORS[estimator](params or {}).setLabelCol(label).setFeaturesCol("features")
    model = est.fit(assemble(with_class_weight(spread(train.select(label, *features)), label), features))
    pred = model.transform(assemble(test, features))
    return pred.select(key, F.col(label).cast("int").alias("label"), positive_score(pred).alias("score"))


def fold_rows(train: DataFrame, key: str, label: str, features: Sequence[str], k: int) -> DataFrame:
    """(key, label, fold, features) of the stratified folds, for many fits: written
    once, so that the ranking of the rows runs once, and spread."""
    cols = dict.fromkeys([key, label, *features])
    folds = kept(sp.stratified_kfold(train.select(*cols), key, label, k), "folds")
    return assemble(spread(folds), features).select(key, label, "fold", "features")


def calibrated_scores(train: DataFrame, test: DataFrame, key: str, label: str, features: Sequence[str],
                      k: int = 5, estimator: str = "logreg") -> DataFrame:
    """Isotonic calibration on cross-validated folds: per fold, fit on the other
    folds, fit an isotonic map on the held-out scores, calibrate the test scores;
    the result is the mean of the k calibrated scores. Held-out scores are reduced to
    one weighted row per distinct score before the isotonic fit, and the test rows are
    scored by all folds in one pass, without joins. The folds are made once and kept."""
    folds = fold_rows(train.where(F.col(label).isNotNull()), key, label, features, k).persist()
    t = assemble(test, features).select(key, F.col(label).cast("int").alias("label"), "features")
    done: list[str] = []
    try:
        for f in range(k):
            fit_part = folds.where(F.col("fold") != f)
            held = folds.where(F.col("fold") == f)
            est = ESTIMATORS[estimator]({}).setLabelCol(label).setFeaturesCol("features")
            model = est.fit(with_class_weight(fit_part, label))
            h = model.transform(held)
            h = h.select(F.col(label).cast("double").alias("y"), positive_score(h).alias("s"))
            h = h.groupBy("s").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
            iso = IsotonicRegression(featuresCol="sv", labelCol="y", weightCol="w").fit(assemble(h, ["s"], "sv"))
            t = model.transform(t)
            t = t.select(key, "label", "features", *done, positive_score(t).alias("s"))
            t = iso.transform(assemble(t, ["s"], "sv"))
            t = t.select(key, "label", "features", *done, F.col("prediction").alias(f"p{f}"))
            done.append(f"p{f}")
    finally:
        folds.unpersist()
    mean = sum(F.col(p) for p in done) / F.lit(float(k))
    return t.select(key, "label", mean.alias("score"))


class AveragePrecisionEvaluator(Evaluator):
    """Exact average precision (step sum), larger is better."""

    def __init__(self, labelCol: str = "label", scoreCol: str = "score"):
        super().__init__()
        self.labelCol, self.scoreCol = labelCol, scoreCol

    def _evaluate(self, dataset: DataFrame) -> float:
        d = dataset.select(F.col(self.labelCol).cast("int").alias("label"), positive_score(dataset).alias("score"))
        v = mt.average_precision(d, "label", "score").first()[0]
        return float(v or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def tune(train: DataFrame, label: str, features: Sequence[str], key: str, k: int = 5,
         reg_params: Sequence[float] = (0.0, 0.1), elastic: Sequence[float] = (0.0, 0.5),
         parallelism: int = 2) -> DataFrame:
    """Grid search of logistic regression by cross-validated exact AP; folds are
    the stratified md5 folds. Returns one row per grid point with its mean AP."""
    folds = with_class_weight(fold_rows(train, key, label, features, k), label).persist()
    lr = LogisticRegression(maxIter=30, weightCol="weight", labelCol=label, featuresCol="features")
    grid = ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).addGrid(lr.elasticNetParam, list(elastic)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=AveragePrecisionEvaluator(labelCol=label),
                        numFolds=k, foldCol="fold", parallelism=parallelism, seed=42)
    try:
        model = cv.fit(folds)
    finally:
        folds.unpersist()
    rows = [(float(pm[lr.regParam]), float(pm[lr.elasticNetParam]), float(m))
            for pm, m in zip(grid, model.avgMetrics, strict=True)]
    return train.sparkSession.createDataFrame(rows, "reg_param double, elastic_net double, mean_ap double")


#: Search spaces: a list is chosen from, ("log", a, b) and ("uniform", a, b) are drawn from.
SPACES: dict[str, dict] = {
    "logreg": {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("uniform", 0.0, 1.0)},
    "svc": {"regParam": ("log", 1e-4, 1.0)},
    "gbt": {"maxDepth": [2, 3, 4], "maxIter": [10, 20, 30]},
    "rf": {"maxDepth": [3, 5, 7], "numTrees": [20, 50, 100]},
}


def draw_points(space: Mapping[str, object], n: int, seed: int = 42) -> list[dict]:
    """``n`` points of a search space, the same for the same seed."""
    rng = random.Random(seed)

    def one(x):
        if isinstance(x, tuple):
            kind, lo, hi = x
            return math.exp(rng.uniform(math.log(lo), math.log(hi))) if kind == "log" else rng.uniform(lo, hi)
        return rng.choice(list(x))
    return [{name: one(x) for name, x in sorted(space.items())} for _ in range(n)]


def halving_plan(n: int, keep: float, smallest: float) -> list[tuple[float, int]]:
    """(share of the training rows, number of points) of each rung: the share grows as the
    number of points falls, until the last rung has all rows."""
    plan, share = [], smallest
    while share < 1.0 and n > 1:
        plan.append((share, n))
        n, share = max(1, math.ceil(n * keep)), min(1.0, share / keep)
    return [*plan, (1.0, n)]


def successive_halving(train: DataFrame, label: str, features: Sequence[str], key: str, points: Sequence[Mapping],
                       estimator: str = "logreg", k: int = 5, keep: float = 0.5, smallest: float = 0.25) -> tuple[dict, DataFrame]:
    """The best of ``points`` by cross-validated exact average precision, and the history.

    Rung by rung, every surviving point is fitted per fold on a share of the rows outside
    the fold (those with the smallest hash of their key, so a rung's rows contain the last
    rung's), and all points score all held-out rows of all folds in one table, evaluated
    by one set of running sums keyed by (point, fold). The better ``keep`` share goes on.
    The history has a row per rung and point: rung, share, point, params, mean_ap, kept.
    Rows without a label take no part. Ties go to the earlier point."""
    spark = train.sparkSession
    folds = fold_rows(train.where(F.col(label).isNotNull()), key, label, features, k)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("rung|"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    data = folds.withColumn("_u", draw).persist()
    alive, history, best = list(range(len(points))), [], None
    try:
        for rung, (share, n) in enumerate(halving_plan(len(points), keep, smallest)):
            parts = []
            for f in range(k):
                fit_part = with_class_weight(data.where((F.col("fold") != f) & (F.col("_u") < share)), label)
                held, names = data.where(F.col("fold") == f), []
                for i in alive:
                    est = ESTIMATORS[estimator](dict(points[i])).setLabelCol(label).setFeaturesCol("features")
                    scored = est.fit(fit_part).transform(held)
                    held = scored.select(key, label, "fold", "features", *names, positive_score(scored).alias(f"_p{i}"))
                    names.append(f"_p{i}")
                each = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.col(f"_p{i}").alias("score")) for i in alive]))
                parts.append(held.select("fold", F.col(label).cast("int").alias("label"), each.alias("x")).select("fold", "label", "x.*"))
            long = parts[0]
            for p in parts[1:]:
                long = long.unionByName(p)
            c = mt.curve(mt.score_table(long, "label", "score", group=["point", "fold"]), ["point", "fold"])
            per = mt.ranking_from_curve(c, ["point", "fold"]).groupBy("point").agg(F.avg("avg_precision").alias("ap"))
            ap = {r["point"]: float(r["ap"] or 0.0) for r in per.collect()}  # one row per point
            order = sorted(alive, key=lambda i: (-ap.get(i, 0.0), i))
            last = share >= 1.0
            left = order[:1] if last else order[:max(1, math.ceil(n * keep))]
            history += [(rung, float(share), i, json.dumps(dict(points[i]), sort_keys=True), ap.get(i, 0.0), i in left) for i in alive]
            alive, best = left, left[0]
    finally:
        data.unpersist()
    table = spark.createDataFrame(history, "rung int, share double, point int, params string, mean_ap double, kept boolean")
    return {**points[best]}, table


def with_tokens(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the lower-cased runs of letters and digits of ``text`` (none if null)."""
    return df.withColumn(name, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def text_scores(train: DataFrame, test: DataFrame, key: str, text: str, label: str,
                num_features: int = 1 << 16) -> DataFrame:
    """Hashed term frequencies + IDF + weighted logistic regression on whole texts."""
    tok = lambda df: with_tokens(df, text, "_tokens")
    pipe = Pipeline(stages=[HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="features"),
                            LogisticRegression(maxIter=30, regParam=0.01, weightCol="weight", labelCol=label)])
    model = pipe.fit(with_class_weight(tok(train), label))
    pred = model.transform(tok(test))
    return pred.select(key, F.col(label).cast("int").alias("label"), positive_score(pred).alias("score"))
