"""Experiment grids (M22): estimators x resamplers x feature sets x outcome thresholds.

A grid is a list of cells without the pairs that make no sense. All cells are evaluated
together: scores become one table of (cell, distinct score, positives, negatives), and one
set of running sums keyed by cell gives every cell's curve, threshold, class metrics and
bootstrap interval. Adding a cell adds rows to a shuffle, not a job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.operators import metrics as mt

CELL = ["estimator", "resampler", "features", "outcome_within"]
NO_RESAMPLER = "none"


def legal_cells(estimators: Mapping[str, bool], resamplers: Sequence[str], features: Mapping[str, Sequence[str]],
                within: Sequence[float], categorical: Sequence[str] = ()) -> list[dict]:
    """The cells of a grid. ``estimators`` says which ones learn from one class alone: they
    and feature sets made of ``categorical`` columns only take no resampler."""
    levels_only = {n for n, cols in features.items() if set(cols) <= set(categorical)}
    return [dict(zip(CELL, cell)) for cell in product(estimators, resamplers, features, within)
            if cell[1] == NO_RESAMPLER or not (estimators[cell[0]] or cell[2] in levels_only)]


def cell_table(spark: SparkSession, cells: Sequence[Mapping], features: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per cell, numbered from 0, with its number of features."""
    rows = [(i, *[c[x] for x in CELL[:3]], float(c["outcome_within"]), len(features[c["features"]])) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "cell int, estimator string, resampler string, features string, outcome_within double, n_features int")


def level_counts(df: DataFrame, levels: Mapping[str, Column], labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, level, n, pos_0, pos_1, ...): rows and positives of each label per level
    of every feature, counted in one pass."""
    kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(c.cast("string"), F.lit("NA")).alias("level"))
                             for f, c in levels.items()]))
    long = df.select(*by, *labels, kv.alias("kv")).select(*by, *labels, "kv.*")
    return long.groupBy(*by, "feature", "level").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(y).cast("long")).alias(f"pos_{i}") for i, y in enumerate(labels)])


def _value(cell: Mapping, i: int, rows: int, positives: int) -> Column:
    """What a level adds to a row's score: its event rate, the rate with both classes weighing
    the same, or how rare it is among negatives."""
    n, pos = F.col("n"), F.col(f"pos_{i}")
    p, q = F.lit(float(max(positives, 1))), F.lit(float(max(rows - positives, 1)))
    if cell["estimator"] == "rarity":
        return 1 - (n - pos) / q
    if cell["resampler"] == "balanced":
        return pos / p / (pos / p + (n - pos) / q)
    return pos / n


#: Level-wise estimators: event rate (naive Bayes without logarithms), and a one-class
#: estimator that learns what is usual from negatives.
LEVEL_ESTIMATORS = {"rate": False, "rarity": True}
LEVEL_RESAMPLERS = [NO_RESAMPLER, "balanced"]


def level_scores(train: DataFrame, test: DataFrame, key: str, levels: Mapping[str, Column], labels: Mapping[float, str],
                 cells: Sequence[Mapping], features: Mapping[str, Sequence[str]]) -> DataFrame:
    """(cell, score, pos, neg) of the test rows: every cell fitted on the level counts of one
    pass over ``train`` and applied in one pass over ``test``. A row's score is the mean over the
    cell's features of its levels' values; levels not seen in training add nothing."""
    names = list(labels.values())
    at = {w: i for i, w in enumerate(labels)}
    counts = level_counts(train, levels, names)
    total = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(y).cast("long")).alias(y) for y in names]).first()  # one row
    values = [_value(c, at[c["outcome_within"]], total["n"], total[labels[c["outcome_within"]]] or 0).alias(f"v{j}")
              for j, c in enumerate(cells)]
    fitted = counts.select("feature", "level", *values)
    kv = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(c.cast("string"), F.lit("NA")).alias("level"))
                             for f, c in levels.items()]))
    long = test.select(key, *names, kv.alias("kv")).select(key, *names, "kv.*").join(fitted, ["feature", "level"], "left")
    sums = [F.sum(F.when(F.col("feature").isin(list(features[c["features"]])), F.col(f"v{j}"))).alias(f"s{j}") for j, c in enumerate(cells)]
    wide = long.groupBy(key, *names).agg(*sums)
    scored = F.explode(F.array(*[F.struct(
        F.lit(j).alias("cell"), F.round(F.coalesce(f"s{j}", F.lit(0.0)) / len(features[c["features"]]), 6).alias("score"),
        F.col(labels[c["outcome_within"]]).cast("int").alias("label")) for j, c in enumerate(cells)]))
    return mt.score_table(wide.select(scored.alias("x")).select("x.*"), "label", "score", group=["cell"])


def evaluate_cells(st: DataFrame, cell: Sequence[str] = ("cell",), target: float = 0.05, n_resamples: int = 0,
                   beta: float = 2.0) -> DataFrame:
    """One row per cell of ``st`` (cell..., score, pos, neg; one row per distinct score): auroc,
    avg_precision, the threshold whose false-positive rate is nearest ``target`` (ties to the
    higher one) and accuracy, precision, recall and F-beta of scores above it; with
    ``n_resamples`` also percentile intervals. A cell of one class has no auroc."""
    by = list(cell)
    total = st.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.max("score").alias("_top"))
    c = mt.curve(st, by).join(total, by)  # one row a cell: the planner broadcasts it
    fpr = F.round(F.col("fp") / F.nullif(F.col("N"), F.lit(0.0)), mt.DIGITS)
    near = F.min(F.struct(F.abs(fpr - F.lit(target)).alias("off"), (-F.col("score")).alias("down"),
                          (F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp")))
    out = c.groupBy(*by, "P", "N", "_top").agg(mt._auroc_or_null(), mt._average_precision(), near.alias("_best"))
    start = F.coalesce(F.lit(target) <= F.col("_best.off"), F.lit(True))  # nothing above the largest score
    tp, fp = (F.when(start, F.lit(0.0)).otherwise(F.col(f"_best.{x}")) for x in ("tp", "fp"))
    out = out.withColumns({"threshold": F.when(start, F.col("_top") + 1).otherwise(-F.col("_best.down")), "_tp": tp, "_fp": fp})
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({"_prec": ratio(F.col("_tp"), F.col("_tp") + F.col("_fp")), "_rec": ratio(F.col("_tp"), F.col("P"))})
    b2 = beta * beta
    out = out.select(*by, (F.col("P") + F.col("N")).cast("long").alias("n"), F.col("P").cast("long").alias("n_events"), "auroc", "avg_precision",
                     "threshold", F.round((F.col("_tp") + F.col("N") - F.col("_fp")) / (F.col("P") + F.col("N")), mt.DIGITS).alias("accuracy"),
                     F.round("_prec", mt.DIGITS).alias("precision"), F.round("_rec", mt.DIGITS).alias("recall"),
                     F.round(ratio((1 + b2) * F.col("_prec") * F.col("_rec"), b2 * F.col("_prec") + F.col("_rec")), mt.DIGITS).alias(f"f{int(beta)}"))
    return out.join(mt.bootstrap_cells(st, by, n_resamples), by, "left") if n_resamples else out
