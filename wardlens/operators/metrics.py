"""Ranking and classification metrics (E1-E6) as aggregates.

Scores are first reduced to one row per distinct score (partial aggregate), so
ties are handled exactly and the running sums in score order run over the
distinct scores only, via the two-phase ``ranking.running_sums``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.operators.ranking import ranks, running_sums

DIGITS = 9


def score_table(df: DataFrame, label: str, score: str, weight: Column | None = None,
                group: Sequence[str] = ()) -> DataFrame:
    """(group..., score, pos, neg) with (weighted) positive / negative counts."""
    w = weight if weight is not None else F.lit(1.0)
    y = F.col(label).cast("double")
    return df.groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(w * y).alias("pos"), F.sum(w * (F.lit(1.0) - y)).alias("neg"))


def curve(st: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Adds tp / fp = positives / negatives with score >= this score, for every
    distinct score."""
    c = running_sums(st.withColumn("_desc", -F.col("score")), ["_desc"],
                     {"pos": F.col("pos"), "neg": F.col("neg")}, list(group))
    return c.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"}).drop("_desc")


def _auroc() -> Column:
    """Area under the ROC curve, ties counted half."""
    term = F.col("neg") * (F.col("tp") - F.lit(0.5) * F.col("pos"))
    return F.round(F.sum(term) / (F.sum("pos") * F.sum("neg")), DIGITS).alias("auroc")


def _auroc_or_null() -> Column:
    """As ``_auroc``; null where a class is absent."""
    term = F.col("neg") * (F.col("tp") - F.lit(0.5) * F.col("pos"))
    return F.round(F.sum(term) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0)), DIGITS).alias("auroc")


def _average_precision() -> Column:
    """Sum over thresholds of recall step x precision."""
    term = F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    return F.round(F.sum(term) / F.nullif(F.sum("pos"), F.lit(0.0)), DIGITS).alias("avg_precision")


def ranking_from_curve(c: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """AUROC and AP of each group's curve, in one aggregate."""
    return c.groupBy(*group).agg(_auroc(), _average_precision())


def ranking_summary(df: DataFrame, label: str, score: str) -> DataFrame:
    """AUROC and AP from one curve (one pass of running sums)."""
    return ranking_from_curve(curve(score_table(df, label, score)))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_summary(df, label, score).select("auroc")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_summary(df, label, score).select("avg_precision")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the start point at
    max score + 1 where nothing is predicted positive."""
    st = score_table(df, label, score)
    total = st.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).withColumn("_one", F.lit(1))
    c = curve(st).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    pts = c.select(F.col("score").alias("threshold"), F.round(F.col("fp") / F.col("N"), DIGITS).alias("fpr"),
                   F.round(F.col("tp") / F.col("P"), DIGITS).alias("tpr"))
    start = df.agg((F.max(score) + 1).cast("double").alias("threshold")).select(
        "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def threshold_at_fpr(df: DataFrame, label: str, score: str, target: float = 0.15) -> DataFrame:
    """The ROC threshold whose false-positive rate is nearest ``target``; on a tie
    the higher threshold wins. One row."""
    r = roc_curve(df, label, score)
    return (r.orderBy(F.abs(F.col("fpr") - F.lit(target)), F.desc("threshold")).limit(1)
            .select("threshold", "fpr", "tpr"))


def class_counts(df: DataFrame, y: str, yhat: str) -> dict:
    yt, yp = F.col(y) == 1, F.col(yhat) == 1
    return {"tp": F.count_if(yt & yp), "fp": F.count_if(~yt & yp), "fn": F.count_if(yt & ~yp),
            "tn": F.count_if(~yt & ~yp)}


def class_metrics(df: DataFrame, y: str, yhat: str, beta: float = 2.0) -> DataFrame:
    """Accuracy, precision, recall, F1 and F-beta of 0/1 predictions (0 when undefined)."""
    c = df.agg(*[v.alias(k) for k, v in class_counts(df, y, yhat).items()])
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    prec = F.coalesce(tp / F.nullif(tp + fp, F.lit(0.0)), F.lit(0.0))
    rec = F.coalesce(tp / F.nullif(tp + fn, F.lit(0.0)), F.lit(0.0))
    b2 = beta * beta
    fb = lambda b: F.coalesce((1 + b) * prec * rec / F.nullif(b * prec + rec, F.lit(0.0)), F.lit(0.0))
    return c.select(F.round((tp + tn) / (tp + fp + fn + tn), DIGITS).alias("accuracy"),
                    F.round(prec, DIGITS).alias("precision"), F.round(rec, DIGITS).alias("recall"),
                    F.round(fb(1.0), DIGITS).alias("f1"), F.round(fb(b2), DIGITS).alias(f"f{int(beta)}"))


def poisson_cdf(mean: int) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it is 1 to within 1e-12."""
    out, term = [], math.exp(-mean)
    while not out or 1 - out[-1] > 1e-12 and len(out) < 12 * mean + 20:
        out.append((out[-1] if out else 0.0) + term)
        term *= mean / len(out)
    return out


def alias_table(mean: int) -> tuple[list[float], list[int]]:
    """Alias method for Poisson(mean): a uniform number picks a place and the rest of it
    decides between the place and its alias, so a draw is one look-up."""
    cdf = poisson_cdf(mean)
    p = [b - a for a, b in zip([0.0, *cdf], [*cdf, 1.0])]
    n = len(p)
    prob, alias = [x * n for x in p], list(range(n))
    small, large = [i for i in range(n) if prob[i] < 1], [i for i in range(n) if prob[i] >= 1]
    while small and large:
        i, k = small.pop(), large.pop()
        alias[i] = k
        prob[k] -= 1 - prob[i]
        (small if prob[k] < 1 else large).append(k)
    for i in small + large:
        prob[i] = 1.0
    return prob, alias


#: Means that are drawn by their alias table; their binary sums give 0..15.
POISSON = {j: alias_table(j) for j in (1, 2, 4, 8)}


def with_poisson(df: DataFrame, n: str, key: str, name: str) -> DataFrame:
    """Adds ``name``: a Poisson(n) draw that depends on the text ``key`` alone.

    n independent Poisson(1) weights sum to Poisson(n). Below 16 it is the sum of the
    draws for the binary digits of n; from 16 up the rounded normal approximation.
    Uniform numbers are the four 32-bit pieces of md5(key)."""
    df = df.withColumn("_h", F.md5(key))
    df = df.withColumns({f"_u{i}": F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") / 4294967296.0 for i in range(4)})

    def draw(u: Column, table: tuple[list[float], list[int]]) -> Column:
        prob, alias = table
        x = u * len(prob)
        i = F.floor(x).cast("int")
        return F.when(x - i < F.get(F.array(*[F.lit(p) for p in prob]), i), i).otherwise(F.get(F.array(*[F.lit(a) for a in alias]), i))

    small = sum((F.when(F.col(n).cast("long").bitwiseAND(j) > 0, draw(F.col(f"_u{i}"), t)).otherwise(F.lit(0))
                 for i, (j, t) in enumerate(POISSON.items())), F.lit(0))
    z = F.sqrt(-2 * F.ln(1 - F.col("_u0"))) * F.cos(2 * math.pi * F.col("_u1"))
    large = F.greatest(F.lit(0.0), F.floor(F.col(n) + F.sqrt(F.col(n).cast("double")) * z + 0.5).cast("double"))
    draw_ = F.when(F.col(n) < 16, small.cast("double")).otherwise(large)
    return df.withColumn(name, draw_).drop("_h", *[f"_u{i}" for i in range(4)])


def bootstrap_ci(df: DataFrame, label: str, score: str, n_resamples: int = 999, alpha: float = 0.05) -> DataFrame:
    """Paired percentile interval of AUROC and AP by the Poisson bootstrap.

    Rows are first reduced to one per distinct score with its positives and negatives;
    a replicate then draws how often each of the two counts occurs. So the work is
    replicates x distinct scores, whatever the number of rows."""
    return bootstrap_cells(score_table(df.where(F.col(label).isNotNull()), label, score), (), n_resamples, alpha)


def bootstrap_cells(st: DataFrame, cell: Sequence[str] = (), n_resamples: int = 999, alpha: float = 0.05) -> DataFrame:
    """``bootstrap_ci`` of every cell of ``st`` (cell..., score, pos, neg) at once: replicates of
    all cells share one set of running sums keyed by cell and replicate. A draw depends on
    the cell, the score's place among the cell's distinct scores (from the highest) and the
    replicate, so scores however near have draws of their own."""
    by = list(cell)
    place = ranks(st.withColumn("_down", -F.col("score")), ["_down"], by, "_place").drop("_down")
    # distinct scores may fit one task; their replicates need all
    place = place.repartition(int(st.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_place")
    rep = place.select(*by, "score", "pos", "neg", "_place", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("b"))
    tag = F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.col("_place").cast("string"), F.col("b").cast("string"))
    rep = rep.withColumns({"_kp": F.concat(tag, F.lit("|1")), "_kn": F.concat(tag, F.lit("|0"))})
    rep = with_poisson(with_poisson(rep, "pos", "_kp", "wp"), "neg", "_kn", "wn")
    rep = rep.select(*by, "b", "score", F.col("wp").alias("pos"), F.col("wn").alias("neg"))
    c = curve(rep, [*by, "b"])
    per_b = c.groupBy(*by, "b").agg(_auroc_or_null(), _average_precision())
    lo, hi = alpha / 2, 1 - alpha / 2
    return per_b.groupBy(*by).agg(F.round(F.percentile("auroc", lo), DIGITS).alias("auroc_lower"),
                                  F.round(F.percentile("auroc", hi), DIGITS).alias("auroc_upper"),
                                  F.round(F.percentile("avg_precision", lo), DIGITS).alias("ap_lower"),
                                  F.round(F.percentile("avg_precision", hi), DIGITS).alias("ap_upper"))
