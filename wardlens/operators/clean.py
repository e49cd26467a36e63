"""Measurement repair with score <-> value back-fill.

Each repair is a single projection. The two that need a statistic of the whole
column (3-sigma outlier bound, top-n device levels) take it as a parameter and
have a ``fit_*`` helper that computes it with one aggregate, so a pipeline can
gather all its statistics in one job and apply them as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions import news as nw
from wardlens.functions import repair as rp
from wardlens.functions.codes import COPD_CODES, NIV_PROCEDURE


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def recompute_total(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Replace the total by the sum of its parts when all parts are present and the
    total is missing or disagrees."""
    s = None
    for p in parts:
        s = F.col(p) if s is None else s + F.col(p)
    all_present = F.lit(True)
    for p in parts:
        all_present = all_present & F.col(p).isNotNull()
    t = F.col(total)
    fix = all_present & (t.isNull() | (t != s))
    return df.withColumn(total, F.when(fix, s).otherwise(t))


def _backfill(df: DataFrame, value: str, score: str, cleaned, to_value, to_score) -> DataFrame:
    """Write the cleaned reading to a helper column first, then let reading and
    score fill each other. Staging keeps later steps referring to a column
    instead of re-inlining the cleaning expression at every use."""
    staged = df.withColumn("_clean", cleaned)
    v, sc = F.col("_clean"), F.col(score)
    return staged.withColumns({
        value: F.when(v.isNull() & sc.isNotNull(), to_value(sc)).otherwise(v),
        score: F.when(sc.isNull() & v.isNotNull(), to_score(v)).otherwise(sc),
    }).drop("_clean")


def repair_bp(df: DataFrame, sys: str, dia: str, score: str) -> DataFrame:
    """Signs fixed; diastolic outside (20, 200) and systolic outside (40, 300) or
    not above diastolic + 5 deleted; then score and reading fill each other."""
    staged = df.withColumns({dia: rp.clip_sentinel(rp.invert_negatives(dia), 20, 200),
                             "_s0": rp.invert_negatives(sys)})
    s0, d = F.col("_s0"), F.col(dia)
    bad = F.coalesce((s0 <= 40) | (s0 >= 300) | (s0 <= d + 5), F.lit(False))
    cleaned = F.when(bad, F.lit(None)).otherwise(s0)
    return _backfill(staged, sys, score, cleaned, nw.systolic_value, nw.systolic_score).drop("_s0")


def repair_resp(df: DataFrame, rate: str, score: str) -> DataFrame:
    """Sign fixed, triple digits floor-divided by 10, outside (5, 80) deleted, then
    back-fill both ways."""
    staged = df.withColumn("_r1", rp.shift_triple(rp.invert_negatives(rate), integer=True))
    cleaned = rp.clip_sentinel("_r1", 5, 80)
    return _backfill(staged, rate, score, cleaned, nw.respiration_value, nw.respiration_score).drop("_r1")


def repair_temp(df: DataFrame, value: str, score: str) -> DataFrame:
    """Outside [25, 45] deleted (negative readings thus become null), then back-fill."""
    return _backfill(df, value, score, rp.clip_sentinel(value, 25, 45, inclusive=False),
                     nw.temperature_value, nw.temperature_score)


def repair_hr(df: DataFrame, value: str, score: str) -> DataFrame:
    return _backfill(df, value, score, rp.clip_sentinel(value, 25, 300, inclusive=False),
                     nw.heart_rate_value, nw.heart_rate_score)


def repair_flag_score(df: DataFrame, flag: str, score: str, true_score: float, false_score: float,
                      invalid: float = 1.0) -> DataFrame:
    """Flag <-> score: an impossible score is deleted, a missing score is filled
    from the flag, then the flag is re-derived from the score (the score wins)."""
    staged = df.withColumn("_sc0", F.when(F.col(score) == F.lit(invalid), F.lit(None)).otherwise(F.col(score)))
    sc0, fl = F.col("_sc0"), F.col(flag)
    staged = staged.withColumn(score, F.when(sc0.isNull() & fl.isNotNull(),
                                             F.when(fl, F.lit(true_score)).otherwise(F.lit(false_score))).otherwise(sc0))
    sc = F.col(score)
    return staged.withColumn(flag, F.when(sc == F.lit(true_score), F.lit(True))
                             .when(sc == F.lit(false_score), F.lit(False))).drop("_sc0")


def repair_consciousness(df: DataFrame, alert: str, score: str) -> DataFrame:
    """Not alert <-> score 3, alert <-> 0 (stored as the alert flag)."""
    staged = df.withColumn("_not_alert", ~F.col(alert))
    out = repair_flag_score(staged, "_not_alert", score, 3.0, 0.0)
    return out.withColumn(alert, ~F.col("_not_alert")).drop("_not_alert")


def repair_device_air(df: DataFrame, assisted: str, score: str) -> DataFrame:
    """Assisted True <-> score 2, False <-> 0."""
    return repair_flag_score(df, assisted, score, 2.0, 0.0)


def device_consistency(df: DataFrame, device: str, assisted: str, air: str = "A - Air",
                       other: str = "Other") -> DataFrame:
    """A real device (not air) implies assisted breathing; assisted breathing with
    air or no device recorded reads as 'Other'. A missing flag reads as false."""
    d = F.col(device)
    a0 = F.coalesce(F.col(assisted), F.lit(False))
    out = df.withColumn(assisted, F.when(d.isNotNull() & (d != F.lit(air)) & ~a0, F.lit(True)).otherwise(F.col(assisted)))
    a1 = F.col(assisted)
    return out.withColumn(device, F.when(F.coalesce(a1, F.lit(False)) & F.coalesce((d == F.lit(air)) | d.isNull(), F.lit(False)),
                                         F.lit(other)).otherwise(d))


def repair_device(df: DataFrame, device: str, assisted: str, n: int = 16,
                  levels: Sequence[str] | None = None, other: str = "Other") -> DataFrame:
    """Device levels: 'other; nhf...' -> NHF, values outside the ``n`` most frequent
    (fitted after the NHF merge, or the stored ``levels``) -> Other, then the
    device/assisted consistency rules."""
    merged = df.withColumn(device, nhf_merged(device))
    kept = topn_keep(merged, device, n, sentinel=other, levels=levels)
    return device_consistency(kept, device, assisted, other=other)


def nhf_merged(device: str):
    d = F.col(device)
    return F.when(F.coalesce(F.lower(d).startswith("other; nhf"), F.lit(False)), F.lit("NHF")).otherwise(d)


def fit_sigma_bound(df: DataFrame, cols: Sequence[str], k: float = 3.0) -> float | None:
    """mean - k * sample std pooled over ``cols`` (one aggregate, one row back)."""
    if len(cols) == 1:
        vals = df.select(F.col(cols[0]).alias("v"))
    else:
        vals = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    r = vals.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    if r["m"] is None or r["s"] is None:
        return None
    return r["m"] - k * r["s"]


def repair_o2(df: DataFrame, sat: str, score: str, assisted: str, device: str,
              diagnoses: Sequence[str], procedures: Sequence[str], bound: float | None) -> DataFrame:
    """Oxygen saturation: sign fixed, zero deleted, <= 10 times 10; outliers (> 100
    or <= ``bound``) deleted, except scale-2 patients scored 0 who get 92; then
    reading and score fill each other on the patient's scale. ``bound`` is mean -
    k*std of the sign/zero/scale-fixed reading (``fit_sigma_bound`` on
    ``o2_prepared``)."""
    copd = F.lit(False)
    for d in diagnoses:
        copd = copd | F.coalesce(F.col(d).isin(COPD_CODES), F.lit(False))
    niv = F.lit(False)
    for p in procedures:
        niv = niv | F.coalesce(F.col(p) == NIV_PROCEDURE, F.lit(False))
    out = df.withColumns({"_s1": o2_prepared(sat), "_copd": copd})
    s1, dev, sc = F.col("_s1"), F.col(device), F.col(score)
    outlier = F.coalesce((s1 > 100) | (s1 <= F.lit(bound)), F.lit(False)) if bound is not None else \
        F.coalesce(s1 > 100, F.lit(False))
    out = out.withColumns({
        "_out": outlier,
        "_scale2": (niv | F.coalesce(dev == "NIV - NIV", F.lit(False))
                    | (F.col("_copd") & F.coalesce(dev.startswith("V"), F.lit(False)))
                    | (F.col("_copd") & F.coalesce(s1 < 88, F.lit(False)))),
    })
    o, s2flag = F.col("_out"), F.col("_scale2")
    out = out.withColumn("_s2", F.when(o & s2flag & F.coalesce(sc == 0, F.lit(False)), F.lit(nw.SPO2_SCALE2_FILL))
                         .when(o, F.lit(None)).otherwise(s1))
    s2 = F.col("_s2")
    miss_sat = s2.isNull() & sc.isNotNull()
    out = out.withColumn(sat, F.when(miss_sat & ~s2flag, nw.spo2_scale1_value(sc))
                         .when(miss_sat & s2flag & (sc == 0), F.lit(nw.SPO2_SCALE2_FILL)).otherwise(s2))
    s3 = F.col(sat)
    miss_score = s3.isNotNull() & sc.isNull()
    out = out.withColumn(score, F.when(miss_score & ~s2flag, nw.spo2_scale1_score(s3))
                         .when(miss_score & s2flag, nw.spo2_scale2_score(s3, F.col(assisted))).otherwise(sc))
    return out.drop("_s1", "_copd", "_out", "_scale2", "_s2")


def o2_prepared(sat: str):
    s = rp.invert_negatives(sat)
    s = F.when(s == 0, F.lit(None)).otherwise(s)
    return rp.shift_single(s, inclusive=True)


def top_levels(df: DataFrame, col: str, n: int) -> DataFrame:
    """(value, rank) of the ``n`` most frequent non-null values, count desc then
    value asc. The count is partially aggregated and the result has at most ``n``
    rows, so it is safe to broadcast whatever the input size."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), F.asc(col)).limit(n)
    return top.select(F.col(col), F.lit(True).alias("_top"))


def topn_keep(df: DataFrame, col: str, n: int, sentinel: str | None = None,
              levels: Sequence[str] | None = None) -> DataFrame:
    """Keep values among the ``n`` most frequent; others become ``sentinel``.
    With ``levels`` the stored list is applied instead of fitting one."""
    x = F.col(col)
    if levels is not None:
        return df.withColumn(col, F.when(x.isNotNull() & ~x.isin(list(levels)), F.lit(sentinel)).otherwise(x))
    top = top_levels(df, col, n)
    j = df.join(F.broadcast(top), on=col, how="left")
    out = j.withColumn(col, F.when(x.isNotNull() & F.col("_top").isNull(), F.lit(sentinel)).otherwise(x))
    return out.select(*df.columns)
