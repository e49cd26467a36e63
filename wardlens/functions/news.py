"""Early-warning score scales (value -> score and score -> typical value).

Every scale is a ``when`` chain ("first match wins"), so it runs inside codegen;
missing input gives missing output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale thresholds, (lower bound, score) checked in order, then the else score.
RESPIRATION = ([(25, 3), (21, 2), (12, 0), (9, 1)], 3)
SPO2_SCALE1 = ([(96, 0), (94, 1), (92, 2)], 3)
SPO2_SCALE2_ASSISTED = [(97, 3), (95, 2), (93, 1), (88, 0)]
SPO2_SCALE2 = ([(93, 0), (86, 1), (84, 2)], 3)
TEMPERATURE = ([(39.1, 2), (38.1, 1), (36.1, 0), (35.1, 1)], 3)
HEART_RATE = ([(131, 3), (111, 2), (91, 1), (51, 0), (41, 1)], 3)
# Systolic scale as closed intervals (lo, hi, score); values between
# intervals (e.g. 110.5) get no score.
SYSTOLIC = [(220, None, 3), (111, 219, 0), (101, 110, 1), (91, 100, 2), (None, 90, 3)]
# Score -> typical value; unlisted scores give null.
RESPIRATION_REVERSE = {0: 16.0, 1: 10.0, 2: 23.0}
SPO2_SCALE1_REVERSE = {0: 98.0, 1: 95.0, 2: 93.0}
SYSTOLIC_REVERSE = {0: 165.0, 1: 105.0, 2: 95.0}
TEMPERATURE_REVERSE = {0: 37.0, 1: 37.0, 2: 39.1, 3: 35.0}
HEART_RATE_REVERSE = {0: 70.0, 1: 70.0, 2: 120.0}
# Flag <-> score maps (a score of 1.0 is impossible on both).
CONSCIOUSNESS_SCORE = {True: 3.0, False: 0.0}  # keyed by "not alert"
ASSISTED_AIR_SCORE = {True: 2.0, False: 0.0}
SPO2_SCALE2_FILL = 92.0  # reading assumed for a scale-2 patient scored 0


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def band(x, rules: Sequence[tuple[float, float]], otherwise: float | None) -> Column:
    """First rule with x >= bound gives its score; else ``otherwise``; null -> null."""
    v = _c(x)
    expr = None
    for bound, score in rules:
        cond = v >= F.lit(bound)
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    expr = expr.otherwise(F.lit(None if otherwise is None else float(otherwise)).cast("double"))
    return F.when(v.isNotNull(), expr)


def lookup(score, table: dict) -> Column:
    s = _c(score)
    expr = None
    for k, v in table.items():
        cond = s == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(None).cast("double"))


def respiration_score(x): return band(x, *RESPIRATION)
def spo2_scale1_score(x): return band(x, *SPO2_SCALE1)
def temperature_score(x): return band(x, *TEMPERATURE)
def heart_rate_score(x): return band(x, *HEART_RATE)
def respiration_value(s): return lookup(s, RESPIRATION_REVERSE)
def spo2_scale1_value(s): return lookup(s, SPO2_SCALE1_REVERSE)
def systolic_value(s): return lookup(s, SYSTOLIC_REVERSE)
def temperature_value(s): return lookup(s, TEMPERATURE_REVERSE)
def heart_rate_value(s): return lookup(s, HEART_RATE_REVERSE)


def systolic_score(x) -> Column:
    v = _c(x)
    expr = None
    for lo, hi, score in SYSTOLIC:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (v >= F.lit(lo))
        if hi is not None:
            cond = cond & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    return F.when(v.isNotNull(), expr.otherwise(F.lit(None).cast("double")))


def spo2_scale2_score(sat, assisted) -> Column:
    """Scale 2: assisted readings use the assisted cuts; an assisted reading below
    88 falls through to the unassisted cuts, as do unassisted readings."""
    v = _c(sat)
    a = F.coalesce(_c(assisted).cast("boolean"), F.lit(False))
    expr = None
    for bound, score in SPO2_SCALE2_ASSISTED:
        cond = a & (v >= F.lit(bound))
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    rules, other = SPO2_SCALE2
    for bound, score in rules:
        expr = expr.when(v >= F.lit(bound), F.lit(float(score)))
    return F.when(v.isNotNull(), expr.otherwise(F.lit(float(other))))


def risk_band(score) -> Column:
    """<=4 Low, <=6 Medium, >=7 High (a score between 6 and 7 has no band)."""
    s = _c(score)
    return F.when(s <= 4, "Low").when(s <= 6, "Medium").when(s >= 7, "High")
