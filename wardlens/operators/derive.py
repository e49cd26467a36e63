"""Outcome derivations over a stay's path and history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions import families as fam

# Outcome defaults of the two admission layouts.
CRITICAL_WARDS = ["CCU"]
CRITICAL_WARDS_H1 = ["CCU", "HH1M"]
SDEC_WARDS = ["AEC", "AAA"]
COVID_CODES = ["U07.1", "J12.8", "B97.2"]
COVID_START = "2020-01-01"
READMISSION_EDGES_DAYS = [-1, 0, 1, 2, 7, 14, 30, 60]
READMISSION_LABELS = ["24 Hrs", "48 Hrs", "1 Week", "2 Weeks", "1 Month", "2 Months"]
# Outcome variants: (wards, ignore admission ward)
OUTCOME_VARIANTS = {
    "strict": (["CCU"], True),
    "h1": (["CCU", "HH1M"], True),
    "direct": (["CCU"], False),
    "sci": (["CCU", "HH1M"], False),
}

ROUND = 6  # elapsed times are compared after rounding, so float noise cannot flip a <=


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def total_los(path: Column, los_field: str = "los") -> Column:
    """Stay length as the sum of the present step lengths (null if none)."""
    return F.round(fam.sum_present(path, los_field), ROUND)


def admit_ward(path: Column, ward_field: str = "ward") -> Column:
    return F.try_element_at(path, F.lit(1))[ward_field]


def mortality(died, los, within: float | None = 1) -> Column:
    """Died during the stay (and within ``within`` days of admission if given)."""
    d = F.coalesce(_c(died), F.lit(False))
    if within is None:
        return d
    return F.coalesce(d & (_c(los) <= F.lit(within)), F.lit(False))


def death_time(died, los) -> Column:
    """Time of death for the time-form outcome: stay length if died, else 0."""
    return F.when(F.coalesce(_c(died), F.lit(False)), _c(los)).otherwise(F.lit(0.0))


def critical_care_time(path: Column, wards: Sequence[str] = CRITICAL_WARDS,
                       ignore_admit_ward: bool = True, ward_field: str = "ward",
                       los_field: str = "los") -> Column:
    """Days spent before entering the first listed ward on the path (null if
    never). With ``ignore_admit_ward`` the first step cannot match, but its stay
    length still counts towards the elapsed time."""
    pos = fam.first_match(path, lambda x: x[ward_field].isin(list(wards)), 2 if ignore_admit_ward else 1)
    return F.round(fam.sum_before(path, pos, los_field), ROUND)


def critical_care(path: Column, wards: Sequence[str] = CRITICAL_WARDS, within: float | None = 1,
                  ignore_admit_ward: bool = True, ward_field: str = "ward", los_field: str = "los") -> Column:
    t = critical_care_time(path, wards, ignore_admit_ward, ward_field, los_field)
    if within is None:
        return t.isNotNull()
    return F.coalesce(t <= F.lit(within), F.lit(False))


def critical_event(died, los, path: Column, within: float | None = 1,
                   wards: Sequence[str] = CRITICAL_WARDS, ignore_admit_ward: bool = True, **kw) -> Column:
    """Death or critical-care admission within ``within`` days."""
    return mortality(died, los, within) | critical_care(path, wards, within, ignore_admit_ward, **kw)


def critical_event_time(died, los, path: Column, wards: Sequence[str] = CRITICAL_WARDS,
                        ignore_admit_ward: bool = True, **kw) -> Column:
    """Time of the critical event: critical-care entry time (0 counts as missing),
    else the death time."""
    cc = critical_care_time(path, wards, ignore_admit_ward, **kw)
    return F.coalesce(F.nullif(cc, F.lit(0.0)), death_time(died, los))


def mortality_class(during, within30, within_threshold,
                    names: Sequence[str] = ("DiedDuringStay", "DiedWithin30Days", "DiedWithinThreshold", "DidNotDie")) -> Column:
    """Concatenated names of the mortality flags that hold; a death during the
    stay that is already within the threshold only reports the threshold flag."""
    d = F.coalesce(_c(during), F.lit(False))
    w30 = F.coalesce(_c(within30), F.lit(False))
    wt = F.coalesce(_c(within_threshold), F.lit(False))
    during_only = d & ~wt
    none = ~(during_only | w30 | wt)
    return fam.true_names(dict(zip(names, [during_only, w30, wt, none], strict=True)))


def sdec(first_ward, wards: Sequence[str] = SDEC_WARDS) -> Column:
    return F.coalesce(_c(first_ward).isin(list(wards)), F.lit(False))


def long_los(los, over: float = 7) -> Column:
    return F.coalesce(_c(los) >= F.lit(over), F.lit(False))


def code_flag_any(codes: Column, admitted, codes_wanted: Sequence[str] = COVID_CODES,
                  start: str | None = COVID_START) -> Column:
    """Some code of the family is listed (and admitted on/after ``start``)."""
    hit = fam.contains_any(codes, codes_wanted)
    if start is None:
        return hit
    return hit & F.coalesce(_c(admitted) >= F.lit(start).cast("timestamp_ntz"), F.lit(False))


def code_flag_all(codes: Column, codes_wanted: Sequence[str] = COVID_CODES) -> Column:
    return fam.contains_all(codes, codes_wanted)


# --- history (window per patient) -------------------------------------------

def readmission_spans(df: DataFrame, patient: str, ts: str, key: str) -> DataFrame:
    """Seconds since the patient's previous admission and until the next one.

    Ordered by time then key (ties). The previous/next admission come from the
    two-phase ``ranking.lag_lead``: a patient with a large share of all rows is
    spread over several tasks instead of one window partition. Rows without a
    patient get no history."""
    from wardlens.operators.ranking import lag_lead
    secs = F.unix_timestamp(F.col(ts).cast("timestamp"))
    staged = df.withColumn("_t", secs)
    out = lag_lead(staged, patient, [ts, key], "_t")
    has_patient = F.col(patient).isNotNull()
    return out.withColumns({
        "prev_gap_s": F.when(has_patient, F.col("_t") - F.col("_prev")),
        "next_gap_s": F.when(has_patient, F.col("_next") - F.col("_t")),
    }).drop("_t", "_prev", "_next")


def readmission(gap_seconds, within_days: float = 30) -> Column:
    """Gap to the previous admission strictly below ``within_days`` days."""
    return F.coalesce(_c(gap_seconds) < F.lit(within_days * 86400), F.lit(False))


def cut(x, edges: Sequence[float], labels: Sequence[str], default: str | None = None) -> Column:
    """Right-closed binning: label i for edges[i] < x <= edges[i+1]; else ``default``."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    col = _c(x)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels, strict=True):
        cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(default))


def readmission_band(gap_seconds, aligned: bool = False,
                     edges_days: Sequence[float] = READMISSION_EDGES_DAYS,
                     labels: Sequence[str] = READMISSION_LABELS, default: str = "N/A") -> Column:
    """Band of the gap to the previous admission.

    The reference layout prepends an extra edge, so its labels sit one interval
    late: (0, 1] day reads "48 Hrs" and (30, 60] falls out as "N/A". That literal
    banding is the default; ``aligned=True`` gives each label its own interval."""
    days = _c(gap_seconds) / 86400.0
    if aligned:
        return cut(days, list(edges_days[1:]), list(labels), default)
    labs = list(labels) + [default]
    return cut(days, list(edges_days), labs, default)


# Charlson age points, (lower exclusive, upper inclusive, points).
CHARLSON_AGE_POINTS = [(50, 59, 1), (60, 69, 2), (70, 79, 3), (79, None, 4)]


def charlson_age_points(age) -> Column:
    """Age component of the Charlson index (ages 60 and 70 score 0, as listed)."""
    a = _c(age)
    expr = None
    for lo, hi, pts in CHARLSON_AGE_POINTS:
        cond = a > lo if hi is None else (a > lo) & (a <= hi)
        expr = F.when(cond, F.lit(pts)) if expr is None else expr.when(cond, F.lit(pts))
    return expr.otherwise(F.lit(0))
