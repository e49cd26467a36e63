"""Numeric repair functions for transcribed measurements (each a column expression)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Devices whose 0.5 flow reading is litres per minute, and the
# flow -> inspired-oxygen conversion constants (fraction = (a + b * flow) / 100).
LPM_DEVICES = ["A - Air", "N - Nasal cannula", "SM - Simple mask"]
FIO2_A, FIO2_B = 0.2, 4.0


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def invert_negatives(c) -> Column:
    return F.abs(_c(c))


def clip_sentinel(c, lower, upper, sentinel=None, inclusive: bool = True) -> Column:
    """Values at/beyond the bounds (``inclusive``) or strictly beyond them become
    ``sentinel`` (null by default). Bounds may be columns."""
    x = _c(c)
    lo = lower if isinstance(lower, Column) else F.lit(lower)
    hi = upper if isinstance(upper, Column) else F.lit(upper)
    out = (x <= lo) | (x >= hi) if inclusive else (x < lo) | (x > hi)
    return F.when(F.coalesce(out, F.lit(False)), F.lit(sentinel)).otherwise(x)


def shift_triple(c, integer: bool = False) -> Column:
    """Values >= 100 divided by 10 (``integer``: floor division)."""
    x = _c(c)
    return F.when(x >= 100, F.floor(x / 10).cast("double") if integer else x / 10).otherwise(x)


def shift_single(c, inclusive: bool = False) -> Column:
    """Values < 10 (``inclusive``: <= 10) multiplied by 10."""
    x = _c(c)
    cond = x <= 10 if inclusive else x < 10
    return F.when(cond, x * 10).otherwise(x)


def mask_against(c, other, margin: float = 5) -> Column:
    """Null where c <= other + margin (e.g. systolic not above diastolic + 5)."""
    x = _c(c)
    return F.when(F.coalesce(x <= _c(other) + F.lit(margin), F.lit(False)), F.lit(None)).otherwise(x)


def flow_to_fraction(flow, device) -> Column:
    """Oxygen flow as an inspired fraction: 1..15 (or 0.5 on low-flow devices) is
    litres per minute -> (0.2 + 4 x) / 100; other values above 15 are percentages
    -> x / 100; anything still above 1 is dropped."""
    f = _c(flow)
    lpm = ((f >= 1) & (f <= 15)) | ((f == 0.5) & F.coalesce(_c(device).isin(LPM_DEVICES), F.lit(False)))
    lpm = F.coalesce(lpm, F.lit(False))
    out = F.when(lpm, (F.lit(FIO2_A) + f * F.lit(FIO2_B)) / 100).when(f > 15, f / 100).otherwise(f)
    return F.when(out > 1, F.lit(None)).otherwise(out)
