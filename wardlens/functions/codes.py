"""Diagnosis-code functions: standardisation, stems, vague ranges, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vague ICD-10 three-character ranges (letter, first, last), inclusive.
VAGUE_CODE_RANGES = [
    ("R", 0, 56), ("R", 58, 64), ("R", 66, 94), ("V", 1, 98), ("Z", 0, 13),
    ("Z", 20, 29), ("Z", 32, 36), ("Z", 39, 39), ("Z", 43, 48), ("Z", 52, 99),
]
# COPD diagnosis codes and the non-invasive ventilation procedure.
COPD_CODES = ["J44.0", "J44.1", "J44.8", "J44.9", "J44.X"]
NIV_PROCEDURE = "E85.2"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def drop_last(x: Column, n: int) -> Column:
    """Drop the last ``n`` characters."""
    return F.left(x, F.greatest(F.length(x) - n, F.lit(0)))


def standardise(c) -> Column:
    """'A12.34 D' / 'A12.X' lose their last two characters, then a trailing capital
    letter is cut ('A12.34D' -> 'A12.34')."""
    x = _c(c)
    step1 = F.when(x.contains(" ") | x.endswith(".X"), drop_last(x, 2)).otherwise(x)
    return F.when(step1.rlike("[A-Z]$"), drop_last(step1, 1)).otherwise(step1)


def stem3(c) -> Column:
    """Three-character stem: text before the first '.'."""
    return F.split_part(_c(c), F.lit("."), F.lit(1))


def undotted(c) -> Column:
    return F.replace(_c(c), F.lit("."), F.lit(""))


def is_vague(c) -> Column:
    """Code whose first three characters fall in a vague range (range test, not a
    set of every member)."""
    x = _c(c)
    letter = F.substring(x, 1, 1)
    digits = F.substring(x, 2, 2)
    num = digits.try_cast("int")
    out = None
    for l_, lo, hi in VAGUE_CODE_RANGES:
        cond = (letter == F.lit(l_)) & num.between(lo, hi)
        out = cond if out is None else out | cond
    return F.coalesce(out & digits.rlike("^[0-9]{2}$"), F.lit(False))
