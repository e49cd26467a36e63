"""Projections, filters and per-column predicates (P-rows)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from wardlens.functions.text import WHITESPACE

# Ordinal level lists.
AVCPU_LEVELS = ["A - Alert", "V - Responds to voice", "C - New onset of confusion",
                "P - Responds to pain", "U - Unconscious"]
PAIN_LEVELS = ["0 - No pain", "1 - Mild pain", "2 - Moderate pain", "3 - Severe pain"]
# Placeholder value per column (new layout) and accepted "true" strings.
PLACEHOLDERS = {"Gender": "Other", "Ethnicity": "NOT STATED", "AE_MainDiagnosis": "UNKNOWN",
                "AE_Location": "System Generated"}
TRUE_VALUES = {"Gender": ["Female"], "DiedDuringStay": ["Yes"], "DiedWithin30Days": ["Yes"],
               "AdmissionType": ["Elective"], "CareHome": ["Yes"],
               "Resus_Status": ["DNA - CPR", "Unified DNA - CPR"]}
# Lab strings deleted, and lab strings replaced by a midpoint value.
LAB_DELETE = {"Blood_Urea": [">107.0", ">53.6"], "Blood_Sodium": ["<100", "<80", ">200", ">180"],
              "Blood_Potassium": [">10.0", "<1.5"], "Blood_Creatinine": [">2210"],
              "Blood_DDimer": ["<21", "<100", ">69000"], "Blood_Albumin": ["<10"], "VBG_O2": ["<0.8"]}
LAB_CONVERT = {"Blood_Urea": {"<1.8": 0.9}, "Blood_Creatinine": {"<18": 9.0},
               "Blood_DDimer": {"<150": 125.0}, "Blood_CRP": {"<4.0": 2.25, "<0.5": 0.25}}


def select_group(df: DataFrame, groups: Mapping[str, Sequence[str]], name: str,
                 key: str | None = None) -> DataFrame:
    """Columns of one named feature group (present ones only), key first."""
    cols = [c for c in groups[name] if c in df.columns and c != key]
    return df.select(*([key] if key else []), *cols)


def drop_tolerant(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring names that are not there."""
    return df.drop(*[c for c in cols if c in df.columns])


def ordered_select(df: DataFrame, order: Sequence[str], rest: bool = False) -> DataFrame:
    """Columns in canonical order; unknown columns dropped (or appended if ``rest``)."""
    cols = [c for c in order if c in df.columns]
    if rest:
        cols += [c for c in df.columns if c not in cols]
    return df.select(*cols)


def mandate(df: DataFrame, cols: Sequence[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Drop rows with a missing value in any of the columns that exist (or in every
    column starting with ``prefix``)."""
    subset = [c for c in (cols or []) if c in df.columns]
    if prefix:
        subset += [c for c in df.columns if c.startswith(prefix) and c not in subset]
    return df.na.drop("any", subset=subset) if subset else df


def placeholder_to_null(df: DataFrame, placeholders: Mapping[str, object]) -> DataFrame:
    present = {c: v for c, v in placeholders.items() if c in df.columns}
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in present.items()})


def binarize(df: DataFrame, true_values: Mapping[str, Sequence[str]]) -> DataFrame:
    """String -> boolean by accepted set; missing counts as false."""
    present = {c: v for c, v in true_values.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c).isin(list(v)), F.lit(False)) for c, v in present.items()})


def cohort_filter(df: DataFrame, band: str, patient: str, age: str, min_age: int = 16,
                  still_in: str = "Still In") -> DataFrame:
    """Discharged (a missing band is kept), identified, aged at least ``min_age``;
    patient id and age become integers. Predicates sit on raw columns so they
    reach the scan."""
    out = df.where(~F.col(band).eqNullSafe(F.lit(still_in)))
    out = out.where(F.col(patient).isNotNull() & F.col(age).isNotNull())
    out = out.withColumns({age: F.col(age).cast("int"), patient: F.col(patient).cast("long")})
    return out.where(F.col(age) >= min_age)


def lab_repair(c, delete: Sequence[str] = (), convert: Mapping[str, float] | None = None) -> Column:
    """Censored lab strings: listed ones deleted, others replaced by a midpoint, the
    rest parsed as numbers (unparsable -> null)."""
    x = F.col(c) if isinstance(c, str) else c
    expr = F.when(x.isin(list(delete)), F.lit(None).cast("double")) if delete else None
    for s, val in (convert or {}).items():
        cond = x == F.lit(s)
        expr = F.when(cond, F.lit(float(val))) if expr is None else expr.when(cond, F.lit(float(val)))
    parsed = x.try_cast("double")
    return parsed if expr is None else expr.otherwise(parsed)


def to_numeric(c) -> Column:
    """Coerce to double; bad strings and NaN become null."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def ordinal(c, levels: Sequence[str]) -> Column:
    """Position of the value in an ordered level list, from 0; unknown -> null."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c) if isinstance(c, str) else c)
    return F.when(pos > 0, (pos - 1).cast("int"))


def keep_levels(c, levels: Sequence[str]) -> Column:
    """Apply a stored level list: values outside it become null."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin(list(levels)), x)


def categorize(df: DataFrame, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Booleans -> 1.0/0.0; strings restricted to stored levels where given."""
    exprs = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, BooleanType):
            exprs[f.name] = F.col(f.name).cast("double")
        elif levels and f.name in levels:
            exprs[f.name] = keep_levels(f.name, levels[f.name])
    return df.withColumns(exprs) if exprs else df


def trim_all(df: DataFrame) -> DataFrame:
    """Trim ASCII whitespace from both ends of every string column (one projection)."""
    exprs = {f.name: F.btrim(F.col(f.name), F.lit(WHITESPACE))
             for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns(exprs) if exprs else df


def justify_rows(df: DataFrame, order: Sequence[str], cols: Sequence[str], side: str = "up") -> DataFrame:
    """Each column's present values moved to the first (``up``) or last (``down``) rows in
    ``order``, their own order kept; missing values fill the rest. ``order`` must be unique. Rows
    and values are ranked with two levels of windows and meet by rank, so no task holds a column."""
    from wardlens.operators.ranking import ranks
    if side not in ("up", "down"):
        raise ValueError(f"side must be 'up' or 'down', got {side!r}")
    rows = ranks(df.drop(*cols), order, (), "_at")
    kv = F.explode(F.array(*[F.struct(F.lit(i).alias("_col"), F.struct(*[(F.col(c) if j == i else F.lit(None).cast(df.schema[c].dataType)).alias(f"_v{j}")
                                                                          for j, c in enumerate(cols)]).alias("_v")) for i in range(len(cols))]))
    long = df.select(*order, kv.alias("_kv")).select(*order, "_kv._col", "_kv._v")
    long = long.where(F.coalesce(*[F.col(f"_v._v{j}").cast("string") for j in range(len(cols))]).isNotNull())
    placed = ranks(long, order, ["_col"], "_at")
    if side == "down":
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        have = long.groupBy("_col").agg(F.count(F.lit(1)).alias("_have"))
        placed = placed.join(have, "_col").crossJoin(F.broadcast(n)).withColumn("_at", F.col("_at") + F.col("_n") - F.col("_have"))  # one row
    wide = placed.groupBy("_at").agg(*[F.max(f"_v._v{j}").alias(c) for j, c in enumerate(cols)])
    return rows.join(wide, "_at", "left").select(*df.columns)
