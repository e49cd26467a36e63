"""Feature preparation (M1-M9b): imputation, encodings, scaling.

Every data-dependent step is fit-then-apply: one aggregate gathers the
statistics or level lists (bounded: one value per column, or one entry per
level of a categorical column), they come back as literals, and the apply step
is a single projection with a fixed schema.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from wardlens.operators.ranking import exact_quantiles, ranks

# Static imputations of the old admission layout.
STATIC_IMPUTATION = {
    "AssistedBreathing": False, "Pain": False, "Nausea": False, "VomitingSinceLastRound": False,
    "LyingDown": False, "BreathingDevice": "A - Air", "Oxygen_flow_rate": 0.0, "AVCPU_Alert": True,
}
NUMERIC_FILL, LEVEL_FILL = -1, "NAN"


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column (distributed, see ranking.exact_quantiles)."""
    return {r["col_name"]: r["value"] for r in exact_quantiles(df, cols, 0.5).collect()}


def impute_median(df: DataFrame, cols: Sequence[str], medians: Mapping[str, float] | None = None) -> DataFrame:
    m = dict(medians) if medians is not None else fit_medians(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m[c])) for c in cols if m.get(c) is not None})


def impute_static(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    present = {c: v for c, v in values.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in present.items()})


def fill_na(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers -> -1, missing levels -> 'NAN'."""
    exprs = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, NumericType):
            exprs[f.name] = F.coalesce(F.col(f.name), F.lit(NUMERIC_FILL).cast(f.dataType))
        elif isinstance(f.dataType, StringType):
            exprs[f.name] = F.coalesce(F.col(f.name), F.lit(LEVEL_FILL))
    return df.withColumns(exprs)


def unfill_na(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    exprs = {}
    for f in df.schema.fields:
        if cols is not None and f.name not in cols:
            continue
        if isinstance(f.dataType, NumericType):
            exprs[f.name] = F.nullif(F.col(f.name), F.lit(NUMERIC_FILL).cast(f.dataType))
        elif isinstance(f.dataType, StringType):
            exprs[f.name] = F.nullif(F.col(f.name), F.lit(LEVEL_FILL))
    return df.withColumns(exprs)


def levels_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_name, level): the distinct present values of each column, as text, by a
    partial aggregate."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level")) for c in cols]))
    return df.select(kv.alias("kv")).select("kv.*").where(F.col("level").isNotNull()).distinct()


def fit_levels(df: DataFrame, cols: Sequence[str], most: int = 10_000) -> dict[str, list]:
    """Sorted distinct levels per column. A column per level is made of them, so more
    than ``most`` levels in all are refused."""
    rows = levels_table(df, cols).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} levels")
    return {c: sorted(r["level"] for r in rows if r["col_name"] == c) for c in cols}


def ordinal_encode(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Code of the value in the sorted level list; missing or unknown -> -1. Without given
    ``levels`` a column's distinct values are ranked as a table and joined, so their
    number is not bounded."""
    if levels is not None:
        return df.withColumns({c: F.coalesce((F.array_position(F.array(*[F.lit(x) for x in levels[c]]), F.col(c)) - 1)
                                             .cast("int"), F.lit(-1)) for c in cols})
    names, out = df.columns, df
    for c in cols:
        coded = ranks(df.select(F.col(c).alias("_level")).where(F.col("_level").isNotNull()).distinct(), ["_level"], (), "_code")
        out = out.join(coded, F.col(c) == F.col("_level"), "left").withColumn(
            c, F.coalesce((F.col("_code") - 1).cast("int"), F.lit(-1))).drop("_level", "_code")
    return out.select(*names)


def onehot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence] | None = None, sep: str = "__",
           drop_old: bool = True, null_rows: str = "zero", drop_if_binary: bool = False) -> DataFrame:
    """``col__level`` 0/1 columns per level. Missing values give 0 flags (or null
    with ``null_rows='null'``); a level list naming absent columns raises."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    lv = dict(levels) if levels is not None else fit_levels(df, cols)
    exprs: dict[str, Column] = {}
    for c in cols:
        use = list(lv[c])[1:] if drop_if_binary and len(lv[c]) == 2 else list(lv[c])
        for level in use:
            flag = F.coalesce((F.col(c) == F.lit(level)).cast("int"), F.lit(0))
            if null_rows == "null":
                flag = F.when(F.col(c).isNotNull(), flag)
            exprs[f"{c}{sep}{level}"] = flag
    out = df.withColumns(exprs)
    return out.drop(*cols) if drop_old else out


def onehot_family(df: DataFrame, cols: Sequence[str], prefix: str, levels: Sequence | None = None, sep: str = "__",
                  drop_old: bool = True) -> DataFrame:
    """One ``prefix__level`` 0/1 column per level of a family of columns: 1 where any of them
    holds it. Missing values give no flag."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    use = levels if levels is not None else sorted({x for xs in fit_levels(df, cols).values() for x in xs})
    held = F.array(*[F.col(c).cast("string") for c in cols])
    out = df.withColumn("_held", held)
    out = out.withColumns({f"{prefix}{sep}{x}": F.coalesce(F.array_contains("_held", F.lit(str(x))), F.lit(False)).cast("int") for x in use}).drop("_held")
    return out.drop(*cols) if drop_old else out


def sparse_levels(df: DataFrame, key: str, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One-hot encoding without a column per level: (key, indices) with the sorted places of a
    row's levels, and the table (index, col_name, level) that says what a place means. Places
    number the levels of all columns by column and level from 0. Levels are ranked and joined as
    tables, so their number is not bounded; a row has at most one place per column. Rows
    without a level have no places."""
    table = levels_table(df, cols)
    table = ranks(table.withColumn("_o", F.concat("col_name", F.lit("\u0000"), "level")), ["_o"], (), "_n").select(
        (F.col("_n") - 1).alias("index"), "col_name", "level")
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level")) for c in cols]))
    long = df.select(key, kv.alias("kv")).select(key, "kv.*").where(F.col("level").isNotNull()).join(table, ["col_name", "level"])
    places = long.groupBy(key).agg(F.array_sort(F.collect_list("index")).alias("indices"))
    out = df.select(key).join(places, key, "left")
    return out.select(key, F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices")), table


def fit_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standard_scale(df: DataFrame, cols: Sequence[str], moments: Mapping | None = None) -> DataFrame:
    """(x - mean) / population std (a constant column scales to 0)."""
    mm = dict(moments) if moments is not None else fit_moments(df, cols)
    exprs = {}
    for c in cols:
        m, s = mm[c]
        exprs[c] = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.col(c) - F.lit(m)
    return df.withColumns(exprs)


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent present value per column (ties: smallest value). All columns are
    counted in one pass; one row per column comes back."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("v")) for c in cols]))
    n = df.select(kv.alias("kv")).select("kv.*").where(F.col("v").isNotNull()).groupBy("col_name", "v").count()
    best = n.groupBy("col_name").agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("m")).collect()
    got = {r["col_name"]: r["m"]["v"] for r in best}
    return {c: got.get(c) for c in cols}


def impute_mode(df: DataFrame, cols: Sequence[str], modes: Mapping | None = None) -> DataFrame:
    md = dict(modes) if modes is not None else fit_modes(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(md[c]).cast(df.schema[c].dataType)) for c in cols if md.get(c) is not None})


def preprocess_by_type(df: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Numbers scaled then median-imputed; strings one-hot (missing -> 0);
    booleans one-hot with one column dropped when binary, after a most-frequent
    imputation; the rest missing -> 0."""
    skip = {key, label}
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
    bools = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType) and f.name not in skip]
    out = standard_scale(df, nums)
    out = impute_median(out, nums)
    out = onehot(out, strs)
    if bools:
        out = impute_mode(out, bools)
        out = out.withColumns({b: F.col(b).cast("string") for b in bools})
        out = onehot(out, bools, drop_if_binary=True)
    return out.na.fill(0)


def onehot_groups(cols: Sequence[str], sep: str = "__") -> dict[str, list[str]]:
    """Group one-hot column names by prefix (schema only, no job)."""
    groups: dict[str, list[str]] = {}
    for c in cols:
        if sep in c:
            groups.setdefault(c.split(sep, 1)[0], []).append(c)
    return groups


def group_sum(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Row-wise sum of each group's columns (e.g. per-level contributions)."""
    return df.withColumns({g: F.aggregate(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs]),
                                          F.lit(0.0), lambda a, x: a + x) for g, cs in groups.items()})


def joined_levels(df: DataFrame, cols: Sequence[str], sep: str = "__") -> Column:
    """Levels whose one-hot flag is 1, joined by ', ' (inverse one-hot)."""
    return F.concat_ws(", ", *[F.when(F.col(c) == 1, F.lit(c.split(sep, 1)[1])) for c in cols])
