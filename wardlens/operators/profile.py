"""Profiling and aggregate operators (A-rows)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_family(df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a caller's Column -> Column function to every column of a family."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Frequency of each non-null value (partial aggregate before the shuffle)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent values with counts; ties by value. The sort+limit is
    a bounded TakeOrdered over the (small) count table."""
    return value_counts(df, col).orderBy(F.desc("count"), F.asc(col)).limit(k)


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_present, pct_present): one aggregate for all columns, unpivoted."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    long = wide.unpivot(["_rows"], list(cols), "col_name", "n_present")
    return long.select("col_name", "n_present",
                       F.round(100.0 * F.col("n_present") / F.col("_rows"), 6).alias("pct_present"))


def availability(df: DataFrame, measures: Sequence[str], snapshot: Column | str,
                 snapshots: Sequence[str], digits: int = 2) -> DataFrame:
    """Measurement x snapshot matrix of the percentage of present readings."""
    snap = F.col(snapshot) if isinstance(snapshot, str) else snapshot
    long = df.select(snap.alias("_snap"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("measurement"), F.col(m).cast("double").alias("v")) for m in measures])).alias("_m"))
    long = long.select("_snap", "_m.measurement", "_m.v")
    return (long.groupBy("measurement").pivot("_snap", list(snapshots))
            .agg(F.round(100.0 * F.count("v") / F.count(F.lit(1)), digits)))


def rows_to_table(df: DataFrame, items: Sequence[tuple[str, str, Column]], total: Column) -> DataFrame:
    """Conditional counts as a (parameter, category, n, pct) table: one aggregate,
    then the single result row is exploded (no second pass over the data)."""
    agg = df.agg(total.alias("_n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"_c{i}")
                                      for i, (_, _, c) in enumerate(items)])
    rows = F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(cat).alias("category"), F.col(f"_c{i}").alias("n"))
                     for i, (p, cat, _) in enumerate(items)])
    out = agg.select("_n", F.explode(rows).alias("r"))
    return out.select("r.parameter", "r.category", "r.n", F.round(100.0 * F.col("r.n") / F.col("_n"), 2).alias("pct"))


def column_kinds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, kind): 'binary' if every present value is 0 or 1, else 'numeric'."""
    agg = df.agg(*[F.bool_and(F.col(c).isNull() | F.col(c).isin(0, 1)).alias(c) for c in cols])
    long = agg.unpivot([], list(cols), "col_name", "is_binary")
    return long.select("col_name", F.when(F.coalesce(F.col("is_binary"), F.lit(True)), "binary")
                       .otherwise("numeric").alias("kind"))


def describe_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_levels, levels) for categorical columns. Values are made distinct by a
    partial aggregate first; each column's list holds its distinct levels once."""
    from wardlens.operators.features import levels_table
    per = levels_table(df, cols).groupBy("col_name").agg(F.array_sort(F.collect_list("level")).alias("lv"))
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("col_name"))
    lv = F.coalesce("lv", F.array().cast("array<string>"))
    return names.join(per, "col_name", "left").select("col_name", F.size(lv).alias("n_levels"), F.array_join(lv, ",").alias("levels"))


def level_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_name, level, pos, n): one row per level of each column, numbered from 1 in the
    levels' order, with its count. No task holds all levels of a column."""
    from wardlens.operators.ranking import ranks
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("level")) for c in cols]))
    per = df.select(kv.alias("kv")).select("kv.*").where(F.col("level").isNotNull()).groupBy("col_name", "level").agg(F.count(F.lit(1)).alias("n"))
    return ranks(per, ["level"], ["col_name"], "pos").select("col_name", "level", "pos", "n")


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y_true, y_pred, n, share of the true class); the share window runs over
    the 4-row count table only."""
    c = df.groupBy(F.col(y).alias("y_true"), F.col(yhat).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy("y_true")
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def non_numeric_tally(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(measurement, value, n) for present values that do not parse as numbers."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measurement"), F.col(c).cast("string").alias("value"))
                                         for c in cols])).alias("m")).select("m.*")
    bad = long.where(F.col("value").isNotNull() & F.col("value").try_cast("double").isNull())
    return bad.groupBy("measurement", "value").agg(F.count(F.lit(1)).alias("n"))


def sigma_flags(df: DataFrame, col: str, k: float = 3.0, mean: float | None = None,
                std: float | None = None) -> DataFrame:
    """Flags values at/below mean - k*std and at/above mean + k*std. The two
    statistics are fitted with one aggregate (one row back) unless given."""
    if mean is None or std is None:
        r = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
        mean, std = r["m"], r["s"]
    lo, hi = mean - k * std, mean + k * std
    x = F.col(col)
    return df.withColumns({"is_low": F.coalesce(x <= F.lit(lo), F.lit(False)),
                           "is_high": F.coalesce(x >= F.lit(hi), F.lit(False))})


def deterministic_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """Seeded, engine-independent sample of ``n`` rows: smallest md5 of the key.
    A bounded TakeOrdered (each task keeps its n best, the driver merges)."""
    return df.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)
