"""Distributed running sums, ranks, neighbours and exact quantiles.

A window with no ``partitionBy`` (or partitioned by a column with few values, such as a
binary label, or by a key that one value dominates) sends most rows to one task. The
helpers here compute the same numbers in two levels:

1. rows fall into buckets by ``bucket``, a pure function of the first order column
   that never decreases along the order, and only a (group, bucket) is ordered;
2. a window over one row per (group, bucket) gives what lies before each bucket.

Because the bucket depends on the row alone, both levels agree without a checkpoint,
nothing runs until the result is used, and AQE sizes the tasks. Buckets only balance the
work; the result is exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType


def bucket(df: DataFrame, col: str) -> Column:
    """A coarse value of ``col`` in the same order: the first two characters of a
    string (256 buckets of a hex digest), the quarter of a date or time, the sign and
    sixteenth of an octave of a number."""
    kind, x = df.schema[col].dataType, F.col(col)
    if isinstance(kind, StringType):
        return F.substring(x, 1, 2)
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return F.year(x) * 4 + F.quarter(x)
    if isinstance(kind, NumericType):
        d = x.cast("double")
        step = F.floor(16 * F.log2(F.abs(d) + 1e-300)) + 20_000  # positive for every double
        return F.when(F.isnan(d), F.lit(1 << 40)).otherwise((F.signum(d) * step).cast("long"))
    return F.lit(0)


def _key(group: Sequence[str], *more: str) -> Column:
    """One never-null key: equal also where members are null."""
    return F.struct(*[F.col(c) for c in (*group, *more)])


def running_sums(df: DataFrame, order: Sequence[str], values: Mapping[str, Column],
                 group: Sequence[str] = (), inclusive: bool = True) -> DataFrame:
    """Add ``cum_<name>`` = running sum of each value over ``order`` (ascending)
    within ``group`` (rows with a null group are a group); ``order`` must be unique
    within the group. All columns of ``df`` are shuffled: pass the key columns only."""
    b = df.withColumn("_b", bucket(df, order[0])).withColumns({f"_v_{k}": v for k, v in values.items()})
    b = b.withColumn("_k", _key(group, "_b"))
    tot = b.groupBy("_k").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    tot = tot.withColumns({"_b": F.col("_k._b"), "_g": F.struct(F.lit(0), *[F.col(f"_k.{g}") for g in group])})
    earlier = Window.partitionBy("_g").orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_k", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = Window.partitionBy("_k").orderBy(*[F.col(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    b = b.withColumns({f"_l_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in values})
    return b.join(off, "_k").select(*df.columns, *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(f"cum_{k}") for k in values])


def ranks(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based row number over ``order`` within ``group`` (order must be unique)."""
    out = running_sums(df, order, {"_one": F.lit(1)}, group)
    return out.withColumnRenamed("cum__one", name)


def exact_quantiles(df: DataFrame, cols: Sequence[str], q: float = 0.5) -> DataFrame:
    """Exact quantile (linear interpolation, as ``median``/``percentile``) of each
    column: (column, value). Values are first counted per distinct value - a
    partial aggregate, so a value repeated on a third of all rows is one row -
    then ranked with ``running_sums``; no task ever holds a whole column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("_kv")).select("_kv.*")
    hist = long.where(F.col("value").isNotNull()).groupBy("col_name", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_sums(hist, ["value"], {"n": F.col("n")}, ["col_name"])
    totals = hist.groupBy("col_name").agg(F.sum("n").alias("total"))
    pos = (F.col("total") - 1) * F.lit(q)
    t = totals.select("col_name", pos.alias("pos"), F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"))
    j = cum.join(t, "col_name")
    start = F.col("cum_n") - F.col("n")  # rows before this value (0-based rank of its first copy)
    hit_lo = (start <= F.col("lo")) & (F.col("lo") < F.col("cum_n"))
    hit_hi = (start <= F.col("hi")) & (F.col("hi") < F.col("cum_n"))
    picked = j.where(hit_lo | hit_hi).groupBy("col_name").agg(
        F.max(F.when(hit_lo, F.col("value"))).alias("v_lo"), F.max(F.when(hit_hi, F.col("value"))).alias("v_hi"),
        F.first("pos").alias("pos"), F.first("lo").alias("lo"))
    val = F.col("v_lo") + (F.col("pos") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))
    names = F.array(*[F.lit(c) for c in cols])
    allc = df.sparkSession.range(1).select(F.explode(names).alias("col_name"))
    return allc.join(picked.select("col_name", val.alias("value")), "col_name", "left")


def lag_lead(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Previous / next ``value`` within ``group`` in ``order`` (``_prev``/``_next``).

    A plain window runs inside each (group, bucket); the first and last row of a
    bucket take their neighbour from the group's nearest other bucket, found by a
    second window over one row per (group, bucket). So a group with a third of all
    rows is ordered in as many tasks as it has buckets. ``order`` must be unique
    within the group."""
    b = df.withColumn("_b", bucket(df, order[0])).withColumn("_k", _key([group], "_b"))
    w = Window.partitionBy("_k").orderBy(*[F.col(o) for o in order])
    b = b.withColumns({"_prev": F.lag(value).over(w), "_next": F.lead(value).over(w),
                       "_first": F.lag(F.lit(1)).over(w).isNull(), "_last": F.lead(F.lit(1)).over(w).isNull()})
    ends = b.groupBy("_k").agg(F.max(F.when(F.col("_first"), F.struct(value))).alias("_lo"),
                               F.max(F.when(F.col("_last"), F.struct(value))).alias("_hi"))
    wg = Window.partitionBy(F.struct(F.col(f"_k.{group}"))).orderBy(F.col("_k._b").asc_nulls_first())
    ends = ends.select("_k", F.lag("_hi").over(wg).alias("_before"), F.lead("_lo").over(wg).alias("_after"))
    j = b.join(ends, "_k")
    return j.select(*df.columns, F.when(F.col("_first"), F.col(f"_before.{value}")).otherwise(F.col("_prev")).alias("_prev"),
                    F.when(F.col("_last"), F.col(f"_after.{value}")).otherwise(F.col("_next")).alias("_next"))
