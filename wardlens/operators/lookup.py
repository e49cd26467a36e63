"""Look-up joins (J-rows).

Look-up tables (code lists, groupings, descriptions) are dimension tables. They are
joined to the long form of a family (one row per code) without hints: the planner
broadcasts a side whose size it knows or measures to be below its threshold, so the
large side is not shuffled, and sort-merges anything larger, with AQE able to switch at
run time and to split skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.codes import undotted

CCS_SENTINEL = 259


def lookup_join(df: DataFrame, on: Column | str, lookup: DataFrame, key: str,
                values: Sequence[str], prefix: str = "") -> DataFrame:
    """Left join of ``df`` to ``lookup`` on ``on == key``; unmatched -> null.
    ``lookup`` must be unique on ``key`` (de-duplicate a many-to-one table first)."""
    lk = lookup.select(F.col(key).alias("_lk_key"), *[F.col(v).alias(prefix + v) for v in values])
    cond = (F.col(on) if isinstance(on, str) else on) == F.col("_lk_key")
    return df.join(lk, cond, "left").drop("_lk_key")


def cascade_join(df: DataFrame, code: str, lookup: DataFrame, key: str, value: str, out: str,
                 prefixes: Sequence[int] = (3, 4), sentinel: object = CCS_SENTINEL) -> DataFrame:
    """Cascaded prefix join: the undotted code matched exactly, else its first
    ``prefixes[0]`` characters, then ``prefixes[1]``...; a present code matching
    nothing gets ``sentinel``; a missing code stays missing. Each step is a
    broadcast left join on the long form (no shuffle of ``df``)."""
    u = undotted(code)
    keys = [("_cj0", u)] + [(f"_cj{i + 1}", F.left(u, F.lit(n))) for i, n in enumerate(prefixes)]
    lk = lookup.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    out_df = df.withColumns({name: expr for name, expr in keys})
    hits = []
    for name, _ in keys:
        hit = f"{name}_v"
        out_df = out_df.join(lk.select(F.col("_k").alias(f"{name}_k"), F.col("_v").alias(hit)),
                             F.col(name) == F.col(f"{name}_k"), "left").drop(f"{name}_k")
        hits.append(F.col(hit))
    res = F.when(F.col(code).isNotNull(), F.coalesce(*hits, F.lit(sentinel)))
    return out_df.withColumn(out, res).drop(*[n for n, _ in keys], *[f"{n}_v" for n, _ in keys])


def keep_members(df: DataFrame, code: str, ref: DataFrame, key: str) -> DataFrame:
    """Codes not found in ``ref`` become null (rows kept)."""
    r = ref.select(F.col(key).alias("_m")).distinct()
    j = df.join(r, F.col(code) == F.col("_m"), "left")
    return j.withColumn(code, F.when(F.col("_m").isNotNull(), F.col(code))).drop("_m")


def semi(df: DataFrame, on: str, other: DataFrame, other_key: str, anti: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``on`` is (``anti``: is not) among ``other``'s keys.
    The planner picks broadcast or shuffle by size; duplicates in ``other`` do
    not multiply rows."""
    o = other.select(F.col(other_key).alias("_sk"))
    return df.join(o, F.col(on) == F.col("_sk"), "left_anti" if anti else "left_semi")


GROUPINGS = ("SHMI", "HSMR", None)


def check_grouping(grouping):
    if grouping not in GROUPINGS:
        raise ValueError('The `grouping` must be one of "SHMI", "HSMR", or None.')
