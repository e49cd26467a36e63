"""Splits and class balance.

Row numbers are taken with ``ranking.ranks`` (two levels of windows), so a class
holding most rows is still spread over all tasks. Orders use ``md5(key)`` so another
engine can repeat the assignment. Rows with a missing label are a class of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from wardlens.operators.ranking import bucket, ranks


def _hash_key(key: str):
    return F.md5(F.col(key).cast("string"))


def _with_class_counts(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_class_n"))
    counts = counts.select(F.struct(label).alias("_class"), "_class_n")  # never null
    return df.withColumn("_class", F.struct(label)).join(counts, "_class").drop("_class")


def ranked(df: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Adds ``_rank`` (1-based) in md5(key), key order, within ``label``."""
    base = df.withColumn("_h", _hash_key(key))
    return ranks(base, ["_h", key], [label] if label else [], "_rank").drop("_h")


def nth_key(df: DataFrame, order: list[str], n_after: Callable[[Column], Column]) -> dict | None:
    """The order columns of the first of the last ``n_after(number of rows)`` rows (nulls
    first), ``order`` being unique; none if those are no rows.

    Only counts are made of most rows: column by column, the bucket and then the value that
    hold the row are found among their counts, and only rows with that value go on. A
    column of days has few values and needs no buckets."""
    found, rest, n = {}, df.select(*order), None
    for o in order:
        days = isinstance(rest.schema[o].dataType, DateType)
        for part in ([F.col(o)] if days else [bucket(rest, o), F.col(o)]):
            w = Window.orderBy(F.col("_v").asc_nulls_first())  # one row per bucket, or per value of one bucket
            per = rest.groupBy(part.alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.sum("_n").over(w))
            total = F.sum("_n").over(Window.partitionBy())
            per = per.withColumn("_at", total - n_after(total) + 1 if n is None else F.lit(n))
            hit = per.where((F.col("_c") >= F.col("_at")) & (F.col("_c") - F.col("_n") < F.col("_at"))).first()
            if hit is None:
                return None
            n = hit["_at"] - (hit["_c"] - hit["_n"])
            rest = rest.where(part.eqNullSafe(F.lit(hit["_v"])))
        found[o] = hit["_v"]
    return found


def time_split(df: DataFrame, order: list[str], test_size: float = 0.33) -> DataFrame:
    """Unshuffled cut: the last ceil(test_size * n) rows in ``order`` are test (nulls come
    first). The first test row's key is found by counts, without a sort of the rows, and
    every row is compared with it in place."""
    first = nth_key(df, order, lambda n: F.ceil(F.round(F.lit(test_size) * n, 9)))
    if first is None:
        return df.withColumn("split", F.lit("train"))
    test = F.lit(True)
    for o in reversed(order):
        after = F.col(o).isNotNull() if first[o] is None else F.coalesce(F.col(o) > F.lit(first[o]), F.lit(False))
        test = after | (F.col(o).eqNullSafe(F.lit(first[o])) & test)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Fold = (rank within class in md5(key) order - 1) mod k: class shares
    per fold differ by at most one row."""
    r = ranked(df, key, label)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def oneclass_split(folds: DataFrame, label: str, fold: int) -> DataFrame:
    """Train on the negatives outside ``fold``; test on ``fold`` plus the
    positives outside it."""
    in_fold = F.col("fold") == fold
    return folds.withColumn("split", F.when(~in_fold & (F.col(label) == 0), "train").otherwise("test"))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2) -> DataFrame:
    """Per class, the first ceil(test_size * n_class) rows in md5 order are test."""
    r = _with_class_counts(ranked(df, key, label), label)
    cut = F.ceil(F.col("_class_n") * F.lit(test_size))
    return r.withColumn("split", F.when(F.col("_rank") <= cut, "test").otherwise("train")).drop("_rank", "_class_n")


def rebalance_under(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keep min(class sizes) rows of every class (first in md5 order)."""
    smallest = df.groupBy(label).count().agg(F.min("count").alias("_m")).first()["_m"]  # one number back
    return ranked(df, key, label).where(F.col("_rank") <= F.lit(smallest)).drop("_rank")


def rebalance_over(df: DataFrame, key: str, label: str, minority_share: float = 0.4) -> DataFrame:
    """Replicate the minority class until it is ``minority_share`` of the result:
    target = ceil(n_major * share / (1 - share)); copies are taken in md5 order,
    whole rounds first (``copy`` numbers the round). Unlabelled rows are neither the
    minority nor the majority and stay as they are."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).count()
    row = sizes.agg(F.min(F.struct("count", label)).alias("low"), F.max("count").alias("high")).first()  # one row back
    if row["low"] is None:
        return df.withColumn("copy", F.lit(1))
    n_min, minority, major_n = row["low"]["count"], row["low"][label], row["high"]
    target = -(-int(major_n * minority_share * 1e6) // int((1 - minority_share) * 1e6))
    target = max(target, n_min)
    rounds = -(-target // n_min)
    small = F.coalesce(F.col(label) == F.lit(minority), F.lit(False))
    r = ranked(df, key, label)
    copies = F.when(small, F.sequence(F.lit(1), F.lit(rounds))).otherwise(F.array(F.lit(1)))
    rep = r.withColumn("copy", F.explode(copies))
    keep = ~small | ((F.col("copy") - 1) * F.lit(n_min) + F.col("_rank") <= F.lit(target))
    return rep.where(keep).drop("_rank")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight = n_total / (n_classes * n_class)); a missing label counts in
    the total and has a weight but is no class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("t"), F.count_distinct(label).alias("k")).first()
    return c.withColumn("weight", F.round(F.lit(tot["t"]) / (F.lit(tot["k"]) * F.col("n")), 6))
