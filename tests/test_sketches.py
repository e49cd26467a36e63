"""Mergeable column sketches, level rows and the split by counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wardlens.operators import profile as pf
from wardlens.operators import sketches as sk
from wardlens.operators import split as sp

SCHEMA = "id long, x double, s string"


def rows(spark, lo, hi, parts=2):
    """x is spread evenly over 0..1000, s has 3000 levels, every tenth x is null."""
    x = F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1000.0)
    return spark.range(lo, hi, 1, parts).select("id", x.alias("x"), F.concat(F.lit("s"), F.col("id") % 3000).alias("s"))


def by_column(merged, q=(0.25, 0.5, 0.75)):
    return {r["col_name"]: r for r in sk.estimates(merged, q).collect()}


def test_merged_sketches_stay_within_their_bounds(spark):
    df = rows(spark, 0, 60_000).withColumn("part", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")))
    parts = sk.column_sketches(df, ["id", "x", "s"], ["part"])
    assert parts.count() == 3 * df.select("part").distinct().count()
    got = by_column(sk.merge(parts))
    assert {c: (r["n_rows"], r["n_present"]) for c, r in got.items()} == {"id": (60_000, 60_000), "x": (60_000, 54_000), "s": (60_000, 60_000)}
    assert abs(got["id"]["n_distinct"] / 60_000 - 1) < 0.05 and abs(got["s"]["n_distinct"] / 3000 - 1) < 0.05
    for q, value in zip((0.25, 0.5, 0.75), got["x"]["quantiles"]):
        rank = df.where(F.col("x") <= value).count() / 54_000
        assert abs(rank - q) < 0.02
    assert got["s"]["quantiles"] is None


def test_sketches_of_nulls_nans_and_no_rows(spark):
    odd = spark.createDataFrame([(None, None, None), (1, float("nan"), ""), (1, None, "")], SCHEMA)
    got = by_column(sk.merge(sk.column_sketches(odd, ["id", "x", "s"])))
    assert (got["id"]["n_present"], got["id"]["n_distinct"], got["id"]["quantiles"]) == (2, 1, [1.0, 1.0, 1.0])
    assert (got["x"]["n_rows"], got["x"]["n_present"], got["x"]["quantiles"]) == (3, 0, None)
    none = odd.limit(0)
    assert sk.column_sketches(none, ["id", "x"], ["s"]).count() == 0
    got = by_column(sk.merge(sk.column_sketches(none, ["id", "x"])))
    assert {(r["n_rows"], r["n_present"], r["n_distinct"], r["quantiles"]) for r in got.values()} == {(0, 0, 0, None)}


def test_refresh_reads_new_files_only(spark, tmp_path):
    data, store = str(tmp_path / "data"), str(tmp_path / "store")
    rows(spark, 0, 1000).write.parquet(data)
    first = by_column(sk.refresh(spark, data, store, SCHEMA, ["x", "s"]))
    assert first["s"]["n_rows"] == 1000 and first["x"]["n_present"] == 900
    size = spark.read.parquet(store).count()
    again = by_column(sk.refresh(spark, data, store, SCHEMA, ["x", "s"]))
    same = lambda got: {c: (r["n_rows"], r["n_present"], r["n_distinct"]) for c, r in got.items()}
    assert same(again) == same(first) and spark.read.parquet(store).count() == size == 4
    assert all(abs(a - b) < 50 for a, b in zip(again["x"]["quantiles"], first["x"]["quantiles"]))  # a merge draws at random
    rows(spark, 1000, 1500, 1).write.mode("append").parquet(data)
    more = by_column(sk.refresh(spark, data, store, SCHEMA, ["x", "s"]))
    assert more["s"]["n_rows"] == 1500 and spark.read.parquet(store).count() == 6
    rows(spark, 0, 200, 1).write.mode("overwrite").parquet(data)  # the old files are gone
    assert by_column(sk.refresh(spark, data, store, SCHEMA, ["x", "s"]))["s"]["n_rows"] == 200


def test_level_rows_number_each_columns_levels(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("b", "x"), (None, None)], "p string, q string")
    got = sorted(map(tuple, pf.level_rows(df, ["p", "q"]).collect()))
    assert got == [("p", "a", 1, 1), ("p", "b", 2, 2), ("q", "x", 1, 2)]
    assert pf.level_rows(df.limit(0), ["p", "q"]).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.1, 0.33, 0.9, 1.0])
def test_time_split_equals_a_sort(spark, share):
    r = random.Random(5)
    days = [None if r.random() < 0.1 else dt.date(2020, 1, 1) + dt.timedelta(days=int(r.random() ** 3 * 900)) for _ in range(300)]
    own = [(d, i) for i, d in enumerate(days)] + [(dt.date(2020, 5, 5), i) for i in range(300, 500)]  # a hot day
    df = spark.createDataFrame(own, "d date, k int")
    got = {x["k"]: x["split"] for x in sp.time_split(df, ["d", "k"], share).collect()}
    ranked = sorted(own, key=lambda x: (x[0] is not None, x[0] or dt.date.min, x[1]))
    n_test = -(-int(round(share * len(own) * 1e9)) // int(1e9))
    assert got == {k: "test" if i >= len(own) - n_test else "train" for i, (_, k) in enumerate(ranked)}
    assert sp.time_split(df.limit(0), ["d", "k"], share).count() == 0
