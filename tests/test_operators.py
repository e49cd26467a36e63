"""Operator properties: distributed forms equal the simple ones."""

import json
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.operators import features as ft
from wardlens.operators import lookup as lk
from wardlens.operators import metrics as mt
from wardlens.operators import split as sp
from wardlens.operators.clean import topn_keep
from wardlens.operators.ranking import exact_quantiles, running_sums
from wardlens.sources import read_json_map


def test_running_sums_equal_single_window(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = running_sums(df, ["o"], {"v": F.col("v")}, ["g"])
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.sum("v").over(w))
    j = got.join(ref, ["g", "o"])
    assert j.where(F.col("cum_v") != F.col("ref")).count() == 0
    assert j.count() == 500


def test_exact_quantiles_match_median(spark):
    df = spark.createDataFrame([(float(x), float(x % 5) if x % 4 else None) for x in [1, 2, 4, 10, 10, 10, 3]], "a double, b double")
    got = {r["col_name"]: r["value"] for r in exact_quantiles(df, ["a", "b"], 0.5).collect()}
    ref = df.agg(F.median("a"), F.median("b")).first()
    assert got["a"] == pytest.approx(ref[0]) and got["b"] == pytest.approx(ref[1])


def test_auroc_symmetry_and_ties(spark):
    rows = [(i, i % 3 == 0, float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, y boolean, s double").withColumn("y", F.col("y").cast("int"))
    a = mt.auroc(df, "y", "s").first()[0]
    b = mt.auroc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert a + b == pytest.approx(1.0)


def test_stratified_folds_balanced(spark):
    df = spark.range(0, 103).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    f = sp.stratified_kfold(df, "k", "y", 5)
    sizes = f.groupBy("y", "fold").count().groupBy("y").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in sizes)
    assert f.count() == 103


def test_cascade_order_exact_then_3_then_4(spark):
    codes = spark.createDataFrame([("A12.3",), ("A129",), ("B99",), (None,)], "code string")
    ref = spark.createDataFrame([("A123", 1), ("A12", 2), ("A129", 3), ("A1", 9)], "code string, grp int")
    got = {r["code"]: r["grp"] for r in lk.cascade_join(codes, "code", ref, "code", "grp", "grp").collect()}
    assert got == {"A12.3": 1, "A129": 3, "B99": 259, None: None}


def test_topn_ties_by_value(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "c", "c", None]], "v string")
    got = sorted([r[0] for r in topn_keep(df, "v", 2, sentinel="other").collect()], key=str)
    assert got == ["None", "a", "c", "c", "other"] or got == [None, "a", "c", "c", "other"] or \
        sorted(map(str, got)) == sorted(["None", "a", "c", "c", "other"])


def test_onehot_missing_column_raises(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(KeyError):
        ft.onehot(df, ["y"])


def test_bad_grouping_raises():
    with pytest.raises(ValueError):
        lk.check_grouping("CCS")


def test_json_map_source(spark):
    d = tempfile.mkdtemp(prefix="wardlens-json-")
    path = os.path.join(d, "map.json")
    with open(path, "w") as fh:
        json.dump({"I21": "myocardial_infarction", "F03": "dementia"}, fh, indent=2)
    got = {r["code3"]: r["condition"] for r in read_json_map(spark, path, "code3", "condition").collect()}
    assert got == {"I21": "myocardial_infarction", "F03": "dementia"}


def test_rebalance_over_reaches_share(spark):
    df = spark.range(0, 100).select(F.col("id").alias("k"), (F.col("id") < 10).cast("int").alias("y"))
    out = sp.rebalance_over(df, "k", "y", 0.4)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == 90 and counts[1] == 60


def test_lag_lead_two_phase_equals_window(spark):
    from wardlens.operators.ranking import lag_lead
    # one hot group holding most rows, spread over several slices
    df = spark.range(0, 400).select(F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"),
                                    F.col("id").alias("o"), (F.col("id") * 3).alias("v"))
    got = lag_lead(df, "g", ["o"], "v")
    w = Window.partitionBy("g").orderBy("o")
    ref = df.withColumns({"rp": F.lag("v").over(w), "rn": F.lead("v").over(w)})
    j = got.join(ref, ["g", "o"])
    assert j.count() == 400
    assert j.where(~F.col("_prev").eqNullSafe(F.col("rp")) | ~F.col("_next").eqNullSafe(F.col("rn"))).count() == 0


def test_missing_labels_are_a_class_of_their_own(spark):
    df = spark.range(0, 40).select(F.col("id").alias("k"), F.when(F.col("id") % 5 != 0, (F.col("id") % 4 == 0).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    assert n[None] == 8
    split = sp.stratified_split(df, "k", "y", 0.25)
    assert split.count() == 40 and split.where("y is null and split = 'test'").count() == 2
    under = sp.rebalance_under(df, "k", "y")
    assert under.count() == 24 and under.where("y is null").count() == 8
    over = {r["y"]: r["count"] for r in sp.rebalance_over(df, "k", "y", 0.4).groupBy("y").count().collect()}
    assert over[None] == 8 and over[0] == n[0] and over[1] == 16
    folds = sp.stratified_kfold(df, "k", "y", 5)
    assert folds.where("fold is null").count() == 0


def test_running_sums_by_text_time_and_sign(spark):
    df = spark.range(-60, 60).select((F.col("id") * 0.37).alias("n"), F.md5(F.col("id").cast("string")).alias("s"),
                                     F.expr("date '2020-01-01' + cast(id * 9 as int)").alias("d"), F.lit(2).alias("v"))
    for o in ("n", "s", "d"):
        got = running_sums(df, [o], {"v": F.col("v")}, inclusive=False).orderBy(o).collect()
        assert [r["cum_v"] for r in got] == [2 * i for i in range(120)]


def test_text_tokens(spark):
    from wardlens.operators.model import with_tokens
    df = spark.createDataFrame([("Hello, apple world: naïve people 42",), ("  ",), (None,)], "t string")
    got = [r["tokens"] for r in with_tokens(df, "t", "tokens").collect()]
    assert got == [["hello", "apple", "world", "naïve", "people", "42"], [], []]


def test_poisson_draws_have_the_right_moments(spark):
    from wardlens.operators.metrics import with_poisson
    df = spark.range(20000).select(F.explode(F.array(F.lit(1), F.lit(7), F.lit(500))).alias("n"), "id")
    got = with_poisson(df.withColumn("k", F.col("id").cast("string")), "n", "k", "w").groupBy("n").agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"))
    for r in got.collect():
        assert abs(r.m - r.n) < 0.05 * r.n and abs(r.v - r.n) < 0.08 * r.n
