"""Hand-worked cases for the column functions, one per documented quirk."""

from pyspark.sql import functions as F

from wardlens.functions import codes as cd
from wardlens.functions import families as fam
from wardlens.functions import news as nw
from wardlens.functions import repair as rp
from wardlens.functions import text as tx
from wardlens.operators import derive as dv


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_standardise_codes(spark):
    got = one(spark, cd.standardise("c"), "c string", [("A12.34 D",), ("A12.X",), ("A12.34D",), ("A12",), (None,)])
    assert got == ["A12.34", "A12", "A12.34", "A12", None]


def test_vague_ranges(spark):
    got = one(spark, cd.is_vague("c"), "c string", [("R57",), ("R56.1",), ("Z39",), ("Z40",), ("V00",), ("AB1",), (None,)])
    assert got == [False, True, True, False, False, False, False]


def test_first_stem_leftmost_then_list_order(spark):
    got = one(spark, tx.first_stem("t"), "t string", [("Fell and CONFUSED",), ("no match",), (None,)])
    assert got == ["fell", None, None]


def test_strip_and_vague(spark):
    got = one(spark, tx.vague_to(tx.normalise("t")), "t string", [(" Unknown.",), ("Chest pain?",)])
    assert got == [None, "chest pain"]


def test_justify_keeps_width_and_order(spark):
    df = spark.createDataFrame([(["a", None, "b", None],)], "a array<string>")
    left = df.select(fam.justify(F.col("a"), "left")).first()[0]
    right = df.select(fam.justify(F.col("a"), "right")).first()[0]
    assert left == ["a", "b", None, None]
    assert right == [None, None, "a", "b"]


def test_critical_care_time_skips_admission_ward_but_counts_its_stay(spark):
    path = "array<struct<slot:int,ward:string,los:double>>"
    df = spark.createDataFrame([([(1, "CCU", 2.0), (2, "W1", None), (3, "CCU", 1.5)],), ([(1, "CCU", 2.0)],)], f"p {path}")
    skip = [r[0] for r in df.select(dv.critical_care_time(F.col("p"), ["CCU"], True)).collect()]
    keep = [r[0] for r in df.select(dv.critical_care_time(F.col("p"), ["CCU"], False)).collect()]
    assert skip == [2.0, None]          # missing stay length counts as 0
    assert keep == [0.0, 0.0]


def test_readmission_band_literal_and_aligned(spark):
    day = 86400
    rows = [(0,), (day // 2,), (45 * day,), (None,)]
    lit = one(spark, dv.readmission_band(F.col("g")), "g long", rows)
    ali = one(spark, dv.readmission_band(F.col("g"), aligned=True), "g long", rows)
    assert lit == ["24 Hrs", "48 Hrs", "N/A", "N/A"]
    assert ali == ["N/A", "24 Hrs", "2 Months", "N/A"]


def test_systolic_has_holes(spark):
    got = one(spark, nw.systolic_score("x"), "x double", [(110.5,), (110.0,), (220.0,), (90.0,), (None,)])
    assert got == [None, 1.0, 3.0, 3.0, None]


def test_spo2_scale2_assisted_fallthrough(spark):
    got = [r[0] for r in spark.createDataFrame([(97.0, True), (85.0, True), (85.0, False), (93.0, None)], "s double, a boolean")
           .select(nw.spo2_scale2_score("s", "a")).collect()]
    assert got == [3.0, 2.0, 2.0, 0.0]  # 85 falls through to the unassisted >= 84 band


def test_clip_inclusive_vs_exclusive(spark):
    inc = one(spark, rp.clip_sentinel("x", 25, 300), "x double", [(25.0,), (26.0,), (300.0,)])
    exc = one(spark, rp.clip_sentinel("x", 25, 300, inclusive=False), "x double", [(25.0,), (26.0,), (300.0,)])
    assert inc == [None, 26.0, None] and exc == [25.0, 26.0, 300.0]


def test_flow_to_fraction(spark):
    got = [r[0] for r in spark.createDataFrame([(2.0, "X"), (0.5, "A - Air"), (0.5, "X"), (40.0, "X"), (150.0, "X")],
                                               "f double, d string").select(rp.flow_to_fraction("f", "d")).collect()]
    assert [round(x, 6) if x is not None else None for x in got] == [0.082, 0.022, 0.5, 0.4, None]


def test_charlson_age_points(spark):
    got = one(spark, dv.charlson_age_points("a"), "a int", [(50,), (55,), (60,), (65,), (70,), (75,), (80,), (None,)])
    assert got == [0, 1, 0, 2, 0, 3, 4, 0]


def test_mortality_class_concatenates(spark):
    df = spark.createDataFrame([(True, True, False), (True, False, True), (False, False, False)], "d boolean, w30 boolean, wt boolean")
    got = [r[0] for r in df.select(dv.mortality_class("d", "w30", "wt")).collect()]
    assert got == ["DiedDuringStayDiedWithin30Days", "DiedWithinThreshold", "DidNotDie"]
