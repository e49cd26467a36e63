"""Experiment grid, search by halving, fitted preparation, neighbour join, oversampling, load or derive."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardlens.operators import grid as gr
from wardlens.operators import metrics as mt
from wardlens.operators import model as md
from wardlens.operators import neighbours as nb
from wardlens.operators import prepare as pr
from wardlens.plans import presets as ps
from wardlens.sources import derived as de

# --- M22 grid ----------------------------------------------------------------------


def test_illegal_pairs_are_skipped():
    cells = gr.legal_cells({"rate": False, "rarity": True}, ["none", "balanced"], {"nums": ["a"], "cats": ["c"], "both": ["a", "c"]}, [1, 2], ["c"])
    have = {(c["estimator"], c["resampler"], c["features"]) for c in cells}
    assert ("rarity", "balanced", "nums") not in have and ("rate", "balanced", "cats") not in have
    assert {("rate", "balanced", "nums"), ("rate", "balanced", "both"), ("rarity", "none", "cats"), ("rate", "none", "cats")} <= have
    assert len(cells) == 2 * (3 + 2 + 3)


def test_cells_are_evaluated_as_if_alone(spark):
    rng = np.random.default_rng(0)
    rows = [(int(c), float(round(rng.normal(c * y), 1)), int(y)) for c in range(4) for y in (rng.random(300) < 0.3)]
    rows += [(9, 1.0, 0), (9, 2.0, 0)]  # one class only
    df = spark.createDataFrame(rows, "cell int, score double, label int")
    got = {r.cell: r for r in gr.evaluate_cells(mt.score_table(df, "label", "score", group=["cell"]), ["cell"], 0.05, 9).collect()}
    for c in range(4):
        own = df.where(F.col("cell") == c)
        alone = mt.ranking_summary(own, "label", "score").first()
        t = mt.threshold_at_fpr(own, "label", "score", 0.05).first()["threshold"]
        m = mt.class_metrics(own.withColumn("p", (F.col("score") > t).cast("int")), "label", "p").first()
        assert got[c].auroc == pytest.approx(alone.auroc) and got[c].avg_precision == pytest.approx(alone.avg_precision)
        assert got[c].threshold == t and (got[c].accuracy, got[c].recall, got[c].f2) == pytest.approx((m.accuracy, m.recall, m.f2))
        assert got[c].auroc_lower <= got[c].auroc_upper
    assert got[9].auroc is None and got[9].avg_precision is None and got[9].n == 2


def test_interval_draws_do_not_join_near_scores(spark):
    """Scores nearer than a millionth have draws of their own, as scores far apart do."""
    wide = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "s double, y int")
    near = wide.withColumn("s", F.lit(1.0) + F.col("s") * 1e-9)
    assert mt.bootstrap_ci(wide, "y", "s", 50).first() == mt.bootstrap_ci(near, "y", "s", 50).first()


def test_feature_sets_are_unions_without_repeats():
    sets = ps.feature_sets()
    assert sets["with_labs"] == ["resp_rate", "sbp", "dbp", "age", "gender", "urea_first", "urea_last"]
    assert all(len(c) == len(set(c)) for c in sets.values()) and set(ps.FEATURE_GROUPS) < set(sets)


# --- M21 search --------------------------------------------------------------------

@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(2.0 * (i % 4 == 0))), float(rng.normal()), int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int")


def test_halving_plan_and_points():
    assert md.halving_plan(8, 0.5, 0.25) == [(0.25, 8), (0.5, 4), (1.0, 2)]
    assert md.halving_plan(1, 0.5, 0.25) == [(1.0, 1)]
    assert md.draw_points(md.SPACES["logreg"], 3) == md.draw_points(md.SPACES["logreg"], 3)
    assert all(1e-4 <= p["regParam"] <= 1 and 0 <= p["elasticNetParam"] <= 1 for p in md.draw_points(md.SPACES["logreg"], 50))


def test_halving_prefers_the_better_point(separable):
    points = [{"regParam": 50.0, "elasticNetParam": 1.0}, {"regParam": 0.01}, {"regParam": 40.0, "elasticNetParam": 1.0}]
    best, history = md.successive_halving(separable, "y", ["a", "b"], "id", points, k=3, smallest=0.5)
    rows = history.collect()
    assert best == {"regParam": 0.01}
    assert [(r.rung, r.point, r.kept) for r in rows if r.point == 1][-1] == (1, 1, True)
    assert sum(r.kept for r in rows if r.rung == max(x.rung for x in rows)) == 1
    assert {r.share for r in rows} == {0.5, 1.0}


def test_grid_search_runs_with_five_folds(separable):
    got = md.tune(separable, "y", ["a", "b"], "id", 5, reg_params=(0.01, 50.0), elastic=(1.0,)).collect()
    assert len(got) == 2 and {r.reg_param: r.mean_ap for r in got}[0.01] > {r.reg_param: r.mean_ap for r in got}[50.0]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fits_read_rows_joined_once(spark):
    from wardlens.plans import q_fit
    plan = plan_of(q_fit.xy(spark, SF_SMALL))
    assert "Join" not in plan and "Aggregate" not in plan


def test_fits_read_folds_ranked_once(spark, separable):
    plan = plan_of(md.fold_rows(separable, "id", "y", ["a", "b"], 5))
    assert "Window" not in plan and "Join" not in plan


def test_class_weights_leave_the_rows_where_they_are(spark, separable):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = md.with_class_weight(separable, "y")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r.y, r.weight) for r in got.select("y", "weight").distinct().collect()} == {(0, 0.666667), (1, 2.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_of_a_fit_hold_a_bounded_number_of_rows(spark):
    got = md.spread(spark.range(0, 5000, 1, 2), 500)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert sum(sizes) == 5000 and len(sizes) == 10 and max(sizes) <= 510


def test_calibrated_scores_are_probabilities_in_the_right_order(separable):
    got = md.calibrated_scores(separable, separable, "id", "y", ["a", "b"], 3).toPandas()
    assert len(got) == 400 and got.score.between(0, 1).all()
    assert got.score[got.label == 1].mean() > got.score[got.label == 0].mean() + 0.2


# --- P9, M8, P18 preparation -----------------------------------------------------------

@pytest.fixture(scope="module")
def table_(spark):
    rows = [(1, 1.0, "a", True, 1), (2, None, "b", False, 0), (3, 5.0, None, None, 1), (4, 3.0, "a", True, 0), (5, 9.0, "c", False, 1), (6, float("nan"), "a", True, None)]
    return spark.createDataFrame(rows, "id long, x double, g string, f boolean, y int")


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_rows_lacking_a_feature_go_with_their_labels(table_):
    got = pr.Preparation.fit(table_, ["x", "g", "f"], dropna=True).transform(table_, ["id", "y"])
    assert rows_of(got) == {1: (1, 1.0, "a", 1.0), 4: (0, 3.0, "a", 1.0), 5: (1, 9.0, "c", 0.0)}


def test_levels_not_seen_in_training_are_missing(table_):
    train = table_.where("id <= 4")
    filled = rows_of(pr.Preparation.fit(train, ["x", "g"], fillna=True, imputation=True).transform(table_, ["id"]))
    assert filled[5] == (9.0, "NAN") and filled[3] == (5.0, "NAN") and filled[2] == (3.0, "b")  # the median of 1, 5, 3
    codes = rows_of(pr.Preparation.fit(train, ["g"], encoding="ordinal").transform(table_, ["id"]))
    assert [codes[i][0] for i in range(1, 6)] == [0, 1, -1, 0, -1]
    codes = rows_of(pr.Preparation.fit(train, ["g"], encoding="ordinal", fillna=True).transform(table_, ["id"]))
    assert [codes[i][0] for i in range(1, 6)] == [0, 1, 2, 0, 2]
    hot = pr.Preparation.fit(train, ["f", "g"], encoding="onehot").transform(table_, ["id"])
    assert hot.columns == ["id", "f", "g__a", "g__b"] and rows_of(hot)[5] == (0.0, 0, 0) and rows_of(hot)[3] == (None, 0, 0)


def test_preparation_is_kept_and_loaded(spark, table_, tmp_path):
    prep = pr.Preparation.fit(table_, ["x", "g", "f"], fillna=True, imputation=True, encoding="onehot", scale=True)
    prep.save(spark, f"{tmp_path}/prep")
    again = pr.Preparation.load(spark, f"{tmp_path}/prep")
    assert again == prep and rows_of(again.transform(table_, ["id"])) == rows_of(prep.transform(table_, ["id"]))
    with pytest.raises(ValueError):
        pr.Preparation.fit(table_, ["x"], encoding="other")
    with pytest.raises(ValueError):
        pr.outcome("Other", F.lit(True), F.lit(1), F.lit(None))


# --- M14 neighbours and oversampling -----------------------------------------------------

def brute_neighbours(rows, k, mismatch):
    out = {}
    for i, x, z in rows:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)) + sum(mismatch**2 * (a != b) for a, b in zip(z, w))), j) for j, y, w in rows if j != i)
        out[i] = near[:k]
    return out


@pytest.mark.parametrize("case,pivots,hot,k", [("blobs", 16, 2000, 5), ("blobs", 3, 40, 7), ("copies", 16, 50, 5), ("grid", 8, 60, 4), ("few", 32, 2000, 5)])
def test_neighbour_join_equals_brute_force(spark, case, pivots, hot, k):
    rng = np.random.default_rng(7)
    n = {"blobs": 2000 if hot == 2000 else 300, "copies": 400, "grid": 300, "few": 4}[case]
    x = {"blobs": lambda: rng.normal(size=(n, 3)) + 6 * rng.integers(0, 5, (n, 1)), "copies": lambda: np.where(rng.random((n, 1)) < 0.4, 1.0, rng.normal(size=(n, 3))),
         "grid": lambda: rng.integers(0, 6, (n, 3)).astype(float), "few": lambda: rng.normal(size=(n, 3))}[case]()
    z = [[rng.choice(["p", "q"]) if case != "copies" else "p"] for _ in range(n)]
    rows = [(i, x[i].tolist(), z[i]) for i in range(n)]
    df = spark.createDataFrame([(i, *v, w[0]) for i, v, w in rows], "id long, a double, b double, c double, g string").repartition(4)
    got = {}
    for r in nb.knn_join(df, "id", ["a", "b", "c"], ["g"], k, 1.5, pivots, hot, 64).collect():
        got.setdefault(r.id, {})[r.rank] = (r.distance, r.neighbour)
    want = brute_neighbours(rows, k, 1.5)
    assert set(got) == set(want)
    for i, near in want.items():
        mine = [got[i][r] for r in sorted(got[i])]
        assert [r for r in sorted(got[i])] == list(range(1, len(near) + 1))
        for a, b in zip(mine, near, strict=True):
            assert abs(a[0] - b[0]) < 1e-9 and (a[1] == b[1] or any(abs(d - a[0]) < 1e-9 and j == a[1] for d, j in brute_neighbours(rows, n, 1.5)[i][:k + 60]))


def test_neighbour_join_of_nothing(spark):
    df = spark.createDataFrame([], "id long, a double")
    assert nb.knn_join(df, "id", ["a"]).count() == 0


def test_oversampling_lies_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal()), float(rng.normal()) if i % 9 else None, "u" if i % 3 else None, int(i < 30)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, g string, y int")
    got = nb.smote(df, "id", "y", ["a", "b"], ["g"], 3, 0.5).collect()
    assert len(got) == 170 - 30 and all(r.y == 1 for r in got)
    at = {i: (a, b) for i, a, b, _, _ in rows}
    for r in got:
        assert r.id < 30 and r.neighbour < 30
        lo, hi = sorted((at[r.id][0], at[r.neighbour][0]))
        assert lo - 1e-8 <= r.a <= hi + 1e-8 and r.g in ("u", None)
    assert sorted(map(tuple, got)) == sorted(map(tuple, nb.smote(df, "id", "y", ["a", "b"], ["g"], 3, 0.5).collect()))
    assert nb.smote(df.where("id >= 29"), "id", "y", ["a", "b"]).count() == 0  # one row has no neighbour


# --- S3 load or derive ---------------------------------------------------------------------

def test_second_call_reads_and_changed_input_derives(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/tables"
    spark.range(10).write.parquet(src)
    build = lambda: spark.read.parquet(src).where("id > 3")
    first, loaded = de.load_or_derive(spark, root, "t", build)
    assert not loaded and first.count() == 6
    assert de.load_or_derive(spark, root, "t", build)[1]
    assert not de.load_or_derive(spark, root, "t", build, {"v": 2})[1]  # other parameters
    assert not de.load_or_derive(spark, root, "t", lambda: spark.read.parquet(src).where("id > 4"))[1]  # another plan
    spark.range(10, 20).write.mode("append").parquet(src)
    got, loaded = de.load_or_derive(spark, root, "t", build)
    assert not loaded and got.count() == 16


def test_half_written_tables_are_not_read_and_go(spark, tmp_path):
    src, root = f"{tmp_path}/in", f"{tmp_path}/tables"
    spark.range(10).write.parquet(src)
    build = lambda: spark.read.parquet(src)
    home = f"{root}/t-{de.content_address(build())}"
    spark.range(3).write.parquet(f"{home}/data-half")  # a writer that never committed
    assert de.committed(spark, home) is None
    got, loaded = de.load_or_derive(spark, root, "t", build)
    assert not loaded and got.count() == 10
    old = de.load_or_derive(spark, root, "t", lambda: build().where("id > 1"))
    assert old[0].count() == 8
    gone = de.drop_stale(spark, root, "t", [build()])
    assert len(gone) == 2 and de.load_or_derive(spark, root, "t", build)[1]
    assert not de.load_or_derive(spark, root, "t", lambda: build().where("id > 1"))[1]


# --- M5 encodings, W5 rows --------------------------------------------------------------------

def test_sparse_levels_of_many_levels(spark):
    from wardlens.operators import features as ft
    df = spark.range(100_000).select("id", F.concat(F.lit("v"), "id").alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    got, table = ft.sparse_levels(df, "id", ["a", "b"])
    assert table.count() == 100_001
    last = table.where("col_name = 'b'").first()
    assert (last["index"], last.level) == (100_000, "x")
    assert got.where(F.size("indices") == 1 + (F.col("id") % 2 == 0).cast("int")).count() == 100_000
    none, _ = ft.sparse_levels(spark.createDataFrame([(1, None)], "id int, a string"), "id", ["a"])
    assert none.first().indices == []


def test_family_flags_share_a_prefix(spark):
    from wardlens.operators import features as ft
    df = spark.createDataFrame([(1, "p", "q"), (2, "q", None), (3, None, None)], "id int, a string, b string")
    assert rows_of(ft.onehot_family(df, ["a", "b"], "g")) == {1: (1, 1), 2: (0, 1), 3: (0, 0)}
    with pytest.raises(KeyError):
        ft.onehot_family(df, ["a", "z"], "g")


def test_rows_are_justified_up_and_down(spark):
    from wardlens.operators import project as pj
    df = spark.createDataFrame([(1, None, "a"), (2, 5, None), (3, None, "b"), (4, 7, None)], "id int, x int, y string")
    assert rows_of(pj.justify_rows(df, ["id"], ["x", "y"], "up")) == {1: (5, "a"), 2: (7, "b"), 3: (None, None), 4: (None, None)}
    assert rows_of(pj.justify_rows(df, ["id"], ["x", "y"], "down")) == {1: (None, None), 2: (None, None), 3: (5, "a"), 4: (7, "b")}
