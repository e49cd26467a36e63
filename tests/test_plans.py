"""Plan shape and end-to-end checks on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

ROW_WISE = ["score_bands", "repair_bp", "normalise_text", "lab_string_repair", "flow_to_fraction", "clip_sentinel"]
NO_UDF = ROW_WISE + ["critical_event", "fuzzy_group_join", "charlson", "key_characteristics", "prep_from_raw",
                     "prep_clean_all", "auroc", "stratified_kfold", "text_dataset"]
ORACLE_SAMPLE = ["critical_event_rate", "critical_event_time", "readmission_band", "fuzzy_group_join", "charlson",
                 "justify_left", "repair_o2", "prep_from_raw", "prep_augment", "auroc", "avg_precision",
                 "threshold_at_fpr", "stratified_kfold", "median_by_col", "token_truncate", "clean_text_topn"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_flagship(spark):
    rows = {r["admit_ward"]: (r["n_critical"], r["n_stays"]) for r in E.entry(spark).collect()}
    assert rows == {None: (41, 155), "AAA": (51, 149), "AEC": (80, 274), "CCU": (239, 239), "EAU": (30, 125),
                    "HH1M": (259, 259), "W5": (37, 135), "W6": (42, 164)}


@pytest.mark.parametrize("name", NO_UDF)
def test_no_python_udf(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_ops_do_not_shuffle(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    # the stay fixture broadcasts its customer look-up; no shuffle of the data itself
    assert "Exchange hashpartitioning" not in p and "Exchange rangepartitioning" not in p


def test_lookups_broadcast(spark):
    p = plan(E.queries()["fuzzy_group_join"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in p


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = E.queries()["scan_orders"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p
    assert "o_totalprice" not in p


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        r = round(v, 6)
        return int(r) if r == int(r) else r
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_matches_duckdb(spark, duck, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    cols = sorted(s.columns)
    key = lambda row: tuple(str(x) for x in row)
    rs = sorted([tuple(_norm(None if x != x else x) if not isinstance(x, str) else x for x in r)
                 for r in s[cols].itertuples(index=False)], key=key)
    ro = sorted([tuple(_norm(None if x != x else x) if not isinstance(x, str) else x for x in r)
                 for r in o[cols].itertuples(index=False)], key=key)
    assert rs == ro


def test_every_sql_query_has_oracle():
    from wardlens.plans import load_catalogue
    q, o = load_catalogue()  # the optional training-data queries have tests of their own
    assert set(q) <= set(E.queries()) and set(o) <= set(q)
    rows_only = set(q) - set(o)
    assert rows_only <= {"xy", "fit_logreg", "fit_logreg_none", "fit_logreg_l1", "fit_logreg_l2", "fit_svc", "fit_gbt", "fit_rf",
                         "calibrate_isotonic", "tune", "tune_halving", "text_classifier"}
