"""Profiling, sources/sinks, sorting and sampling queries (A-, S-, O-rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlens.operators import derive as dv
from wardlens.operators import profile as pf
from wardlens.operators import sketches as sk
from wardlens.operators.clean import topn_keep
from wardlens.operators.ranking import exact_quantiles
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans.q_outcomes import critical_event_stays
from wardlens.plans.registry import query
from wardlens.session import scratch_path
from wardlens.sources import read_parts, read_table, union_parts, write_table

SNAPSHOTS = ["Admission", "24HPostAdm", "24HPreDisch", "Discharge"]
MEASURES = ["temperature", "heart_rate", "o2_sat", "resp_rate", "sbp", "dbp"]


def v(body, *names, extra=()):
    return fx.with_views(body, *names, extra=list(extra))


@query("scan_orders", "select o_orderkey, o_custkey, o_orderdate from orders where o_orderdate >= timestamp '1995-01-01'")
def q_scan_orders(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return o.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))


@query("scan_union_parts", """select o_orderkey, o_custkey, o_totalprice, null::varchar o_orderstatus from orders where o_orderkey % 2 = 0
 union all select o_orderkey, o_custkey, null::double o_totalprice, o_orderstatus from orders where o_orderkey % 2 = 1""")
def q_scan_union_parts(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"])
    a = o.where(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_custkey", "o_totalprice")
    b = o.where(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_custkey", "o_orderstatus")
    return union_parts([a, b])


@query("sink_roundtrip", v("select spell_id, patient_id, age, gender, died from spells", "spells"))
def q_sink_roundtrip(spark, d):
    """Write the prepared table to the shared scratch folder and read it back."""
    s = fx.spells(spark, d).select("spell_id", "patient_id", "age", "gender", "died")
    path = scratch_path(spark, f"roundtrip-{uuid.uuid4().hex}")
    write_table(s, path)
    return spark.read.parquet(path)


@query("read_parts", "select o_orderkey, o_custkey, o_orderdate from orders")
def q_read_parts(spark, d):
    """A table delivered in two parts, read as one."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    at = scratch_path(spark, f"parts-{uuid.uuid4().hex}")
    paths = [f"{at}/{k}" for k in range(2)]
    for k, path in enumerate(paths):
        write_table(o.where(F.col("o_orderkey") % 2 == k), path)
    return read_parts(spark, paths)


_SUMMARY = """select 'rows' metric, count(*)::double "value" from scores union all select 'positives', sum(label)::double from scores
 union all select 'mean_score', round(avg(score), 6) from scores union all select 'max_score', max(score) from scores"""


@query("sink_eval_summary", v(_SUMMARY, "scores"))
def q_sink_eval_summary(spark, d):
    """Evaluation summary written as a (metric, value) table and read back."""
    agg = fx.scores(spark, d).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.sum("label").cast("double").alias("positives"),
                                  F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"))
    path = scratch_path(spark, f"summary-{uuid.uuid4().hex}")
    write_table(agg.unpivot([], agg.columns, "metric", "value"), path)
    return spark.read.parquet(path)


@query("sink_predictions_wide", v(
    "select spell_id, score price, cast(substr(o_orderpriority, 1, 1) as double) priority from scores join orders on o_orderkey = spell_id",
    "scores"))
def q_sink_predictions_wide(spark, d):
    sc = fx.scores(spark, d).select("spell_id", F.lit("price").alias("model"), "score")
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    pr = o.select(F.col("o_orderkey").alias("spell_id"), F.lit("priority").alias("model"),
                  F.substring("o_orderpriority", 1, 1).cast("double").alias("score"))
    long = sc.unionByName(pr)
    path = scratch_path(spark, f"predictions-{uuid.uuid4().hex}")
    write_table(long.groupBy("spell_id").pivot("model", ["price", "priority"]).agg(F.first("score")), path)
    return spark.read.parquet(path)


@query("sample_n", "select o_orderkey, o_totalprice from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 100")
def q_sample_n(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", "o_totalprice"])
    return pf.deterministic_sample(o, "o_orderkey", 100)


@query("value_counts", "select o_orderpriority, count(*) count from orders where o_orderpriority is not null group by 1")
def q_value_counts(spark, d):
    return pf.value_counts(read_table(spark, d, "orders", ["o_orderpriority"]), "o_orderpriority")


@query("topk_values", "select p_name, count(*) count from part where p_name is not null group by 1 order by count desc, p_name limit 10")
def q_topk_values(spark, d):
    return pf.top_k(read_table(spark, d, "part", ["p_name"]), "p_name", 10)


@query("topn_keep", """select p_partkey, case when p_name is not null and p_name not in
 (select p_name from part where p_name is not null group by 1 order by count(*) desc, p_name limit 50) then 'other' else p_name end p_name from part""")
def q_topn_keep(spark, d):
    p = read_table(spark, d, "part", ["p_partkey", "p_name"])
    return topn_keep(p, "p_name", 50, sentinel="other")


_COMPLETE_COLS = ["patient_id", "age", "died", "urea_first", "urea_last", "resp_rate", "resp_score", "sbp", "dbp"]


@query("completeness", v("select col_name, n_present, round(100.0 * n_present / n_rows, 6) pct_present from ("
                         + " union all ".join(f"select '{c}' col_name, count({c}) n_present, count(*) n_rows from spells"
                                              for c in _COMPLETE_COLS) + ") q", "spells"))
def q_completeness(spark, d):
    return pf.completeness(fx.spells(spark, d), _COMPLETE_COLS)


_SNAP_SQL = "(['" + "', '".join(SNAPSHOTS) + "'])[cast(obs_id % 4 + 1 as int)]"


@query("availability_matrix", v(
    " union all ".join(
        f"select '{m}' measurement, " + ", ".join(
            f"round(100.0 * count(case when snap = '{s}' then {m} end) / count(case when snap = '{s}' then 1 end), 2) \"{s}\""
            for s in SNAPSHOTS) + " from o" for m in MEASURES),
    "obs", extra=[("o", f"select *, {_SNAP_SQL} snap from obs")]))
def q_availability_matrix(spark, d):
    o = fx.obs(spark, d)
    snap = F.element_at(F.array(*[F.lit(s) for s in SNAPSHOTS]), (F.col("obs_id") % 4 + 1).cast("int"))
    return pf.availability(o, MEASURES, snap, SNAPSHOTS)


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_WARDS = fx.FIXTURE_WARDS


def key_items(s):
    items = [("Population", "All", F.lit(True)), ("Sex", "Female", F.col("gender") == "Female"),
             ("Sex", "Male", F.col("gender") == "Male")]
    items += [("Admission method", p, F.col("admit_method") == p) for p in _PRIORITIES]
    items += [("Admission ward", w, F.col("admit_ward") == w) for w in _WARDS]
    items += [("Mortality", "Died", F.col("died_flag")), ("Critical care", "Yes", F.col("critical_care")),
              ("Critical event", "Yes", F.col("critical_event")), ("Readmission", "Yes", F.col("readmission"))]
    return items


def _key_sql():
    items = [("Population", "All", "true"), ("Sex", "Female", "gender = 'Female'"), ("Sex", "Male", "gender = 'Male'")]
    items += [("Admission method", p, f"admit_method = '{p}'") for p in _PRIORITIES]
    items += [("Admission ward", w, f"admit_ward = '{w}'") for w in _WARDS]
    items += [("Mortality", "Died", "died_flag"), ("Critical care", "Yes", "critical_care"),
              ("Critical event", "Yes", "critical_event"), ("Readmission", "Yes", "readmission")]
    return " union all ".join(
        f"select '{p}' parameter, '{c}' category, count_if(coalesce({e}, false)) n, round(100.0 * count_if(coalesce({e}, false)) / count(*), 2) pct from k"
        for p, c, e in items)


@query("key_characteristics", fx.with_views(_key_sql(), "slots", "spells", extra=[
    ("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS),
    ("cc", "select spell_id, arg_min(elapsed, slot) cc_time from steps where ward in ('CCU', 'HH1M') group by spell_id"),
    ("gaps", "select spell_id, case when patient_id is not null then epoch(admitted) - epoch(lag(admitted) over (partition by patient_id order by admitted, spell_id)) end prev_gap_s from spells"),
    ("k", """select st.spell_id, st.gender, st.admit_method, st.admit_ward, st.died_flag,
 coalesce(st.died_flag and st.total_los <= 4, false) or coalesce(cc.cc_time <= 4, false) critical_event,
 coalesce(cc.cc_time <= 4, false) critical_care, coalesce(g.prev_gap_s < 30 * 86400, false) readmission
 from stays st left join cc using (spell_id) left join gaps g using (spell_id)""")]))
def q_key_characteristics(spark, d):
    ce = critical_event_stays(spark, d).select("spell_id", "critical_care", "critical_event")
    s = cm.stays(spark, d)
    g = dv.readmission_spans(s, "patient_id", "admitted", "spell_id")
    k = g.withColumn("readmission", dv.readmission(F.col("prev_gap_s"), 30)).join(ce, "spell_id")
    return pf.rows_to_table(k, key_items(k), F.count(F.lit(1)))


@query("rowwise_any_all_sum", v(
    """select obs_id, coalesce(assisted, false) or coalesce(alert, false) any_flag,
 coalesce(assisted, false) and coalesce(alert, false) all_flag,
 coalesce(temp_score, 0) + coalesce(hr_score, 0) + coalesce(o2_score, 0) + coalesce(resp_score, 0) + coalesce(bp_score, 0) score_sum
 from obs""", "obs"))
def q_rowwise_any_all_sum(spark, d):
    from wardlens.functions import families as fam
    o = fx.obs(spark, d)
    flags = fam.pack_columns(["assisted", "alert"])
    scores = ["temp_score", "hr_score", "o2_score", "resp_score", "bp_score"]
    total = F.aggregate(fam.pack_columns(scores), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return o.select("obs_id", fam.any_of(flags, lambda x: x).alias("any_flag"),
                    fam.all_of(flags, lambda x: x).alias("all_flag"), total.alias("score_sum"))


@query("outlier_3sigma", """select event_id, value, coalesce(value <= m - 3 * s, false) is_low, coalesce(value >= m + 3 * s, false) is_high
 from events, (select avg(value) m, stddev_samp(value) s from events) st""")
def q_outlier_3sigma(spark, d):
    e = read_table(spark, d, "events", ["event_id", "value"])
    return pf.sigma_flags(e, "value", 3.0)


_MED_COLS = ["temperature", "heart_rate", "o2_sat", "sbp", "dbp"]


@query("median_by_col", v(" union all ".join(f"select '{c}' col_name, median({c}) value from obs" for c in _MED_COLS), "obs"))
def q_median_by_col(spark, d):
    return exact_quantiles(fx.obs(spark, d), _MED_COLS, 0.5)


@query("column_kinds", """select 'doc_id' col_name, case when bool_and(doc_id is null or doc_id in (0, 1)) then 'binary' else 'numeric' end kind from labels
 union all select 'quality', case when bool_and(quality is null or quality in (0, 1)) then 'binary' else 'numeric' end from labels
 union all select 'toxic', case when bool_and(toxic is null or toxic in (0, 1)) then 'binary' else 'numeric' end from labels""")
def q_column_kinds(spark, d):
    return pf.column_kinds(read_table(spark, d, "labels"), ["doc_id", "quality", "toxic"])


_LEVEL_COLS = ["gender", "admit_method", "specialty"]


@query("describe_levels", v(" union all ".join(
    f"select '{c}' col_name, count(distinct {c}) n_levels, string_agg(distinct {c}, ',' order by {c}) levels from spells" for c in _LEVEL_COLS),
    "spells"))
def q_describe_levels(spark, d):
    return pf.describe_levels(fx.spells(spark, d), _LEVEL_COLS)


@query("level_rows", v("select *, row_number() over (partition by col_name order by level) pos from (" + " union all ".join(
    f"select '{c}' col_name, {c} as level, count(*) n from spells where {c} is not null group by 2" for c in _LEVEL_COLS) + ") t", "spells"))
def q_level_rows(spark, d):
    return pf.level_rows(fx.spells(spark, d), _LEVEL_COLS)


@query("sketch_counts", """select case when e.c = 0 then 'event_type' else 'value' end col_name, count(*) n_rows,
 count(case when e.c = 0 then event_type else cast(value as varchar) end) n_present
 from events, (select unnest([0, 1]) c) e group by 1""")
def q_sketch_counts(spark, d):
    """Counts of the merged sketches of each event type's rows (estimates are bounded in the tests)."""
    e = read_table(spark, d, "events", ["event_type", "value"])
    return sk.merge(sk.column_sketches(e, ["event_type", "value"], ["event_type"])).select("col_name", "n_rows", "n_present")


@query("confusion_matrix", """select quality y_true, 1 - toxic y_pred, count(*) n,
 round(count(*) / sum(count(*)) over (partition by quality), 6) share from labels group by 1, 2""")
def q_confusion_matrix(spark, d):
    lb = read_table(spark, d, "labels").select("quality", (1 - F.col("toxic")).alias("pred"))
    return pf.confusion(lb, "quality", "pred")


@query("non_numeric_tally", v("""select measurement, value, count(*) n from
 (select 'urea_first' measurement, urea_first value from spells union all select 'urea_last', urea_last from spells) t
 where value is not null and try_cast(value as double) is null group by 1, 2""", "spells"))
def q_non_numeric_tally(spark, d):
    return pf.non_numeric_tally(fx.spells(spark, d), ["urea_first", "urea_last"])


@query("results_mean", "select event_type, round(avg(value), 6) mean_value, count(*) n from events group by 1")
def q_results_mean(spark, d):
    e = read_table(spark, d, "events", ["event_type", "value"])
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count(F.lit(1)).alias("n"))
