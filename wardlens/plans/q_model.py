"""Splits, class balance, metrics and feature-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.operators import features as ft
from wardlens.operators import metrics as mt
from wardlens.operators import split as sp
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans import presets as ps
from wardlens.plans.registry import query
from wardlens.sources import read_table

FPR_TARGET = 0.05
N_BOOT = 999


def v(body, *names, extra=()):
    return fx.with_views(body, *names, extra=list(extra))


# --- splits ------------------------------------------------------------------

@query("time_split", """select o_orderkey, case when row_number() over (order by o_orderdate, o_orderkey) <=
 count(*) over () - ceil(0.33 * count(*) over ()) then 'train' else 'test' end split from orders""")
def q_time_split(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    return sp.time_split(o, ["o_orderdate", "o_orderkey"], 0.33).select("o_orderkey", "split")


_RANK_SQL = "row_number() over (partition by {lab} order by md5(cast(doc_id as varchar)), doc_id)"


@query("stratified_kfold", f"select doc_id, quality, cast(({_RANK_SQL.format(lab='quality')} - 1) % 5 as int) fold from labels")
def q_stratified_kfold(spark, d):
    lb = read_table(spark, d, "labels", ["doc_id", "quality"])
    return sp.stratified_kfold(lb, "doc_id", "quality", 5)


@query("oneclass_split", f"""select doc_id, quality, fold, case when fold <> 0 and quality = 0 then 'train' else 'test' end split from
 (select doc_id, quality, cast(({_RANK_SQL.format(lab='quality')} - 1) % 5 as int) fold from labels) t""")
def q_oneclass_split(spark, d):
    lb = read_table(spark, d, "labels", ["doc_id", "quality"])
    return sp.oneclass_split(sp.stratified_kfold(lb, "doc_id", "quality", 5), "quality", 0)


@query("stratified_split", f"""select doc_id, toxic, case when {_RANK_SQL.format(lab='toxic')} <= ceil(count(*) over (partition by toxic) * 0.2)
 then 'test' else 'train' end split from labels""")
def q_stratified_split(spark, d):
    lb = read_table(spark, d, "labels", ["doc_id", "toxic"])
    return sp.stratified_split(lb, "doc_id", "toxic", 0.2)


@query("rebalance_under", f"""select doc_id, toxic from (select doc_id, toxic, {_RANK_SQL.format(lab='toxic')} r from labels) t
 where r <= (select min(n) from (select count(*) n from labels group by toxic) c)""")
def q_rebalance_under(spark, d):
    lb = read_table(spark, d, "labels", ["doc_id", "toxic"])
    return sp.rebalance_under(lb, "doc_id", "toxic")


@query("rebalance_over", f"""with c as (select toxic, count(*) n from labels group by toxic),
 mn as (select toxic m, n nm from c order by n, toxic limit 1),
 tg as (select greatest(cast(ceil((select max(n) from c) * 0.4 / 0.6) as bigint), (select nm from mn)) target),
 r as (select doc_id, toxic, {_RANK_SQL.format(lab='toxic')} rk from labels)
 select doc_id, toxic, cast(g.copy as int) copy from r, mn, tg,
  lateral (select unnest(case when r.toxic = mn.m then generate_series(1, cast(ceil(tg.target / mn.nm) as bigint)) else [1] end) copy) g
 where r.toxic <> mn.m or (g.copy - 1) * mn.nm + rk <= tg.target""")
def q_rebalance_over(spark, d):
    lb = read_table(spark, d, "labels", ["doc_id", "toxic"])
    return sp.rebalance_over(lb, "doc_id", "toxic", 0.4).withColumn("copy", F.col("copy").cast("int"))


@query("class_weights", """select toxic, count(*) n, round((select count(*) from labels) / ((select count(distinct toxic) from labels) * count(*)), 6) weight
 from labels group by toxic""")
def q_class_weights(spark, d):
    return sp.class_weights(read_table(spark, d, "labels", ["toxic"]), "toxic")


# --- metrics -----------------------------------------------------------------

_CURVE_CTES = [
    ("st", "select score, sum(label) pos, sum(1 - label) neg from scores group by score"),
    ("c", "select score, pos, neg, sum(pos) over (order by score desc) tp, sum(neg) over (order by score desc) fp from st"),
    ("t", "select sum(pos) p, sum(neg) n from st"),
]
_AUC_SQL = "round(sum(neg * (tp - 0.5 * pos)) / (max(p) * max(n)), 9)"
_AP_SQL = "round(sum(case when pos > 0 then pos * tp / (tp + fp) else 0 end) / max(p), 9)"


@query("auroc", v(f"select {_AUC_SQL} auroc from c, t", "scores", extra=_CURVE_CTES))
def q_auroc(spark, d):
    return mt.auroc(fx.scores(spark, d), "label", "score")


@query("avg_precision", v(f"select {_AP_SQL} avg_precision from c, t", "scores", extra=_CURVE_CTES))
def q_avg_precision(spark, d):
    return mt.average_precision(fx.scores(spark, d), "label", "score")


_ROC_SQL = """select cast(max(score) + 1 as double) threshold, 0.0 fpr, 0.0 tpr from scores
 union all select score, round(fp / n, 9), round(tp / p, 9) from c, t"""


@query("roc_curve", v(_ROC_SQL, "scores", extra=_CURVE_CTES))
def q_roc_curve(spark, d):
    return mt.roc_curve(fx.scores(spark, d), "label", "score")


@query("threshold_at_fpr", v(f"select threshold, fpr, tpr from ({_ROC_SQL}) r order by abs(fpr - {FPR_TARGET}), threshold desc limit 1",
                             "scores", extra=_CURVE_CTES))
def q_threshold_at_fpr(spark, d):
    return mt.threshold_at_fpr(fx.scores(spark, d), "label", "score", FPR_TARGET)


_CM_SQL = """select round((tp + tn) / (tp + fp + fn + tn), 9) accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) "precision",
 round(coalesce(tp / nullif(tp + fn, 0), 0), 9) recall,
 round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif((tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0), 0), 9) f1,
 round(coalesce(5 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(4 * (tp / nullif(tp + fp, 0)) + (tp / nullif(tp + fn, 0)), 0), 0), 9) f2
 from (select cast(count_if(y = 1 and p = 1) as double) tp, cast(count_if(y <> 1 and p = 1) as double) fp,
   cast(count_if(y = 1 and p <> 1) as double) fn, cast(count_if(y <> 1 and p <> 1) as double) tn from {src}) k"""


@query("class_metrics", _CM_SQL.format(src="(select quality y, 1 - toxic p from labels) l"))
def q_class_metrics(spark, d):
    lb = read_table(spark, d, "labels").select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("p"))
    return mt.class_metrics(lb, "y", "p")


def _poisson_sql(n, u):
    def draw(x, table):
        prob, alias = table
        i = f"floor({x} * {len(prob)})::int"
        return f"case when {x} * {len(prob)} - {i} < ({prob!r}::double[])[{i} + 1] then {i} else ({alias!r}::int[])[{i} + 1] end"
    small = " + ".join(f"case when ({n})::bigint & {j} > 0 then {draw(f'{u}{i}', t)} else 0 end" for i, (j, t) in enumerate(mt.POISSON.items()))
    large = f"greatest(0.0, floor({n} + sqrt({n}::double) * (sqrt(-2 * ln(1 - {u}0)) * cos(2 * pi() * {u}1)) + 0.5))"
    return f"case when {n} < 16 then ({small})::double else {large}::double end"


def _uniforms(key, u):
    return ", ".join(f"('0x' || substr(md5({key}), {8 * i + 1}, 8))::bigint / 4294967296.0::double {u}{i}" for i in range(4))


_BOOT_CTES = [
    ("rep0", f"select *, place::varchar || '|' || b::varchar k from (select *, row_number() over (order by score desc) place from st) s, range({N_BOOT}) r(b)"),
    ("rep1", f"select b, score, pos, neg, {_uniforms("k || '|1'", 'p')}, {_uniforms("k || '|0'", 'n')} from rep0"),
    ("rep", f"select b, score, {_poisson_sql('pos', 'p')} pos, {_poisson_sql('neg', 'n')} neg from rep1"),
    ("bst", "select * from rep where pos + neg > 0"),
    ("bc", "select b, score, pos, neg, sum(pos) over (partition by b order by score desc) tp, sum(neg) over (partition by b order by score desc) fp from bst"),
    ("bt", "select b, sum(pos) p, sum(neg) n from bst group by b"),
    ("pb", f"select b, {_AUC_SQL} auroc, {_AP_SQL} avg_precision from bc join bt using (b) group by b"),
]
_BOOT_SQL = """select round(quantile_cont(auroc, 0.025), 9) auroc_lower, round(quantile_cont(auroc, 0.975), 9) auroc_upper,
 round(quantile_cont(avg_precision, 0.025), 9) ap_lower, round(quantile_cont(avg_precision, 0.975), 9) ap_upper from pb"""


@query("bootstrap_ci", v(_BOOT_SQL, "scores", extra=_CURVE_CTES + _BOOT_CTES))
def q_bootstrap_ci(spark, d):
    return mt.bootstrap_ci(fx.scores(spark, d), "label", "score", N_BOOT)


@query("metrics_row", v(
    f"""select 'price_rule' name, 'rule' estimator, 'none' resampler, 'total_price' features, 1 outcome_within,
 a.auroc, bo.auroc_lower, bo.auroc_upper, a.avg_precision, bo.ap_lower, bo.ap_upper, m.accuracy, m."precision", m.recall, m.f2
 from (select {_AUC_SQL} auroc, {_AP_SQL} avg_precision from c, t) a, ({_BOOT_SQL}) bo,
 ({_CM_SQL.format(src="(select label y, case when score > (select threshold from (" + _ROC_SQL + ") r order by abs(fpr - 0.05), threshold desc limit 1) then 1 else 0 end p from scores) q")}) m""",
    "scores", extra=_CURVE_CTES + _BOOT_CTES))
def q_metrics_row(spark, d):
    s = fx.scores(spark, d)
    t = mt.threshold_at_fpr(s, "label", "score", FPR_TARGET).first()["threshold"]  # one number back
    pred = s.select(F.col("label").alias("y"), (F.col("score") > F.lit(t)).cast("int").alias("p"))
    cm_ = mt.class_metrics(pred, "y", "p").select("accuracy", "precision", "recall", "f2")
    a = mt.ranking_summary(s, "label", "score")
    keys = spark.range(1).select(F.lit("price_rule").alias("name"), F.lit("rule").alias("estimator"),
                                 F.lit("none").alias("resampler"), F.lit("total_price").alias("features"),
                                 F.lit(1).alias("outcome_within"))
    return (keys.join(a, how="inner").join(mt.bootstrap_ci(s, "label", "score", N_BOOT), how="inner")
            .join(cm_, how="inner"))


# --- features ------------------------------------------------------------------

_MED = ["resp_rate", "sbp", "dbp"]


@query("impute_median", v("select spell_id, " + ", ".join(f"coalesce({c}, (select median({c}) from spells)) {c}" for c in _MED)
                          + " from spells", "spells"))
def q_impute_median(spark, d):
    s = fx.spells(spark, d).select("spell_id", *_MED)
    return ft.impute_median(s, _MED)


_STATIC = {"assisted": False, "device": "A - Air", "o2_flow": 0.0, "alert": True}


@query("impute_static", v("select obs_id, coalesce(assisted, false) assisted, coalesce(device, 'A - Air') device, "
                          "coalesce(o2_flow, 0.0) o2_flow, coalesce(alert, true) alert from obs", "obs"))
def q_impute_static(spark, d):
    o = fx.obs(spark, d).select("obs_id", *_STATIC)
    return ft.impute_static(o, _STATIC)


@query("fill_unfill", v("""select spell_id, coalesce(age, -1) age_filled, coalesce(gender, 'NAN') gender_filled,
 coalesce(resp_rate, -1) resp_filled, age age_back, gender gender_back, resp_rate resp_back from spells""", "spells"))
def q_fill_unfill(spark, d):
    s = fx.spells(spark, d).select("spell_id", "age", "gender", "resp_rate")
    names = {"age": ("age_filled", "age_back"), "gender": ("gender_filled", "gender_back"), "resp_rate": ("resp_filled", "resp_back")}
    both = s.select("spell_id", *[F.col(c).alias(x) for c, pair in names.items() for x in pair])
    filled = ft.fill_na(both, [x for pair in names.values() for x in pair])
    return ft.unfill_na(filled, [back for _, back in names.values()])


@query("ordinal_encode", v("""select spell_id,
 coalesce(cast(list_position((select list(distinct specialty order by specialty) from spells where specialty is not null), specialty) - 1 as int), -1) specialty,
 coalesce(cast(list_position((select list(distinct admit_method order by admit_method) from spells where admit_method is not null), admit_method) - 1 as int), -1) admit_method
 from spells""", "spells"))
def q_ordinal_encode(spark, d):
    s = fx.spells(spark, d).select("spell_id", "specialty", "admit_method")
    return ft.ordinal_encode(s, ["specialty", "admit_method"])


_G_LEVELS = ["Female", "Male", "Other"]
_S_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("onehot", v("select spell_id, " + ", ".join(f"coalesce(cast(gender = '{g}' as int), 0) gender__{g}" for g in _G_LEVELS)
                   + ", " + ", ".join(f"coalesce(cast(specialty = '{g}' as int), 0) specialty__{g}" for g in _S_LEVELS)
                   + " from spells", "spells"))
def q_onehot(spark, d):
    s = fx.spells(spark, d).select("spell_id", "gender", "specialty")
    return ft.onehot(s, ["gender", "specialty"])


_FAMILY = ["<1.8", "5", "12", "20"]


@query("onehot_family", v("select spell_id, " + ", ".join(
    f"cast(coalesce(urea_first = '{x}', false) or coalesce(urea_last = '{x}', false) as int) \"urea__{x}\"" for x in _FAMILY) + " from spells", "spells"))
def q_onehot_family(spark, d):
    s = fx.spells(spark, d).select("spell_id", "urea_first", "urea_last")
    return ft.onehot_family(s, ["urea_first", "urea_last"], "urea", _FAMILY)


_SPARSE = ["admit_method", "gender", "specialty", "urea_first"]


@query("onehot_sparse", v("select spell_id, coalesce(len(ix), 0)::int n_places, array_to_string(ix, ',') places from spells left join ("
                          "select spell_id, list(idx order by idx) ix from kv join lv using (col_name, level) group by spell_id) p using (spell_id)", "spells", extra=[
    ("kv", " union all ".join(f"select spell_id, '{c}' col_name, {c} as level from spells where {c} is not null" for c in _SPARSE)),
    ("lv", "select col_name, level, row_number() over (order by col_name, level) - 1 idx from (select distinct col_name, level from kv) x")]))
def q_onehot_sparse(spark, d):
    got, _ = ft.sparse_levels(fx.spells(spark, d).select("spell_id", *_SPARSE), "spell_id", _SPARSE)
    places = F.array_join(F.transform("indices", lambda i: i.cast("string")), ",")
    return got.select("spell_id", F.size("indices").alias("n_places"), F.nullif(places, F.lit("")).alias("places"))


@query("group_sum_by_prefix", v("select spell_id, cast(gender is not null as double) gender, cast(specialty is not null as double) specialty, "
                                "coalesce(gender, '') levels_gender from spells", "spells"))
def q_group_sum_by_prefix(spark, d):
    s = ft.onehot(fx.spells(spark, d).select("spell_id", "gender", "specialty"), ["gender", "specialty"])
    groups = ft.onehot_groups(s.columns)
    out = ft.group_sum(s, groups)
    return out.select("spell_id", "gender", "specialty", ft.joined_levels(out, groups["gender"]).alias("levels_gender"))


@query("feature_sets", v("select spell_id, age, gender, urea_first, urea_last from spells", "spells"))
def q_feature_sets(spark, d):
    sets = {"demographics+labs": ps.SPELL_GROUPS["demographics"] + ps.SPELL_GROUPS["labs"]}
    return fx.spells(spark, d).select("spell_id", *sets["demographics+labs"])


@query("standard_scale", v("select obs_id, " + ", ".join(
    f"round(({c} - (select avg({c}) from obs)) / (select stddev_pop({c}) from obs), 9) {c}" for c in ["temperature", "heart_rate"])
    + " from obs", "obs"))
def q_standard_scale(spark, d):
    o = fx.obs(spark, d).select("obs_id", "temperature", "heart_rate")
    sc = ft.standard_scale(o, ["temperature", "heart_rate"])
    return sc.select("obs_id", *[F.round(c, 9).alias(c) for c in ["temperature", "heart_rate"]])


@query("impute_mode", v("select obs_id, coalesce(device, (select device from obs where device is not null group by device "
                        "order by count(*) desc, device limit 1)) device from obs", "obs"))
def q_impute_mode(spark, d):
    return ft.impute_mode(fx.obs(spark, d).select("obs_id", "device"), ["device"])


@query("preprocess_by_type", v(
    """with m as (select avg(age) ma, stddev_pop(age) sa, avg(resp_rate) mr, stddev_pop(resp_rate) sr from spells),
 md as (select median((age - ma) / sa) mda, median((resp_rate - mr) / sr) mdr from spells, m),
 mo as (select d from (select coalesce(died = 'Yes', false) d from spells) x group by d order by count(*) desc, d limit 1)
 select spell_id, round(coalesce((age - ma) / sa, mda), 9) age, round(coalesce((resp_rate - mr) / sr, mdr), 9) resp_rate,
 """ + ", ".join(f"coalesce(cast(gender = '{g}' as int), 0) gender__{g}" for g in _G_LEVELS)
    + """, coalesce(cast(cast(coalesce(coalesce(died = 'Yes', false), (select d from mo)) as varchar) = 'true' as int), 0) died__true
 from spells, m, md""", "spells"))
def q_preprocess_by_type(spark, d):
    s = fx.spells(spark, d).select("spell_id", "age", "resp_rate", "gender",
                                   F.coalesce(F.col("died") == "Yes", F.lit(False)).alias("died"))
    out = ft.preprocess_by_type(s, "spell_id")
    return out.select("spell_id", F.round("age", 9).alias("age"), F.round("resp_rate", 9).alias("resp_rate"),
                      *[f"gender__{g}" for g in _G_LEVELS], "died__true")
