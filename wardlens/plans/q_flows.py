"""Composed flows: raw-to-clean, old-layout cleaning, augmentation, config-driven
preparation, text datasets and outcome-rate grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions import families as fam
from wardlens.operators import derive as dv
from wardlens.operators.ranking import exact_quantiles
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans import flows as fl
from wardlens.plans import q_clean as qc
from wardlens.plans import q_lookup as ql
from wardlens.plans.registry import query
from wardlens.sources import read_table

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def v(body, *names, extra=()):
    return fx.with_views(body, *names, extra=list(extra))


def codes_text(spark, d):
    p = ql.packed(ql.clean_codes(spark, d), "code")
    return p.select("spell_id", ql._joined(F.col("codes")).alias("codes"))


_CODES_CTE = ("codes", "select spell_id, string_agg(coalesce(code, '~'), ',' order by slot) codes from clean group by spell_id")


def _lab(c):
    return (f"case when {c} in ('>107.0', '>53.6') then null when {c} = '<1.8' then 0.9 else try_cast({c} as double) end")


_RAW_CTES = [ql.STD_CTE, ql.CLEAN_CTE, _CODES_CTE, ("raw0", f"""select spell_id, cast(patient_id as bigint) patient_id, admitted, cast(age as int) age,
 coalesce(nullif(gender, 'Other') in ('Female'), false) female, coalesce(died in ('Yes'), false) died,
 trim(los_band, {WS}) los_band, trim(admit_method, {WS}) admit_method, trim(specialty, {WS}) specialty,
 {_lab('urea_first')} urea_first, {_lab('urea_last')} urea_last,
 case when coalesce(r0 <= 5 or r0 >= 80, false) then null else r0 end resp_rate, resp_score, d dbp,
 case when coalesce(sb <= d + 5, false) then null else sb end sbp
 from (select *, case when abs(resp_rate) >= 100 then abs(resp_rate) / 10 else abs(resp_rate) end r0,
   case when coalesce(dbp <= 20 or dbp >= 200, false) then null else dbp end d,
   case when coalesce(sbp <= 40 or sbp >= 300, false) then null else sbp end sb from spells
   where los_band is distinct from 'Still In' and patient_id is not null and age is not null and age >= 16) t""")]


@query("prep_from_raw", v("select raw0.*, codes.codes from raw0 left join codes using (spell_id)",
                          "slots", "spells", "ref_codes", extra=_RAW_CTES))
def q_prep_from_raw(spark, d):
    return fl.from_raw(fx.spells(spark, d), codes_text(spark, d))


def _clean_all_sql():
    b = qc
    ctes = [
        ("s1a", "select *, abs(sbp) _s0, case when coalesce(abs(dbp) <= 20 or abs(dbp) >= 200, false) then null else abs(dbp) end _d from obs"),
        ("s1b", "select *, case when coalesce(_s0 <= 40 or _s0 >= 300 or _s0 <= _d + 5, false) then null else _s0 end _s from s1a"),
        ("s1", f"""select * exclude (_s0, _d, _s) replace (_d as dbp,
   case when _s is null and bp_score is not null then {b.lookup_sql('bp_score', b.nw.SYSTOLIC_REVERSE)} else _s end as sbp,
   case when bp_score is null and _s is not null then {b.sys_sql('_s')} else bp_score end as bp_score) from s1b"""),
        ("s2a", "select *, case when con_score = 1.0 then null else con_score end _c0 from s1"),
        ("s2b", "select *, case when _c0 is null and alert is not null then case when alert then 0.0 else 3.0 end else _c0 end _c from s2a"),
        ("s2", "select * exclude (_c0, _c) replace (_c as con_score, case when _c = 3.0 then false when _c = 0.0 then true end as alert) from s2b"),
        ("s3a", "select *, case when air_score = 1.0 then null else air_score end _a0 from s2"),
        ("s3b", "select *, case when _a0 is null and assisted is not null then case when assisted then 2.0 else 0.0 end else _a0 end _a from s3a"),
        ("s3", "select * exclude (_a0, _a) replace (_a as air_score, case when _a = 2.0 then true when _a = 0.0 then false end as assisted) from s3b"),
        ("s4a", "select *, case when coalesce(heart_rate < 25 or heart_rate > 300, false) then null else heart_rate end _h from s3"),
        ("s4", f"""select * exclude (_h) replace (
   case when _h is null and hr_score is not null then {b.lookup_sql('hr_score', b.nw.HEART_RATE_REVERSE)} else _h end as heart_rate,
   case when hr_score is null and _h is not null then {b.band_sql('_h', *b.nw.HEART_RATE)} else hr_score end as hr_score) from s4a"""),
        ("s5a", f"select * replace ({b._NHF} as device) from s4"),
        ("s5t", "select device from s5a where device is not null group by device order by count(*) desc, device limit 16"),
        ("s5b", "select * replace (case when device is not null and device not in (select device from s5t) then 'Other' else device end as device) from s5a"),
        ("s5c", "select * replace (case when device is not null and device <> 'A - Air' and not coalesce(assisted, false) then true else assisted end as assisted) from s5b"),
        ("s5", "select * replace (case when coalesce(assisted, false) and coalesce(device = 'A - Air' or device is null, false) then 'Other' else device end as device) from s5c"),
        ("s6", f"""select * replace (case when f > 1 then null else f end as o2_flow) from (select *,
   case when coalesce((o2_flow >= 1 and o2_flow <= 15) or (o2_flow = 0.5 and coalesce(device in ('A - Air', 'N - Nasal cannula', 'SM - Simple mask'), false)), false)
   then (0.2 + o2_flow * 4.0) / 100 when o2_flow > 15 then o2_flow / 100 else o2_flow end f from s5) t"""),
        ("s6f", "select * exclude (f) from s6"),
        ("s7a", "select *, case when _sa <= 10 then _sa * 10 else _sa end _s1 from (select *, case when abs(o2_sat) = 0 then null else abs(o2_sat) end _sa from s6f) t"),
        ("s7st", "select avg(s1) - 3 * stddev_samp(s1) _bound from (select case when sa <= 10 then sa * 10 else sa end s1 from (select case when abs(o2_sat) = 0 then null else abs(o2_sat) end sa from obs) x) y"),
        ("s7b", f"""select s7a.*, coalesce(_s1 > 100 or _s1 <= _bound, false) _out,
   coalesce(op1 = 'E85.2', false) or coalesce(device = 'NIV - NIV', false)
   or (coalesce(diag1 in ({b._in(b.COPD_CODES)}), false) and coalesce(starts_with(device, 'V'), false))
   or (coalesce(diag1 in ({b._in(b.COPD_CODES)}), false) and coalesce(_s1 < 88, false)) _sc2 from s7a, s7st"""),
        ("s7c", "select *, case when _out and _sc2 and coalesce(o2_score = 0, false) then 92.0 when _out then null else _s1 end _s2 from s7b"),
        ("s7d", f"""select *, case when _s2 is null and o2_score is not null and not _sc2 then {b.lookup_sql('o2_score', b.nw.SPO2_SCALE1_REVERSE)}
   when _s2 is null and o2_score is not null and _sc2 and o2_score = 0 then 92.0 else _s2 end _s3 from s7c"""),
        ("s7", f"""select * exclude (_sa, _s1, _out, _sc2, _s2, _s3) replace (_s3 as o2_sat,
   case when _s3 is not null and o2_score is null and not _sc2 then {b.band_sql('_s3', *b.nw.SPO2_SCALE1)}
   when _s3 is not null and o2_score is null and _sc2 then {b.spo2_2_sql('_s3', 'assisted')} else o2_score end as o2_score) from s7d"""),
        ("s8a", "select *, case when coalesce(_r1 <= 5 or _r1 >= 80, false) then null else _r1 end _r from (select *, case when abs(resp_rate) >= 100 then floor(abs(resp_rate) / 10) else abs(resp_rate) end _r1 from s7) t"),
        ("s8", f"""select * exclude (_r1, _r) replace (
   case when _r is null and resp_score is not null then {b.lookup_sql('resp_score', b.nw.RESPIRATION_REVERSE)} else _r end as resp_rate,
   case when resp_score is null and _r is not null then {b.band_sql('_r', *b.nw.RESPIRATION)} else resp_score end as resp_score) from s8a"""),
        ("s9a", "select *, case when coalesce(temperature < 25 or temperature > 45, false) then null else temperature end _t from s8"),
        ("s9", f"""select * exclude (_t) replace (
   case when _t is null and temp_score is not null then {b.lookup_sql('temp_score', b.nw.TEMPERATURE_REVERSE)} else _t end as temperature,
   case when temp_score is null and _t is not null then {b.band_sql('_t', *b.nw.TEMPERATURE)} else temp_score end as temp_score) from s9a"""),
        ("s10", "select * replace (case when " + " and ".join(f"{p} is not null" for p in fl.NEWS_PARTS)
         + " and (news_score is null or news_score <> (" + " + ".join(fl.NEWS_PARTS) + ")) then (" + " + ".join(fl.NEWS_PARTS)
         + ") else news_score end as news_score) from s9"),
    ]
    body = """select *, coalesce(case when patient_id is not null then epoch(taken) - epoch(lag(taken) over (partition by patient_id order by taken, obs_id)) end < 30 * 86400, false) readmission from s10"""
    return fx.with_views(body, "obs", extra=ctes)


@query("prep_clean_all", _clean_all_sql())
def q_prep_clean_all(spark, d):
    return fl.clean_all(fx.obs(spark, d))


_AUG_SQL = fx.with_views(
    """select st.*, coalesce(st.died_flag and st.total_los <= 1, false) mortality, coalesce(cc.cc_time <= 1, false) critical_care,
 coalesce(st.died_flag and st.total_los <= 1, false) or coalesce(cc.cc_time <= 1, false) critical_event,
 coalesce(st.admit_ward in ('AEC', 'AAA'), false) sent_to_sdec,
 coalesce(g.prev_gap_s < 30 * 86400, false) readmission, ch.charlson
 from stays st left join cc using (spell_id) left join gaps g using (spell_id) left join ch using (spell_id)""",
    "slots", "spells", "ref_codes", "ref_comorbid", "charlson_weights", extra=[
        ("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), ql.STD_CTE, ql.CLEAN_CTE,
        ("cc", cm.sql_cc_time(["CCU"], True)),
        ("gaps", "select spell_id, case when patient_id is not null then epoch(admitted) - epoch(lag(admitted) over (partition by patient_id order by admitted, spell_id)) end prev_gap_s from spells"),
        ("ch", """select s.spell_id, cast(coalesce(w.w, 0) + case when age > 50 and age <= 59 then 1 when age > 60 and age <= 69 then 2
   when age > 70 and age <= 79 then 3 when age > 79 then 4 else 0 end as int) charlson
 from spells s left join (select spell_id, sum(cw.weight) w from clean left join ref_comorbid rc on rc.code3 = split_part(clean.code, '.', 1)
   left join charlson_weights cw on cw.condition = rc.condition where clean.code is not null group by spell_id) w using (spell_id)""")])
_AUG_COLS = ["spell_id", "mortality", "critical_care", "critical_event", "sent_to_sdec", "readmission", "charlson", "admit_ward", "total_los"]


@query("prep_augment", "select " + ", ".join(_AUG_COLS) + " from (" + _AUG_SQL + ") a")
def q_prep_augment(spark, d):
    return fl.augment(cm.stays(spark, d), ql.charlson(spark, d)).select(*_AUG_COLS)


_PARAMS = {"omit": ["labs"], "raw": True, "onehot": ["gender"], "levels": {"gender": ["Female", "Male", "Other"]}}


@query("prep_from_params", v("select spell_id, patient_id, admitted, age, died, los_band, admit_method, specialty, resp_rate, sbp, dbp, "
                             + ", ".join(f"coalesce(cast(gender = '{g}' as int), 0) gender__{g}" for g in ["Female", "Male", "Other"])
                             + " from spells", "spells"))
def q_prep_from_params(spark, d):
    return fl.from_params(fx.spells(spark, d), _PARAMS)


# --- text datasets --------------------------------------------------------------

_T1_COLS = ["o_orderpriority", "o_custkey", "o_orderstatus"]


@query("to_text", "select o_orderkey, " + " || ".join(f"'{c}: ' || coalesce(cast({c} as varchar), 'nan') || ' [SEP] '"
                                                    for c in ["o_orderpriority", "o_orderstatus"])
       + " text, cast(o_orderstatus = 'F' as int) label from orders")
def q_to_text(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", *_T1_COLS]).withColumn("is_f", F.col("o_orderstatus") == "F")
    # o_custkey plays the patient id: never part of the text
    return fl.to_text(o, "o_orderkey", _T1_COLS, "is_f", with_names=True, patient="o_custkey")


def _bool_txt(c):
    return f"case when {c} then 'True' when not {c} then 'False' end"


def text_dataset(spark, d, columns, variant="sci", within=4, with_names=True):
    wards, ignore = dv.OUTCOME_VARIANTS[variant]
    raw = fl.from_raw(fx.spells(spark, d), codes_text(spark, d)).where(F.col("age") >= 18)
    st = cm.stays(spark, d).select("spell_id", "path", "died_flag", "total_los")
    lab = dv.critical_event(F.col("died_flag"), F.col("total_los"), F.col("path"), within, wards, ignore)
    j = raw.join(st, "spell_id").withColumn("outcome", lab)
    return fl.to_text(j, "spell_id", columns, "outcome", with_names)


_T2_COLS = ["age", "female", "admit_method", "specialty", "codes"]
_T3_COLS = ["admit_method", "specialty", "codes"]


def _text_sql(cols, wards, ignore):
    parts = " || ".join(f"'{c}: ' || coalesce({_bool_txt('r.' + c) if c == 'female' else f'cast(r.{c} as varchar)'}, 'nan') || ' [SEP] '"
                        for c in cols)
    return fx.with_views(
        f"""select r.spell_id, {parts} text, cast(coalesce(st.died_flag and st.total_los <= 4, false) or coalesce(cc.cc_time <= 4, false) as int) label
 from (select raw0.*, codes.codes from raw0 left join codes using (spell_id)) r join stays st using (spell_id) left join cc using (spell_id)
 where r.age >= 18""", "slots", "spells", "ref_codes",
        extra=_RAW_CTES + [("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), ("cc", cm.sql_cc_time(wards, ignore))])


@query("text_dataset", _text_sql(_T2_COLS, ["CCU", "HH1M"], False))
def q_text_dataset(spark, d):
    return text_dataset(spark, d, _T2_COLS, "sci")


@query("text_dataset_triage", _text_sql(_T3_COLS, ["CCU"], True))
def q_text_dataset_triage(spark, d):
    return text_dataset(spark, d, _T3_COLS, "strict")


_TOK_RE = "[ \\t\\n\\r\\f\\x0B]+"
_WS_SET = " \t\n\r\f\x0b"


def tokens(text_col):
    t = F.btrim(F.col(text_col), F.lit(_WS_SET))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, _TOK_RE))


@query("token_truncate", f"""select doc_id, len(tk) n_tokens, len(tk) > 512 truncated, array_to_string(tk[1:512], ' ') text_512 from
 (select doc_id, case when trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) = '' then []::varchar[]
   else regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '{_TOK_RE}') end tk from documents) t""")
def q_token_truncate(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", tokens("text").alias("tk"))
    return docs.select("doc_id", F.size("tk").alias("n_tokens"), (F.size("tk") > 512).alias("truncated"),
                       F.array_join(F.slice("tk", 1, 512), " ").alias("text_512"))


@query("token_report", f"""select count(*) n_docs, round(avg(case when n > 512 then 1.0 else 0.0 end), 6) share_truncated,
 median(n) median_tokens, max(n) max_tokens from
 (select case when trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) = '' then 0
   else len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '{_TOK_RE}')) end n from documents) t""")
def q_token_report(spark, d):
    n = read_table(spark, d, "documents", ["doc_id", "text"]).select(F.size(tokens("text")).alias("n"))
    agg = n.agg(F.count(F.lit(1)).alias("n_docs"),
                F.round(F.avg(F.when(F.col("n") > 512, 1.0).otherwise(0.0)), 6).alias("share_truncated"),
                F.max("n").alias("max_tokens"))
    med = exact_quantiles(n, ["n"], 0.5).select(F.col("value").alias("median_tokens"))
    return agg.join(med, how="inner")


@query("label_encode", """select doc_id, cast(list_position((select list(distinct l order by l) from
 (select case when quality = 1 then 'good' else 'poor' end l from labels) x), case when quality = 1 then 'good' else 'poor' end) - 1 as int) label
 from labels""")
def q_label_encode(spark, d):
    from wardlens.operators.features import ordinal_encode
    lb = read_table(spark, d, "labels", ["doc_id", "quality"]).select(
        "doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    return ordinal_encode(lb, ["label"])


# --- outcome-rate grids -----------------------------------------------------------

def event_day(spark, d, wards, ignore):
    """First whole day (>= 1) by which the stay's critical event has happened."""
    s = cm.stays(spark, d)
    cc = dv.critical_care_time(F.col("path"), wards, ignore)
    death = F.when(F.col("died_flag"), F.col("total_los"))
    t = F.least(cc, death)
    return s.select("spell_id", F.greatest(F.ceil(t), F.lit(1)).alias("ev_day"))


@query("label_rate_by_threshold", fx.with_views(
    """select t.threshold, cast(count_if(e.ev_day <= t.threshold) as bigint) n_events, round(count_if(e.ev_day <= t.threshold) / (select count(*) from spells), 6) rate
 from range(1, 31) t(threshold) left join ev e on e.ev_day <= t.threshold group by t.threshold""", "slots", "spells", extra=[
        ("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), ("cc", cm.sql_cc_time(["CCU", "HH1M"], False)),
        ("ev", "select spell_id, greatest(ceil(least(cc.cc_time, case when died_flag then total_los end)), 1) ev_day from stays left join cc using (spell_id)")]))
def q_label_rate_by_threshold(spark, d):
    ev = event_day(spark, d, ["CCU", "HH1M"], False)
    days = ev.groupBy(F.least("ev_day", F.lit(31)).alias("day")).agg(F.count(F.lit(1)).alias("k"))  # 32 rows at most
    counts = [F.coalesce(F.sum(F.when(F.col("day") <= t, F.col("k"))), F.lit(0)).alias(f"t{t}") for t in range(1, 31)]
    one = days.agg(F.sum("k").alias("n"), *counts)
    rows = F.explode(F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("n_events")) for t in range(1, 31)]))
    return one.select("n", rows.alias("r")).select("r.threshold", "r.n_events", F.round(F.col("r.n_events") / F.col("n"), 6).alias("rate"))


@query("label_rate_by_definition", fx.with_views(" union all ".join(
    f"""select '{name}' variant, cast(count_if(coalesce(died_flag and total_los <= 1, false) or coalesce(c{i}.cc_time <= 1, false)) as bigint) n_events,
 round(count_if(coalesce(died_flag and total_los <= 1, false) or coalesce(c{i}.cc_time <= 1, false)) / count(*), 6) rate
 from stays left join c{i} using (spell_id)""" for i, name in enumerate(dv.OUTCOME_VARIANTS)),
    "slots", "spells", extra=[("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS)] + [
        (f"c{i}", cm.sql_cc_time(w, ig)) for i, (w, ig) in enumerate(dv.OUTCOME_VARIANTS.values())]))
def q_label_rate_by_definition(spark, d):
    s = cm.stays(spark, d)
    p, died, los = F.col("path"), F.col("died_flag"), F.col("total_los")
    flags = {name: dv.critical_event(died, los, p, 1, w, ig) for name, (w, ig) in dv.OUTCOME_VARIANTS.items()}
    agg = s.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(n).alias("n_events")) for n in flags])
    out = agg.select("_n", F.explode(rows).alias("r"))
    return out.select("r.variant", "r.n_events", F.round(F.col("r.n_events") / F.col("_n"), 6).alias("rate"))
