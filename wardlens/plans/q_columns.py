"""Column-function and projection queries (F- and P-rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions import codes as cd
from wardlens.functions import news as nw
from wardlens.functions import repair as rp
from wardlens.functions import text as tx
from wardlens.operators import project as pj
from wardlens.operators.derive import cut
from wardlens.plans import fixtures as fx
from wardlens.plans import presets as ps
from wardlens.plans.registry import query
from wardlens.sources import read_table

WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def v(body, *names, extra=None):
    return fx.with_views(body, *names, extra=extra)


def _in(values):
    return ", ".join("'" + s.replace("'", "''") + "'" for s in values)


# --- strings ----------------------------------------------------------------

@query("normalise_text", v(
    "select item_id, trim(lower(complaint), ' .?+') complaint_lower, trim(upper(complaint), ' .?+') complaint_upper "
    "from complaints", "complaints"))
def q_normalise_text(spark, d):
    c = fx.complaints(spark, d)
    return c.select("item_id", tx.normalise("complaint").alias("complaint_lower"),
                    tx.normalise("complaint", case="upper").alias("complaint_upper"))


@query("vague_terms", v(
    f"""select item_id,
 case when trim(lower(complaint), ' .?+') in ({_in(tx.VAGUE_TERMS)}) then null else trim(lower(complaint), ' .?+') end complaint_new,
 case when trim(lower(complaint), ' .?+') in ({_in(tx.VAGUE_TERMS)}) then 'other' else trim(lower(complaint), ' .?+') end complaint_old
 from complaints""", "complaints"))
def q_vague_terms(spark, d):
    c = fx.complaints(spark, d).select("item_id", tx.normalise("complaint").alias("c"))
    return c.select("item_id", tx.vague_to("c").alias("complaint_new"),
                    tx.vague_to("c", "other").alias("complaint_old"))


STEM_RE = tx.stem_pattern(tx.AE_DIAGNOSIS_STEMS)


@query("first_stem", f"""select doc_id, nullif(regexp_extract(lower(text), '{STEM_RE}', 1), '') stem from documents""")
def q_first_stem(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    return docs.select("doc_id", tx.first_stem("text").alias("stem"))


_ONEHOT_STEMS = sorted(set(tx.AE_DIAGNOSIS_STEMS))


@query("stem_onehot", "select doc_id, " + ", ".join(
    f"case when s is null then null else cast(s = '{st}' as int) end stem__{st}" for st in _ONEHOT_STEMS)
    + f" from (select doc_id, nullif(regexp_extract(lower(text), '{STEM_RE}', 1), '') s from documents) t")
def q_stem_onehot(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    s = docs.select("doc_id", tx.first_stem("text").alias("s"))
    return s.select("doc_id", *[F.when(F.col("s").isNotNull(), (F.col("s") == st).cast("int")).alias(f"stem__{st}")
                                for st in _ONEHOT_STEMS])


@query("code_stem", v("select spell_id, slot, code, split_part(code, '.', 1) code3, replace(code, '.', '') code_undotted from slots",
                      "slots"))
def q_code_stem(spark, d):
    s = fx.slots(spark, d)
    return s.select("spell_id", "slot", "code", cd.stem3("code").alias("code3"), cd.undotted("code").alias("code_undotted"))


@query("device_clean", """select doc_id, case when d in (select d from (select d, count(*) n from
  (select split_part(trim(replace(upper(source), 'OTHER;', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), ';', 1) d from documents) x
  where d is not null group by d order by n desc, d limit 16) y) then d end device
 from (select doc_id, split_part(trim(replace(upper(source), 'OTHER;', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), ';', 1) d from documents) t""")
def q_device_clean(spark, d):
    from wardlens.operators.clean import topn_keep
    docs = read_table(spark, d, "documents", ["doc_id", "source"])
    t = docs.select("doc_id", tx.device_text("source").alias("device"))
    return topn_keep(t, "device", 16)


@query("merge_levels", v(
    "select item_id, lower(coalesce(m_new.v, patient_group)) group_new, coalesce(m_old.v, lower(patient_group)) group_old "
    "from complaints left join (values " + ", ".join(f"('{k}', '{x}')" for k, x in tx.PATIENT_GROUP_MERGE_NEW.items())
    + ") m_new(k, v) on m_new.k = patient_group left join (values "
    + ", ".join(f"('{k}', '{x}')" for k, x in tx.PATIENT_GROUP_MERGE_OLD.items())
    + ") m_old(k, v) on m_old.k = lower(patient_group)", "complaints"))
def q_merge_levels(spark, d):
    c = fx.complaints(spark, d)
    return c.select("item_id",
                    tx.merge_levels("patient_group", tx.PATIENT_GROUP_MERGE_NEW, lower_after=True).alias("group_new"),
                    tx.merge_levels("patient_group", tx.PATIENT_GROUP_MERGE_OLD, lower_before=True).alias("group_old"))


_ROW_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("row_to_text", "select o_orderkey, " + " || ".join(
    f"'{c}: ' || coalesce(cast({c} as varchar), 'nan') || ' [SEP] '" for c in _ROW_COLS)
    + " text_named, " + " || ".join(f"coalesce(cast({c} as varchar), 'nan') || ' [SEP] '" for c in _ROW_COLS)
    + " text_plain from orders")
def q_row_to_text(spark, d):
    o = read_table(spark, d, "orders", ["o_orderkey", *_ROW_COLS])
    return o.select("o_orderkey", tx.row_text(_ROW_COLS, with_names=True).alias("text_named"),
                    tx.row_text(_ROW_COLS).alias("text_plain"))


# --- numbers: binning, repairs, scales ---------------------------------------

_CUT_EDGES = [0, 1, 5, 20, 50, 100, 500]
_CUT_LABELS = ["tiny", "small", "medium", "large", "huge", "extreme"]


@query("cut_bins", "select event_id, case " + " ".join(
    f"when value > {lo} and value <= {hi} then '{lab}'" for lo, hi, lab in zip(_CUT_EDGES[:-1], _CUT_EDGES[1:], _CUT_LABELS))
    + " else 'out of range' end value_band from events")
def q_cut_bins(spark, d):
    e = read_table(spark, d, "events", ["event_id", "value"])
    return e.select("event_id", cut("value", _CUT_EDGES, _CUT_LABELS, "out of range").alias("value_band"))


@query("invert_negatives", v("select obs_id, abs(heart_rate) heart_rate, abs(temperature) temperature from obs", "obs"))
def q_invert_negatives(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", rp.invert_negatives("heart_rate").alias("heart_rate"),
                    rp.invert_negatives("temperature").alias("temperature"))


@query("clip_sentinel", v(
    """select obs_id,
 case when heart_rate <= 25 or heart_rate >= 300 then null else heart_rate end hr_inclusive,
 case when heart_rate < 25 or heart_rate > 300 then null else heart_rate end hr_exclusive,
 case when temperature <= 25 or temperature >= 45 then -1.0 else temperature end temp_sentinel
 from obs""", "obs"))
def q_clip_sentinel(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", rp.clip_sentinel("heart_rate", 25, 300).alias("hr_inclusive"),
                    rp.clip_sentinel("heart_rate", 25, 300, inclusive=False).alias("hr_exclusive"),
                    rp.clip_sentinel("temperature", 25, 45, sentinel=-1.0).alias("temp_sentinel"))


@query("shift_triple", v(
    """select obs_id, case when resp_rate >= 100 then resp_rate / 10 else resp_rate end resp_div,
 case when resp_rate >= 100 then cast(floor(resp_rate / 10) as double) else resp_rate end resp_floordiv from obs""", "obs"))
def q_shift_triple(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", rp.shift_triple("resp_rate").alias("resp_div"),
                    rp.shift_triple("resp_rate", integer=True).alias("resp_floordiv"))


@query("shift_single", v(
    """select obs_id, case when o2_sat < 10 then o2_sat * 10 else o2_sat end sat_lt,
 case when o2_sat <= 10 then o2_sat * 10 else o2_sat end sat_le from obs""", "obs"))
def q_shift_single(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", rp.shift_single("o2_sat").alias("sat_lt"),
                    rp.shift_single("o2_sat", inclusive=True).alias("sat_le"))


@query("cross_col_mask", v("select obs_id, case when sbp <= dbp + 5 then null else sbp end sbp from obs", "obs"))
def q_cross_col_mask(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", rp.mask_against("sbp", "dbp", 5).alias("sbp"))


@query("flow_to_fraction", v(
    f"""select obs_id, case when f > 1 then null else f end o2_fraction from (
 select obs_id, case when coalesce((o2_flow >= 1 and o2_flow <= 15) or (o2_flow = 0.5 and coalesce(device in ({_in(rp.LPM_DEVICES)}), false)), false)
   then (0.2 + o2_flow * 4.0) / 100 when o2_flow > 15 then o2_flow / 100 else o2_flow end f from obs) t""", "obs"))
def q_flow_to_fraction(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", rp.flow_to_fraction("o2_flow", "device").alias("o2_fraction"))


@query("risk_band", v(
    "select obs_id, case when news_score <= 4 then 'Low' when news_score <= 6 then 'Medium' when news_score >= 7 then 'High' end news_risk from obs",
    "obs"))
def q_risk_band(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", nw.risk_band("news_score").alias("news_risk"))


def _band_sql(x, rules, other):
    body = " ".join(f"when {x} >= {b} then {float(s)}" for b, s in rules)
    return f"case when {x} is null then null {body} else {float(other)} end"


def _lookup_sql(x, table):
    return "case " + " ".join(f"when {x} = {k} then {float(val)}" for k, val in table.items()) + " else null end"


_SYS_SQL = ("case when sbp is null then null when sbp >= 220 then 3.0 when sbp >= 111 and sbp <= 219 then 0.0 "
            "when sbp >= 101 and sbp <= 110 then 1.0 when sbp >= 91 and sbp <= 100 then 2.0 when sbp <= 90 then 3.0 else null end")


@query("score_bands", v(
    f"""select obs_id,
 {_band_sql('resp_rate', *nw.RESPIRATION)} resp_s, {_lookup_sql('resp_score', nw.RESPIRATION_REVERSE)} resp_v,
 {_band_sql('o2_sat', *nw.SPO2_SCALE1)} sat_s, {_lookup_sql('o2_score', nw.SPO2_SCALE1_REVERSE)} sat_v,
 {_SYS_SQL} sys_s, {_lookup_sql('bp_score', nw.SYSTOLIC_REVERSE)} sys_v,
 {_band_sql('temperature', *nw.TEMPERATURE)} temp_s, {_lookup_sql('temp_score', nw.TEMPERATURE_REVERSE)} temp_v,
 {_band_sql('heart_rate', *nw.HEART_RATE)} hr_s, {_lookup_sql('hr_score', nw.HEART_RATE_REVERSE)} hr_v
 from obs""", "obs"))
def q_score_bands(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id",
                    nw.respiration_score("resp_rate").alias("resp_s"), nw.respiration_value("resp_score").alias("resp_v"),
                    nw.spo2_scale1_score("o2_sat").alias("sat_s"), nw.spo2_scale1_value("o2_score").alias("sat_v"),
                    nw.systolic_score("sbp").alias("sys_s"), nw.systolic_value("bp_score").alias("sys_v"),
                    nw.temperature_score("temperature").alias("temp_s"), nw.temperature_value("temp_score").alias("temp_v"),
                    nw.heart_rate_score("heart_rate").alias("hr_s"), nw.heart_rate_value("hr_score").alias("hr_v"))


@query("score_bands_cond", v(
    "select obs_id, case when o2_sat is null then null "
    + " ".join(f"when coalesce(assisted, false) and o2_sat >= {b} then {float(s)}" for b, s in nw.SPO2_SCALE2_ASSISTED)
    + " " + " ".join(f"when o2_sat >= {b} then {float(s)}" for b, s in nw.SPO2_SCALE2[0])
    + f" else {float(nw.SPO2_SCALE2[1])} end sat_scale2 from obs", "obs"))
def q_score_bands_cond(spark, d):
    o = fx.obs(spark, d)
    return o.select("obs_id", nw.spo2_scale2_score("o2_sat", "assisted").alias("sat_scale2"))


@query("true_names", v(
    """select obs_id, concat_ws(', ', case when coalesce(assisted, false) then 'assisted' end,
 case when coalesce(alert, false) then 'alert' end, case when op1 is not null then 'procedure' end) flags from obs""", "obs"))
def q_true_names(spark, d):
    from wardlens.functions.families import true_names
    o = fx.obs(spark, d)
    return o.select("obs_id", true_names({"assisted": F.col("assisted"), "alert": F.col("alert"),
                                          "procedure": F.col("op1").isNotNull()}, ", ").alias("flags"))


@query("apply_family", v("select obs_id, abs(heart_rate) heart_rate, abs(temperature) temperature, abs(sbp) sbp from obs",
                         "obs"))
def q_apply_family(spark, d):
    from wardlens.operators.profile import apply_family
    o = fx.obs(spark, d).select("obs_id", "heart_rate", "temperature", "sbp")
    return apply_family(o, ["heart_rate", "temperature", "sbp"], rp.invert_negatives)


# --- projections and row filters ---------------------------------------------

@query("select_group", v("select spell_id, urea_first, urea_last from spells", "spells"))
def q_select_group(spark, d):
    return pj.select_group(fx.spells(spark, d), ps.SPELL_GROUPS, "labs", key="spell_id")


@query("drop_tolerant", v("select spell_id, patient_id, admitted, age, gender, died, los_band, admit_method, specialty from spells",
                          "spells"))
def q_drop_tolerant(spark, d):
    return pj.drop_tolerant(fx.spells(spark, d), ps.SPELL_GROUPS["labs"] + ps.SPELL_GROUPS["obs"] + ["no_such_column"])


@query("drop_group", v("select spell_id, patient_id, admitted, age, gender, died, los_band, admit_method, specialty, urea_first, urea_last from spells",
                       "spells"))
def q_drop_group(spark, d):
    return ps.omit(fx.spells(spark, d), "obs")


@query("drop_redundant", v("select spell_id, age, gender, died, admit_method, specialty, urea_first, urea_last, resp_rate, resp_score, sbp, dbp from spells",
                           "spells"))
def q_drop_redundant(spark, d):
    return pj.drop_tolerant(fx.spells(spark, d), ps.SPELL_REDUNDANT)


_RAW_SCORED = ["spell_id", "age", "resp_rate", "resp_score", "sbp", "dbp"]


@query("raw_vs_scored", v("""select 'raw' layout, spell_id, age, resp_rate, sbp, dbp, null::double resp_score from spells
 union all select 'scored', spell_id, age, null, null, null, resp_score from spells""", "spells"))
def q_raw_vs_scored(spark, d):
    s = fx.spells(spark, d).select(*_RAW_SCORED)
    raw, scored = ps.raw_only(s).withColumn("layout", F.lit("raw")), ps.scored_only(s).withColumn("layout", F.lit("scored"))
    return raw.unionByName(scored, allowMissingColumns=True)


@query("ordered_select", v("select spell_id, admitted, patient_id, age, gender, died, admit_method, specialty from spells", "spells"))
def q_ordered_select(spark, d):
    return pj.ordered_select(fx.spells(spark, d), ps.SPELL_ORDER)


@query("rename_map", v("select spell_id SpellSerial, patient_id PatientNumber, admitted AdmissionDate, age Age, gender Gender from spells",
                       "spells"))
def q_rename_map(spark, d):
    s = fx.spells(spark, d).select("spell_id", "patient_id", "admitted", "age", "gender")
    return s.withColumnsRenamed(ps.SPELL_DISPLAY_NAMES)


@query("mandate", v("select spell_id, age, resp_rate, sbp from spells where age is not null and resp_rate is not null and sbp is not null",
                    "spells"))
def q_mandate(spark, d):
    s = fx.spells(spark, d).select("spell_id", "age", "resp_rate", "sbp")
    return pj.mandate(s, ["age", "resp_rate", "sbp", "not_a_column"])


@query("cohort_filter", v("""select spell_id, cast(patient_id as bigint) patient_id, cast(age as int) age from spells
 where los_band is distinct from 'Still In' and patient_id is not null and age is not null and age >= 16""", "spells"))
def q_cohort_filter(spark, d):
    s = fx.spells(spark, d).select("spell_id", "patient_id", "age", "los_band")
    return pj.cohort_filter(s, "los_band", "patient_id", "age", 16).drop("los_band")


@query("placeholder_to_null", v("select spell_id, nullif(gender, 'Other') gender, nullif(los_band, 'Still In') los_band from spells",
                                "spells"))
def q_placeholder_to_null(spark, d):
    s = fx.spells(spark, d).select("spell_id", "gender", "los_band")
    return pj.placeholder_to_null(s, {"gender": "Other", "los_band": "Still In"})


@query("binarize", v("select spell_id, coalesce(gender in ('Female'), false) gender, coalesce(died in ('Yes'), false) died from spells",
                     "spells"))
def q_binarize(spark, d):
    s = fx.spells(spark, d).select("spell_id", "gender", "died")
    return pj.binarize(s, {"gender": ["Female"], "died": ["Yes"]})


@query("lab_string_repair", v(
    f"""select spell_id,
 case when urea_first in ({_in(pj.LAB_DELETE['Blood_Urea'])}) then null when urea_first = '<1.8' then 0.9 else try_cast(urea_first as double) end urea_first,
 case when urea_last in ({_in(pj.LAB_DELETE['Blood_Urea'])}) then null when urea_last = '<1.8' then 0.9 else try_cast(urea_last as double) end urea_last
 from spells""", "spells"))
def q_lab_string_repair(spark, d):
    s = fx.spells(spark, d)
    dl, cv = pj.LAB_DELETE["Blood_Urea"], pj.LAB_CONVERT["Blood_Urea"]
    return s.select("spell_id", pj.lab_repair("urea_first", dl, cv).alias("urea_first"),
                    pj.lab_repair("urea_last", dl, cv).alias("urea_last"))


@query("to_numeric_coerce", v("select spell_id, try_cast(urea_first as double) urea_first from spells", "spells"))
def q_to_numeric(spark, d):
    s = fx.spells(spark, d)
    return s.select("spell_id", pj.to_numeric("urea_first").alias("urea_first"))


@query("ordinal_levels", v(
    "select spell_id, cast(list_position(['" + "', '".join(ps.PRIORITY_LEVELS) + "'], admit_method) - 1 as int) admit_method_ord from spells",
    "spells"))
def q_ordinal_levels(spark, d):
    s = fx.spells(spark, d)
    return s.select("spell_id", pj.ordinal("admit_method", ps.PRIORITY_LEVELS).alias("admit_method_ord"))


@query("categorize_levels", v(
    f"""select spell_id, cast(coalesce(died = 'Yes', false) as double) died,
 case when specialty in ({_in(ps.SEGMENT_LEVELS)}) then specialty end specialty from spells""", "spells"))
def q_categorize_levels(spark, d):
    s = fx.spells(spark, d).select("spell_id", F.coalesce(F.col("died") == "Yes", F.lit(False)).alias("died"), "specialty")
    return pj.categorize(s, {"specialty": ps.SEGMENT_LEVELS})


@query("trim_all", v(f"select item_id, trim(complaint, {WS_SQL}) complaint, trim(patient_group, {WS_SQL}) patient_group from complaints",
                     "complaints"))
def q_trim_all(spark, d):
    return pj.trim_all(fx.complaints(spark, d))


def _justify_rows_sql(side):
    place = "rk" if side == "up" else "rk + (select count(*) from spells) - count(*) over ()"
    each = {c: f"(select {place} as pos, {c} as v from (select {c}, row_number() over (order by spell_id) rk from spells where {c} is not null) x)" for c in _JUSTIFY}
    return ("select spell_id, " + ", ".join(f"{c}_.v {c}" for c in _JUSTIFY) + " from (select spell_id, row_number() over (order by spell_id) as pos from spells) r "
            + " ".join(f"left join {sql} {c}_ using (pos)" for c, sql in each.items()))


_JUSTIFY = ["urea_first", "resp_rate"]
for _side in ("up", "down"):
    query(f"justify_{_side}", fx.with_views(_justify_rows_sql(_side), "spells"))(
        lambda spark, d, side=_side: pj.justify_rows(fx.spells(spark, d).select("spell_id", *_JUSTIFY), ["spell_id"], _JUSTIFY, side))
