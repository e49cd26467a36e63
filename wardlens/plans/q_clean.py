"""Measurement repair queries (D14-D25) on the observation view."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions import news as nw
from wardlens.functions import repair as rp
from wardlens.functions import text as tx
from wardlens.functions.codes import COPD_CODES
from wardlens.operators import clean as cl
from wardlens.plans import fixtures as fx
from wardlens.plans.registry import query

NEWS_PARTS = ["temp_score", "hr_score", "o2_score", "resp_score", "bp_score", "air_score", "con_score"]


def v(body, *names, extra=()):
    return fx.with_views(body, *names, extra=list(extra))


def _in(vals):
    return ", ".join("'" + x.replace("'", "''") + "'" for x in vals)


def band_sql(x, rules, other):
    body = " ".join(f"when {x} >= {b} then {float(s)}" for b, s in rules)
    return f"(case when {x} is null then null {body} else {float(other)} end)"


def lookup_sql(x, table):
    return "(case " + " ".join(f"when {x} = {k} then {float(val)}" for k, val in table.items()) + " else null end)"


def sys_sql(x):
    return (f"(case when {x} is null then null when {x} >= 220 then 3.0 when {x} >= 111 and {x} <= 219 then 0.0 "
            f"when {x} >= 101 and {x} <= 110 then 1.0 when {x} >= 91 and {x} <= 100 then 2.0 when {x} <= 90 then 3.0 else null end)")


def spo2_2_sql(x, a):
    asst = " ".join(f"when coalesce({a}, false) and {x} >= {b} then {float(s)}" for b, s in nw.SPO2_SCALE2_ASSISTED)
    rest = " ".join(f"when {x} >= {b} then {float(s)}" for b, s in nw.SPO2_SCALE2[0])
    return f"(case when {x} is null then null {asst} {rest} else {float(nw.SPO2_SCALE2[1])} end)"


@query("recompute_total", v(
    "select obs_id, case when " + " and ".join(f"{p} is not null" for p in NEWS_PARTS)
    + " and (news_score is null or news_score <> (" + " + ".join(NEWS_PARTS) + ")) then (" + " + ".join(NEWS_PARTS)
    + ") else news_score end news_score from obs", "obs"))
def q_recompute_total(spark, d):
    o = fx.obs(spark, d)
    return cl.recompute_total(o, NEWS_PARTS, "news_score").select("obs_id", "news_score")


@query("repair_bp", v(
    f"""select obs_id, d dbp, case when s is null and sc is not null then {lookup_sql('sc', nw.SYSTOLIC_REVERSE)} else s end sbp,
 case when sc is null and s is not null then {sys_sql('s')} else sc end bp_score from
 (select obs_id, sc, d, case when coalesce(s0 <= 40 or s0 >= 300 or s0 <= d + 5, false) then null else s0 end s from
  (select obs_id, bp_score sc, abs(sbp) s0, case when coalesce(abs(dbp) <= 20 or abs(dbp) >= 200, false) then null else abs(dbp) end d from obs) a) b""",
    "obs"))
def q_repair_bp(spark, d):
    return cl.repair_bp(fx.obs(spark, d), "sbp", "dbp", "bp_score").select("obs_id", "dbp", "sbp", "bp_score")


@query("repair_resp", v(
    f"""select obs_id, case when r is null and sc is not null then {lookup_sql('sc', nw.RESPIRATION_REVERSE)} else r end resp_rate,
 case when sc is null and r is not null then {band_sql('r', *nw.RESPIRATION)} else sc end resp_score from
 (select obs_id, resp_score sc, case when coalesce(r1 <= 5 or r1 >= 80, false) then null else r1 end r from
  (select obs_id, resp_score, case when abs(resp_rate) >= 100 then floor(abs(resp_rate) / 10) else abs(resp_rate) end r1 from obs) a) b""",
    "obs"))
def q_repair_resp(spark, d):
    return cl.repair_resp(fx.obs(spark, d), "resp_rate", "resp_score").select("obs_id", "resp_rate", "resp_score")


@query("repair_temp", v(
    f"""select obs_id, case when t is null and sc is not null then {lookup_sql('sc', nw.TEMPERATURE_REVERSE)} else t end temperature,
 case when sc is null and t is not null then {band_sql('t', *nw.TEMPERATURE)} else sc end temp_score from
 (select obs_id, temp_score sc, case when coalesce(temperature < 25 or temperature > 45, false) then null else temperature end t from obs) a""",
    "obs"))
def q_repair_temp(spark, d):
    return cl.repair_temp(fx.obs(spark, d), "temperature", "temp_score").select("obs_id", "temperature", "temp_score")


@query("repair_hr", v(
    f"""select obs_id, case when h is null and sc is not null then {lookup_sql('sc', nw.HEART_RATE_REVERSE)} else h end heart_rate,
 case when sc is null and h is not null then {band_sql('h', *nw.HEART_RATE)} else sc end hr_score from
 (select obs_id, hr_score sc, case when coalesce(heart_rate < 25 or heart_rate > 300, false) then null else heart_rate end h from obs) a""",
    "obs"))
def q_repair_hr(spark, d):
    return cl.repair_hr(fx.obs(spark, d), "heart_rate", "hr_score").select("obs_id", "heart_rate", "hr_score")


@query("repair_flag_score", v(
    """select obs_id, case when c = 3.0 then false when c = 0.0 then true end alert, c con_score,
 case when a = 2.0 then true when a = 0.0 then false end assisted, a air_score from
 (select obs_id,
   case when c0 is null and alert is not null then case when alert then 0.0 else 3.0 end else c0 end c,
   case when a0 is null and assisted is not null then case when assisted then 2.0 else 0.0 end else a0 end a
  from (select *, case when con_score = 1.0 then null else con_score end c0, case when air_score = 1.0 then null else air_score end a0 from obs) x) y""",
    "obs"))
def q_repair_flag_score(spark, d):
    o = cl.repair_consciousness(fx.obs(spark, d), "alert", "con_score")
    o = cl.repair_device_air(o, "assisted", "air_score")
    return o.select("obs_id", "alert", "con_score", "assisted", "air_score")


_NHF = "case when coalesce(starts_with(lower(device), 'other; nhf'), false) then 'NHF' else device end"
_DEVICE_CTES = [
    ("m", f"select obs_id, assisted, {_NHF} device from obs"),
    ("top", "select device from m where device is not null group by device order by count(*) desc, device limit 16"),
    ("k", "select obs_id, assisted, case when device is not null and device not in (select device from top) then 'Other' else device end device from m"),
    ("a", "select obs_id, device, case when device is not null and device <> 'A - Air' and not coalesce(assisted, false) then true else assisted end assisted from k"),
]


@query("repair_device", v(
    "select obs_id, case when coalesce(assisted, false) and coalesce(device = 'A - Air' or device is null, false) then 'Other' else device end device, assisted from a",
    "obs", extra=_DEVICE_CTES))
def q_repair_device(spark, d):
    return cl.repair_device(fx.obs(spark, d), "device", "assisted", 16).select("obs_id", "device", "assisted")


_O2_CTES = [
    ("o1", "select obs_id, o2_score sc, assisted, device, diag1, op1, case when sat_a <= 10 then sat_a * 10 else sat_a end s1 "
           "from (select *, case when abs(o2_sat) = 0 then null else abs(o2_sat) end sat_a from obs) t"),
    ("st", "select avg(s1) - 3 * stddev_samp(s1) bound from o1"),
    ("o2", f"""select o1.*, coalesce(s1 > 100 or s1 <= bound, false) outlier,
 coalesce(op1 = 'E85.2', false) or coalesce(device = 'NIV - NIV', false)
 or (coalesce(diag1 in ({_in(COPD_CODES)}), false) and coalesce(starts_with(device, 'V'), false))
 or (coalesce(diag1 in ({_in(COPD_CODES)}), false) and coalesce(s1 < 88, false)) scale2 from o1, st"""),
    ("o3", "select *, case when outlier and scale2 and coalesce(sc = 0, false) then 92.0 when outlier then null else s1 end s2 from o2"),
    ("o4", f"""select *, case when s2 is null and sc is not null and not scale2 then {lookup_sql('sc', nw.SPO2_SCALE1_REVERSE)}
 when s2 is null and sc is not null and scale2 and sc = 0 then 92.0 else s2 end s3 from o3"""),
]


@query("repair_o2", v(
    f"""select obs_id, s3 o2_sat, case when s3 is not null and sc is null and not scale2 then {band_sql('s3', *nw.SPO2_SCALE1)}
 when s3 is not null and sc is null and scale2 then {spo2_2_sql('s3', 'assisted')} else sc end o2_score from o4""",
    "obs", extra=_O2_CTES))
def q_repair_o2(spark, d):
    o = fx.obs(spark, d)
    bound = cl.fit_sigma_bound(o.select(cl.o2_prepared("o2_sat").alias("s")), ["s"], 3.0)
    r = cl.repair_o2(o, "o2_sat", "o2_score", "assisted", "device", ["diag1"], ["op1"], bound)
    return r.select("obs_id", "o2_sat", "o2_score")


# --- new-layout observation cleaning (one projection + two fitted statistics) --

def clean_obs(o):
    """Resp: sign, triple digits /10, keep (5, 80); SpO2: sign, single digits x10,
    keep (0, 100], then drop <= mean - 3 std; temperature: sign, keep (25, 45);
    diastolic (20, 200); systolic (40, 300) and above diastolic + 5; heart rate:
    sign, keep (25, 300); device text cleaned and cut to its top 16 levels."""
    sat0 = rp.shift_single(rp.invert_negatives("o2_sat"))
    sat1 = F.when(F.coalesce((sat0 <= 0) | (sat0 > 100), F.lit(False)), F.lit(None)).otherwise(sat0)
    dia = rp.clip_sentinel("dbp", 20, 200)
    stage = o.select(
        "obs_id",
        rp.clip_sentinel(rp.shift_triple(rp.invert_negatives("resp_rate")), 5, 80).alias("resp_rate"),
        sat1.alias("o2_sat"),
        rp.clip_sentinel(rp.invert_negatives("temperature"), 25, 45).alias("temperature"),
        dia.alias("dbp"),
        rp.mask_against(rp.clip_sentinel("sbp", 40, 300), dia, 5).alias("sbp"),
        rp.clip_sentinel(rp.invert_negatives("heart_rate"), 25, 300).alias("heart_rate"),
        tx.device_text("device").alias("device"))
    bound = cl.fit_sigma_bound(stage, ["o2_sat"], 3.0)
    stage = stage.withColumn("o2_sat", rp.clip_sentinel("o2_sat", bound, 1e308) if bound is not None else F.col("o2_sat"))
    return cl.topn_keep(stage, "device", 16)


_CO_CTES = [
    ("c1", """select obs_id,
 case when coalesce(r0 <= 5 or r0 >= 80, false) then null else r0 end resp_rate,
 case when coalesce(s0 <= 0 or s0 > 100, false) then null else s0 end o2_sat,
 case when coalesce(abs(temperature) <= 25 or abs(temperature) >= 45, false) then null else abs(temperature) end temperature,
 d dbp,
 case when coalesce(sb <= d + 5, false) then null else sb end sbp,
 case when coalesce(abs(heart_rate) <= 25 or abs(heart_rate) >= 300, false) then null else abs(heart_rate) end heart_rate,
 split_part(trim(replace(upper(device), 'OTHER;', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), ';', 1) device
 from (select *, case when abs(resp_rate) >= 100 then abs(resp_rate) / 10 else abs(resp_rate) end r0,
   case when abs(o2_sat) < 10 then abs(o2_sat) * 10 else abs(o2_sat) end s0,
   case when coalesce(dbp <= 20 or dbp >= 200, false) then null else dbp end d,
   case when coalesce(sbp <= 40 or sbp >= 300, false) then null else sbp end sb from obs) t"""),
    ("b", "select avg(o2_sat) - 3 * stddev_samp(o2_sat) bound from c1"),
    ("top", "select device from c1 where device is not null group by device order by count(*) desc, device limit 16"),
]


@query("clean_obs", v(
    """select obs_id, resp_rate, case when coalesce(o2_sat <= bound or o2_sat >= 1e308, false) then null else o2_sat end o2_sat,
 temperature, dbp, sbp, heart_rate, case when device is not null and device not in (select device from top) then null else device end device
 from c1, b""", "obs", extra=_CO_CTES))
def q_clean_obs(spark, d):
    return clean_obs(fx.obs(spark, d))


# --- free text ---------------------------------------------------------------

def clean_text_new(c, col="complaint", n=50):
    """New layout: lower/strip, vague -> null, outside the top ``n`` -> null."""
    t = c.withColumn(col, tx.vague_to(tx.normalise(col)))
    return cl.topn_keep(t, col, n)


def clean_text_old(c, col="complaint", n=50):
    """Old layout: lower/strip, vague -> 'other', outside the top ``n`` -> 'other'."""
    t = c.withColumn(col, tx.vague_to(tx.normalise(col), "other"))
    return cl.topn_keep(t, col, n, sentinel="other")


_TEXT_N = f"case when trim(lower(complaint), ' .?+') in ({_in(tx.VAGUE_TERMS)}) then null else trim(lower(complaint), ' .?+') end"
_TEXT_O = f"case when trim(lower(complaint), ' .?+') in ({_in(tx.VAGUE_TERMS)}) then 'other' else trim(lower(complaint), ' .?+') end"


@query("clean_text_topn", v(
    """select n.item_id, case when n.c is not null and n.c not in (select c from tn) then null else n.c end complaint_new,
 case when o.c is not null and o.c not in (select c from tol) then 'other' else o.c end complaint_old
 from nn n join oo o using (item_id)""", "complaints", extra=[
        ("nn", f"select item_id, {_TEXT_N} c from complaints"), ("oo", f"select item_id, {_TEXT_O} c from complaints"),
        ("tn", "select c from nn where c is not null group by c order by count(*) desc, c limit 50"),
        ("tol", "select c from oo where c is not null group by c order by count(*) desc, c limit 50")]))
def q_clean_text_topn(spark, d):
    c = fx.complaints(spark, d).select("item_id", F.col("complaint").alias("complaint_new"), F.col("complaint").alias("complaint_old"))
    return clean_text_old(clean_text_new(c, "complaint_new"), "complaint_old")
