"""Outcome queries: mortality, critical care, critical event, history, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.functions import families as fam
from wardlens.operators import derive as dv
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans.registry import query

WITHIN = 4
WARDS = dv.CRITICAL_WARDS_H1


def _stays_sql(body: str, extra=()):
    return fx.with_views(body, "slots", "spells",
                         extra=[("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), *extra])


def critical_event_stays(spark, d):
    s = cm.stays(spark, d)
    p, died, los = F.col("path"), F.col("died_flag"), F.col("total_los")
    return s.select(
        "spell_id", "admit_ward",
        dv.mortality(died, los, WITHIN).alias("mortality"),
        dv.critical_care(p, WARDS, WITHIN, ignore_admit_ward=False).alias("critical_care"),
        dv.critical_event(died, los, p, WITHIN, WARDS, ignore_admit_ward=False).alias("critical_event"))


CE_SQL = """select spell_id, admit_ward,
 coalesce(died_flag and total_los <= 4, false) mortality,
 coalesce(cc.cc_time <= 4, false) critical_care,
 coalesce(died_flag and total_los <= 4, false) or coalesce(cc.cc_time <= 4, false) critical_event
 from stays left join cc using (spell_id)"""


@query("critical_event", _stays_sql(CE_SQL, [("cc", cm.sql_cc_time(WARDS, False))]))
def q_critical_event(spark, d):
    return critical_event_stays(spark, d)


@query("critical_event_rate", _stays_sql(
    "select admit_ward, count(*) n_stays, cast(count_if(critical_event) as bigint) n_critical, "
    "round(count_if(critical_event) / count(*), 6) rate from (" + CE_SQL + ") t group by admit_ward",
    [("cc", cm.sql_cc_time(WARDS, False))]))
def q_critical_event_rate(spark, d):
    return (critical_event_stays(spark, d).groupBy("admit_ward")
            .agg(F.count(F.lit(1)).alias("n_stays"), F.count_if("critical_event").alias("n_critical"))
            .withColumn("rate", F.round(F.col("n_critical") / F.col("n_stays"), 6)))


@query("critical_event_time", _stays_sql(
    """select spell_id, cc.cc_time critical_care_time,
 case when died_flag then total_los else 0.0 end death_time,
 coalesce(nullif(cc.cc_time, 0), case when died_flag then total_los else 0.0 end) critical_event_time
 from stays left join cc using (spell_id)""", [("cc", cm.sql_cc_time(WARDS, True))]))
def q_critical_event_time(spark, d):
    s = cm.stays(spark, d)
    p, died, los = F.col("path"), F.col("died_flag"), F.col("total_los")
    return s.select("spell_id",
                    dv.critical_care_time(p, WARDS, True).alias("critical_care_time"),
                    dv.death_time(died, los).alias("death_time"),
                    dv.critical_event_time(died, los, p, WARDS, True).alias("critical_event_time"))


@query("critical_care", _stays_sql(
    """select spell_id, coalesce(cc.cc_time <= 1, false) critical_care_strict,
 coalesce(cc2.cc_time <= 1, false) critical_care_direct
 from stays left join cc using (spell_id) left join cc2 using (spell_id)""",
    [("cc", cm.sql_cc_time(["CCU"], True)), ("cc2", cm.sql_cc_time(["CCU"], False))]))
def q_critical_care(spark, d):
    s = cm.stays(spark, d)
    p = F.col("path")
    return s.select("spell_id",
                    dv.critical_care(p, ["CCU"], 1, True).alias("critical_care_strict"),
                    dv.critical_care(p, ["CCU"], 1, False).alias("critical_care_direct"))


@query("critical_care_time", _stays_sql(
    "select spell_id, cc_time critical_care_time from cc",
    [("cc", cm.sql_cc_time(["CCU", "HH1M"], True))]))
def q_critical_care_time(spark, d):
    s = cm.stays(spark, d)
    t = dv.critical_care_time(F.col("path"), ["CCU", "HH1M"], True)
    return s.select("spell_id", t.alias("critical_care_time")).where(F.col("critical_care_time").isNotNull())


@query("mortality", _stays_sql(
    """select spell_id, coalesce(died_flag and total_los <= 1, false) mortality_1d,
 coalesce(died_flag and total_los <= 7, false) mortality_7d, died_flag mortality_any from stays"""))
def q_mortality(spark, d):
    s = cm.stays(spark, d)
    died, los = F.col("died_flag"), F.col("total_los")
    return s.select("spell_id", dv.mortality(died, los, 1).alias("mortality_1d"),
                    dv.mortality(died, los, 7).alias("mortality_7d"),
                    dv.mortality(died, los, None).alias("mortality_any"))


@query("death_time", _stays_sql(
    "select spell_id, case when died_flag then total_los else 0.0 end death_time from stays"))
def q_death_time(spark, d):
    s = cm.stays(spark, d)
    return s.select("spell_id", dv.death_time(F.col("died_flag"), F.col("total_los")).alias("death_time"))


# 30-day death in the fixture: died, or a key rule for deaths after discharge
_W30_SQL = "(died_flag or spell_id % 13 = 0)"


@query("mortality_class", _stays_sql(
    f"""select spell_id, concat_ws('',
   case when died_flag and not coalesce(died_flag and total_los <= 2, false) then 'DiedDuringStay' end,
   case when {_W30_SQL} then 'DiedWithin30Days' end,
   case when coalesce(died_flag and total_los <= 2, false) then 'DiedWithinThreshold' end,
   case when not ((died_flag and not coalesce(died_flag and total_los <= 2, false)) or {_W30_SQL}
                  or coalesce(died_flag and total_los <= 2, false)) then 'DidNotDie' end) mortality_class
 from stays"""))
def q_mortality_class(spark, d):
    s = cm.stays(spark, d)
    died, los = F.col("died_flag"), F.col("total_los")
    w30 = died | (F.col("spell_id") % 13 == 0)
    return s.select("spell_id", dv.mortality_class(died, w30, dv.mortality(died, los, 2)).alias("mortality_class"))


@query("path_elapsed", fx.with_views(
    "select spell_id, slot, ward, elapsed from steps", "slots", extra=[("steps", cm.SQL_STEPS)]))
def q_path_elapsed(spark, d):
    p = cm.paths(spark, d)
    steps = fam.elapsed_before_steps(F.col("path"), "los")
    e = p.select("spell_id", F.explode(steps).alias("s"))
    return e.select("spell_id", "s.slot", "s.ward", F.round("s.elapsed", 6).alias("elapsed"))


@query("first_match_step", fx.with_views(
    """select spell_id, min(rn) first_pos, arg_min(slot, rn) first_slot from steps
 where ward in ('CCU', 'HH1M') group by spell_id""", "slots", extra=[("steps", cm.SQL_STEPS)]))
def q_first_match_step(spark, d):
    p = cm.paths(spark, d)
    pos = fam.first_match(F.col("path"), lambda x: x["ward"].isin("CCU", "HH1M"))
    return (p.select("spell_id", pos.alias("first_pos"), F.col("path"))
            .where(F.col("first_pos").isNotNull())
            .select("spell_id", "first_pos", F.element_at("path", F.col("first_pos"))["slot"].alias("first_slot")))


@query("sdec", _stays_sql(
    "select spell_id, coalesce(admit_ward in ('AEC', 'AAA'), false) sent_to_sdec from stays"))
def q_sdec(spark, d):
    s = cm.stays(spark, d)
    return s.select("spell_id", dv.sdec(F.col("admit_ward")).alias("sent_to_sdec"))


@query("long_los", _stays_sql(
    "select spell_id, coalesce(total_los >= 7, false) long_los from stays"))
def q_long_los(spark, d):
    s = cm.stays(spark, d)
    return s.select("spell_id", dv.long_los(F.col("total_los"), 7).alias("long_los"))


# --- history: previous / next admission of the same patient -----------------

_GAPS_SQL = """select spell_id, patient_id, admitted,
 case when patient_id is not null then epoch(admitted) - epoch(lag(admitted) over w) end prev_gap_s,
 case when patient_id is not null then epoch(lead(admitted) over w) - epoch(admitted) end next_gap_s
 from spells window w as (partition by patient_id order by admitted, spell_id)"""


def _gaps(spark, d):
    return dv.readmission_spans(fx.spells(spark, d), "patient_id", "admitted", "spell_id")


@query("prev_gap", fx.with_views("select spell_id, cast(prev_gap_s as bigint) prev_gap_s from gaps",
                                 "spells", extra=[("gaps", _GAPS_SQL)]))
def q_prev_gap(spark, d):
    return _gaps(spark, d).select("spell_id", F.col("prev_gap_s").cast("bigint"))


@query("next_gap", fx.with_views("select spell_id, cast(next_gap_s as bigint) next_gap_s from gaps",
                                 "spells", extra=[("gaps", _GAPS_SQL)]))
def q_next_gap(spark, d):
    return _gaps(spark, d).select("spell_id", F.col("next_gap_s").cast("bigint"))


@query("readmission", fx.with_views(
    "select spell_id, coalesce(prev_gap_s < 30 * 86400, false) readmission from gaps",
    "spells", extra=[("gaps", _GAPS_SQL)]))
def q_readmission(spark, d):
    return _gaps(spark, d).select("spell_id", dv.readmission(F.col("prev_gap_s"), 30).alias("readmission"))


@query("readmitted", fx.with_views(
    "select spell_id, coalesce(next_gap_s < 30 * 86400, false) readmitted, cast(next_gap_s as bigint) readmitted_span_s from gaps",
    "spells", extra=[("gaps", _GAPS_SQL)]))
def q_readmitted(spark, d):
    g = _gaps(spark, d)
    return g.select("spell_id", dv.readmission(F.col("next_gap_s"), 30).alias("readmitted"),
                    F.col("next_gap_s").cast("bigint").alias("readmitted_span_s"))


def _band_sql(col, edges, labels, default):
    parts = " ".join(f"when {col} > {lo} and {col} <= {hi} then '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"case {parts} else '{default}' end"


@query("readmission_band", fx.with_views(
    "select spell_id, "
    + _band_sql("prev_gap_s / 86400.0", dv.READMISSION_EDGES_DAYS, dv.READMISSION_LABELS + ["N/A"], "N/A")
    + " readmission_band, "
    + _band_sql("prev_gap_s / 86400.0", dv.READMISSION_EDGES_DAYS[1:], dv.READMISSION_LABELS, "N/A")
    + " readmission_band_aligned from gaps", "spells", extra=[("gaps", _GAPS_SQL)]))
def q_readmission_band(spark, d):
    g = _gaps(spark, d)
    return g.select("spell_id", dv.readmission_band(F.col("prev_gap_s")).alias("readmission_band"),
                    dv.readmission_band(F.col("prev_gap_s"), aligned=True).alias("readmission_band_aligned"))
