"""Feature and label assembly with its options (P9, M8), oversampling (M14), load or derive (S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.operators import derive as dv
from wardlens.operators import neighbours as nb
from wardlens.operators import prepare as pr
from wardlens.operators import split as sp
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans import presets as ps
from wardlens.plans.registry import query
from wardlens.session import scratch_path
from wardlens.sources.derived import load_or_derive

NUMBERS, TEXTS = ["age", "resp_rate", "sbp", "dbp"], ["gender", "specialty"]
FEATURES = [*NUMBERS, *TEXTS]


def stays_split(spark, d):
    st = cm.stays(spark, d).select("spell_id", "path", "died_flag", "total_los")
    s = fx.spells(spark, d).select("spell_id", "admitted", *FEATURES).join(st, "spell_id")
    return sp.time_split(s, ["admitted", "spell_id"], 0.33)


def _xy(outcome, within, features=FEATURES, **options):
    def run(spark, d):
        label = pr.outcome(outcome, F.col("died_flag"), F.col("total_los"), F.col("path"), within)
        got, _ = pr.xy(stays_split(spark, d), "spell_id", features, label, F.col("split") == "train",
                       ["admitted", "split", "path", "died_flag", "total_los"], **options)
        return got
    return run


_LABEL = {
    "CriticalEvent": "cast(coalesce(died_flag and total_los <= {w}, false) or coalesce(cc.cc_time <= {w}, false) as int)",
    "CriticalCare": "cast(coalesce(cc.cc_time <= {w}, false) as int)",
    "Mortality": "cast(coalesce(died_flag and total_los <= {w}, false) as int)",
}


def _sql(outcome, within, body):
    """``body`` over x (spell_id, features, label, split) and tr, its training rows."""
    return fx.with_views(body, "slots", "spells", extra=[
        ("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), ("cc", cm.sql_cc_time(dv.CRITICAL_WARDS_H1, False)),
        ("x0", f"select s.spell_id, s.admitted, {', '.join('s.' + c for c in FEATURES)}, {_LABEL[outcome].format(w=within)} as label "
               "from spells s join (select spell_id, died_flag, total_los from stays) st using (spell_id) left join cc using (spell_id)"),
        ("x", """select *, case when row_number() over (order by admitted, spell_id) <= count(*) over () - ceil(0.33 * count(*) over ())
 then 'train' else 'test' end split from x0"""),
        ("tr", "select * from x where split = 'train'")])


_PLAIN = ", ".join(FEATURES)
_KNOWN = {c: f"case when {c} in (select distinct {c} from tr where {c} is not null) then {c} end" for c in TEXTS}
_MEDIAN = {c: f"coalesce(cast({c} as double), (select median({c}) from tr))" for c in NUMBERS}
_S_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_HOT = {"gender": ["Female", "Male", "Other"], "specialty": _S_LEVELS}


def _position(c, filled):
    lv = f"(select list(distinct {c} order by {c}) from tr where {c} is not null)"
    found = f"list_position({lv}, {c}) - 1"
    return f"cast(coalesce({found}, len({lv})) as int) {c}" if filled else f"cast(coalesce({found}, -1) as int) {c}"


query("dropna_xy", _sql("CriticalEvent", 4, f"select spell_id, label, {_PLAIN} from x where " + " and ".join(f"{c} is not null" for c in FEATURES)))(
    _xy("CriticalEvent", 4, dropna=True))
query("xy_mortality_fillna", _sql("Mortality", 1, "select spell_id, label, " + ", ".join(f"coalesce({c}, -1) {c}" for c in NUMBERS) + ", "
                                  + ", ".join(f"coalesce({_KNOWN[c]}, 'NAN') {c}" for c in TEXTS) + " from x"))(_xy("Mortality", 1, fillna=True))
query("xy_critical_care_ordinal", _sql("CriticalCare", 7, "select spell_id, label, " + ", ".join(NUMBERS) + ", " + ", ".join(_position(c, False) for c in TEXTS) + " from x"))(
    _xy("CriticalCare", 7, encoding="ordinal"))
query("xy_fillna_ordinal", _sql("CriticalEvent", 30, "select spell_id, label, " + ", ".join(f"coalesce({c}, -1) {c}" for c in NUMBERS) + ", "
                                + ", ".join(_position(c, True) for c in TEXTS) + " from x"))(_xy("CriticalEvent", 30, fillna=True, encoding="ordinal"))
query("xy_imputed_onehot", _sql("CriticalEvent", 1, "select spell_id, label, " + ", ".join(f"{_MEDIAN[c]} {c}" for c in NUMBERS) + ", "
                                + ", ".join(f"coalesce(cast({c} = '{x}' as int), 0) {c}__{x}" for c in TEXTS for x in _HOT[c]) + " from x"))(
    _xy("CriticalEvent", 1, imputation=True, encoding="onehot"))
query("xy_all_columns", _sql("Mortality", 7, f"select spell_id, label, {_PLAIN} from x"))(_xy("Mortality", 7, features=()))


@query("xy_scaled", _sql("CriticalEvent", 4, "select spell_id, label, " + ", ".join(
    f"round(({c} - (select avg({c}) from tr)) / (select stddev_pop({c}) from tr), 9) {c}" for c in NUMBERS) + " from x"))
def q_xy_scaled(spark, d):
    got = _xy("CriticalEvent", 4, features=NUMBERS, scale=True)(spark, d)
    return got.select("spell_id", "label", *[F.round(c, 9).alias(c) for c in NUMBERS])


# --- neighbours and oversampling -----------------------------------------------

KNN_NUMBERS, KNN_LEVELS, MISMATCH, K = ["age", "resp_rate", "sbp", "dbp"], ["gender"], 25.0, 5


def _deaths(spark, d):
    s = fx.spells(spark, d).select("spell_id", *KNN_NUMBERS, *KNN_LEVELS, F.coalesce(F.col("died") == "Yes", F.lit(False)).cast("int").alias("label"))
    return pr.drop_missing(s, KNN_NUMBERS)


_KNN_CTES = [
    ("a", f"select spell_id, {', '.join(KNN_NUMBERS + KNN_LEVELS)}, cast(coalesce(died = 'Yes', false) as int) label from spells where "
     + " and ".join(f"{c} is not null" for c in KNN_NUMBERS)),
    ("m", "select * from a where label = 1"),
    ("pr", "select p.spell_id, q.spell_id neighbour, " + " + ".join(f"(p.{c} - q.{c})::double * (p.{c} - q.{c})" for c in KNN_NUMBERS)
     + f" + case when p.gender is not distinct from q.gender then 0 else {MISMATCH * MISMATCH} end d2 from m p join m q on p.spell_id <> q.spell_id"),
    ("nn", f"select * from (select *, row_number() over (partition by spell_id order by sqrt(d2), neighbour) rank from pr) r where rank <= {K}"),
]


@query("minority_neighbours", fx.with_views("select spell_id, cast(rank as int) rank, neighbour, round(sqrt(d2), 9) distance from nn", "spells", extra=_KNN_CTES))
def q_minority_neighbours(spark, d):
    got = nb.knn_join(_deaths(spark, d).where("label = 1"), "spell_id", KNN_NUMBERS, KNN_LEVELS, K, MISMATCH)
    return got.withColumn("distance", F.round("distance", 9))


_U = "('0x' || substr(md5(spell_id || '|' || copy), {0}, 8))::bigint"
_SMOTE_CTES = [
    ("sz", "select count(*) n, count_if(label = 1) few from a"),
    ("ask", "select few, greatest(0, (n - few) - few) new from sz"),
    ("bs", "select m.*, row_number() over (order by md5(spell_id::varchar), spell_id) rk from m"),
    ("cp", "select bs.*, c.copy from bs, ask, range(1, 100) c(copy) where (c.copy - 1) * few + rk <= new"),
    ("ch", f"select cp.*, {_U.format(1)} % (select count(*) from nn where nn.spell_id = cp.spell_id) + 1 pick, {_U.format(9)} / 4294967296.0::double gap from cp"),
    ("md", "select spell_id, gender from (select nn.spell_id, coalesce(m.gender, 'NAN') gender, row_number() over (partition by nn.spell_id order by count(*) desc, "
           "coalesce(m.gender, 'NAN')) k from nn join m on m.spell_id = nn.neighbour group by nn.spell_id, coalesce(m.gender, 'NAN')) g where k = 1"),
]


@query("smote", fx.with_views("select ch.spell_id, cast(ch.copy as int) copy, nn.neighbour, " + ", ".join(
    f"nullif(round(ch.{c} + gap * (o.{c} - ch.{c}), 9), -1) {c}" for c in KNN_NUMBERS)
    + ", nullif(md.gender, 'NAN') gender, 1 label from ch join nn on nn.spell_id = ch.spell_id and nn.rank = ch.pick join m o on o.spell_id = nn.neighbour join md on md.spell_id = ch.spell_id",
    "spells", extra=_KNN_CTES + _SMOTE_CTES))
def q_smote(spark, d):
    return nb.smote(_deaths(spark, d), "spell_id", "label", KNN_NUMBERS, KNN_LEVELS, K, 0.5, 1, MISMATCH)


# --- load or derive --------------------------------------------------------------

@query("load_or_derive", fx.with_views("select spell_id, age, gender, true as loaded from spells where age >= 16", "spells"))
def q_load_or_derive(spark, d):
    build = lambda: fx.spells(spark, d).select("spell_id", "age", "gender").where("age >= 16")
    root = scratch_path(spark, "derived")
    load_or_derive(spark, root, "adults", build)
    got, loaded = load_or_derive(spark, root, "adults", build)
    return got.withColumn("loaded", F.lit(loaded))
