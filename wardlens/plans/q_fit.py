"""Model queries (rows-only checks: the fits are seeded but solver output is not
an SQL-expressible quantity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlens.operators import features as ft
from wardlens.operators import model as md
from wardlens.operators import split as sp
from wardlens.operators import derive as dv
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans import flows as fl
from wardlens.plans import q_flows as qf
from wardlens.plans.registry import query
from wardlens.session import kept
from wardlens.sources import read_table

FEATURES = ["age", "female", "resp_rate", "sbp", "dbp", "urea_first"]


def xy(spark, d):
    """Features + label (critical event within 4 days, CCU/HH1M, admission ward
    counted) on the clean cohort, split by admission time; missing values of both parts
    take the training part's medians. The joined rows are written once: the cut, the
    medians and every pass of a fit read them."""
    raw = fl.from_raw(fx.spells(spark, d))
    st = cm.stays(spark, d).select("spell_id", "path", "died_flag", "total_los")
    lab = dv.critical_event(F.col("died_flag"), F.col("total_los"), F.col("path"), 4, dv.CRITICAL_WARDS_H1, False)
    j = raw.join(st, "spell_id").select("spell_id", "admitted", *[F.col(c).cast("double").alias(c) for c in FEATURES],
                                        lab.cast("int").alias("label"))
    s = sp.time_split(kept(j, "xy"), ["admitted", "spell_id"], 0.33)
    numbers = [c for c in FEATURES if c != "female"]
    return ft.impute_median(s, numbers, ft.fit_medians(s.where(F.col("split") == "train"), numbers))


def _fit(estimator, params=None):
    def run(spark, d):
        t = xy(spark, d)
        train, test = t.where(F.col("split") == "train"), t.where(F.col("split") == "test")
        return md.fit_and_score(train, test, "spell_id", "label", FEATURES, estimator, params)
    return run


_NUM = [c for c in FEATURES if c != "female"]
query("xy", fx.with_views(
    "select spell_id, split, label, cast(female as double) female, " + ", ".join(
        f"coalesce({c}, (select median({c}) from sp where split = 'train')) {c}" for c in _NUM) + " from sp",
    "slots", "spells", "ref_codes", extra=qf._RAW_CTES + [
        ("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), ("cc", cm.sql_cc_time(["CCU", "HH1M"], False)),
        ("jn", f"""select r.spell_id, r.admitted, cast(r.female as int) female, {", ".join(f"cast(r.{c} as double) {c}" for c in _NUM)},
 cast(coalesce(st.died_flag and st.total_los <= 4, false) or coalesce(cc.cc_time <= 4, false) as int) label
 from raw0 r join stays st using (spell_id) left join cc using (spell_id)"""),
        ("sp", """select *, case when row_number() over (order by admitted, spell_id) <= count(*) over () - ceil(0.33 * count(*) over ())
 then 'train' else 'test' end split from jn""")]))(lambda spark, d: xy(spark, d).drop("admitted"))
query("fit_logreg")(_fit("logreg", {"regParam": 0.01, "elasticNetParam": 0.5}))
for _name in ("none", "l1", "l2"):
    query(f"fit_logreg_{_name}")(_fit("logreg", md.PENALTIES[_name]))
query("fit_svc")(_fit("svc"))
query("fit_gbt")(_fit("gbt"))
query("fit_rf")(_fit("rf"))


@query("calibrate_isotonic")
def q_calibrate_isotonic(spark, d):
    t = xy(spark, d)
    return md.calibrated_scores(t.where(F.col("split") == "train"), t.where(F.col("split") == "test"),
                                "spell_id", "label", FEATURES, 5)


@query("tune")
def q_tune(spark, d):
    t = xy(spark, d)
    return md.tune(t.where(F.col("split") == "train"), "label", FEATURES, "spell_id", 5)


@query("tune_halving")
def q_tune_halving(spark, d):
    t = xy(spark, d)
    points = md.draw_points(md.SPACES["logreg"], 4)
    return md.successive_halving(t.where(F.col("split") == "train"), "label", FEATURES, "spell_id", points, "logreg", 5)[1]


@query("text_classifier")
def q_text_classifier(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "text"])
    lb = read_table(spark, d, "labels", ["doc_id", "quality"])
    s = docs.join(sp.stratified_split(lb, "doc_id", "quality", 0.2), "doc_id")  # only keys and labels are ranked
    return md.text_scores(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"),
                          "doc_id", "text", "quality")


@query("text_tokens", """select doc_id, len(tk) n_tokens, array_to_string(tk[1:3], ' ') first_three from
 (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') tk from documents) t""")
def q_text_tokens(spark, d):
    t = md.with_tokens(read_table(spark, d, "documents", ["doc_id", "text"]), "text", "tk")
    return t.select("doc_id", F.size("tk").alias("n_tokens"), F.array_join(F.slice("tk", 1, 3), " ").alias("first_three"))
