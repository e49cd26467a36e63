"""Experiment grid queries (M22) and feature-set combinations (M7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlens.operators import derive as dv
from wardlens.operators import grid as gr
from wardlens.operators import metrics as mt
from wardlens.operators import split as sp
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans import presets as ps
from wardlens.plans import q_model as qm
from wardlens.plans.registry import query
from wardlens.session import scratch_path
from wardlens.sources import read_table, write_table

WITHIN = [1, 4, 7]
N_RESAMPLES = 99
FEATURES = {s: ps.GRID_SETS[s] for s in ("demographics", "obs", "admission", "all")}
CELLS = gr.legal_cells(gr.LEVEL_ESTIMATORS, gr.LEVEL_RESAMPLERS, FEATURES, WITHIN, ps.GRID_CATEGORICAL)

#: Level of each feature: numbers in steps of a width, strings as they are.
WIDTHS = {"age": 10, "resp_rate": 10, "sbp": 20, "dbp": 20}
LEVELS = ps.GRID_SETS["all"]
_SQL_LEVELS = {c: f"cast(cast(floor({c} / {WIDTHS[c]}) as bigint) as varchar)" if c in WIDTHS else c for c in LEVELS}


def levels():
    return {c: F.floor(F.col(c) / WIDTHS[c]).cast("long") if c in WIDTHS else F.col(c) for c in LEVELS}


def labelled(spark, d, split: bool = True):
    """Stays with features, critical event within each of ``WITHIN`` days, and a time split."""
    st = cm.stays(spark, d).select("spell_id", "path", "died_flag", "total_los")
    s = fx.spells(spark, d).select("spell_id", "admitted", *LEVELS).join(st, "spell_id")
    for w in WITHIN:
        event = dv.critical_event(F.col("died_flag"), F.col("total_los"), F.col("path"), w, dv.CRITICAL_WARDS_H1, False)
        s = s.withColumn(f"y{w}", event.cast("int"))
    s = s.select("spell_id", "admitted", *LEVELS, *[f"y{w}" for w in WITHIN])
    return sp.time_split(s, ["admitted", "spell_id"], 0.33) if split else s


_BASE = [("steps", cm.SQL_STEPS), ("stays", cm.SQL_STAYS), ("cc", cm.sql_cc_time(dv.CRITICAL_WARDS_H1, False)),
         ("lab", "select s.spell_id, admitted, " + ", ".join(f"coalesce({x}, 'NA') {c}" for c, x in _SQL_LEVELS.items()) + ", "
          + ", ".join(f"cast(coalesce(died_flag and total_los <= {w}, false) or coalesce(cc.cc_time <= {w}, false) as int) y{w}" for w in WITHIN)
          + " from (select * exclude (specialty), specialty from spells) s join (select spell_id, died_flag, total_los from stays) st using (spell_id) left join cc using (spell_id)")]


def _long(src, extra):
    return " union all ".join(f"select spell_id, {extra}, '{c}' feature, {c} lvl, {', '.join(f'y{w}' for w in WITHIN)} from {src}" for c in LEVELS)


def _value_sql(c):
    w, p, q = c["outcome_within"], f"p{c['outcome_within']}", f"(n0 - p{c['outcome_within']})"
    pos = f"f.pos{w}"
    if c["estimator"] == "rarity":
        return f"1 - (f.n - {pos}) / {q}"
    if c["resampler"] == "balanced":
        return f"{pos} / {p} / ({pos} / {p} + (f.n - {pos}) / {q})"
    return f"{pos} / f.n"


def _sums_sql():
    out = []
    for j, c in enumerate(CELLS):
        names = ", ".join(f"'{x}'" for x in FEATURES[c["features"]])
        out.append(f"select {j} cell, spell_id, any_value(l.y{c['outcome_within']}) y, round(coalesce(sum(case when l.feature in ({names}) then {_value_sql(c)} end), 0) / {len(FEATURES[c['features']])}, 6) score "
                   "from te l left join f using (feature, lvl), tot group by spell_id")
    return " union all ".join(out)


_GRID_CTES = [
    ("sp", """select *, case when row_number() over (order by admitted, spell_id) <= count(*) over () - ceil(0.33 * count(*) over ())
 then 'train' else 'test' end split from lab"""),
    ("lg", _long("sp", "split")), ("te", "select * from lg where split = 'test'"),
    ("f", "select feature, lvl, count(*)::double n, " + ", ".join(f"sum(y{w})::double pos{w}" for w in WITHIN) + " from lg where split = 'train' group by all"),
    ("tot", "select count(*)::double n0, " + ", ".join(f"sum(y{w})::double p{w}" for w in WITHIN) + " from sp where split = 'train'"),
    ("sc", _sums_sql()),
]


def eval_ctes(cell: str) -> list[tuple[str, str]]:
    """CTEs from ``sc`` (cell..., y, score) to ``ev`` with a row of metrics per cell."""
    return [
        ("st", f"select {cell}, score, sum(y)::double pos, sum(1 - y)::double neg from sc group by all"),
        ("cu", f"""select *, sum(pos) over (partition by {cell} order by score desc) tp, sum(neg) over (partition by {cell} order by score desc) fp,
 sum(pos) over (partition by {cell}) p, sum(neg) over (partition by {cell}) n, max(score) over (partition by {cell}) top from st"""),
        ("th", f"""select *, row_number() over (partition by {cell} order by off, thr desc) k from (
 select {cell}, abs(round(fp / nullif(n, 0), 9) - 0.05) off, score thr, tp - pos xtp, fp - neg xfp, p, n from cu
 union all select distinct {cell}, 0.05::double, top + 1, 0, 0, p, n from cu) u"""),
        ("cls", f"""select *, coalesce(xtp / nullif(xtp + xfp, 0), 0) pr, coalesce(xtp / nullif(p, 0), 0) re from th where k = 1"""),
        ("rk", f"""select {cell}, round(sum(neg * (tp - 0.5 * pos)) / nullif(max(p) * max(n), 0), 9) auroc,
 round(sum(case when pos > 0 then pos * tp / (tp + fp) else 0 end) / nullif(max(p), 0), 9) avg_precision from cu group by all"""),
        ("ev", f"""select {cell}, (p + n)::bigint n, p::bigint n_events, auroc, avg_precision, thr threshold, round((xtp + n - xfp) / (p + n), 9) accuracy,
 round(pr, 9) "precision", round(re, 9) recall, round(coalesce(5 * pr * re / nullif(4 * pr + re, 0), 0), 9) f2 from cls join rk using ({cell})"""),
    ]


_GRID_TABLE = "(values " + ", ".join(
    f"({j}, '{c['estimator']}', '{c['resampler']}', '{c['features']}', {c['outcome_within']}::double, {len(FEATURES[c['features']])})"
    for j, c in enumerate(CELLS)) + ") g(cell, estimator, resampler, features, outcome_within, n_features)"
_CI_CTES = [
    ("rep0", f"select *, cell::varchar || '|' || place::varchar || '|' || b::varchar k from (select *, row_number() over (partition by cell order by score desc) place from st) s, range({N_RESAMPLES}) r(b)"),
    ("rep1", f"select cell, b, score, pos, neg, {qm._uniforms("k || '|1'", 'p')}, {qm._uniforms("k || '|0'", 'n')} from rep0"),
    ("rep", f"select cell, b, score, {qm._poisson_sql('pos', 'p')} pos, {qm._poisson_sql('neg', 'n')} neg from rep1"),
    ("bc", """select *, sum(pos) over (partition by cell, b order by score desc) tp, sum(neg) over (partition by cell, b order by score desc) fp from rep where pos + neg > 0"""),
    ("pb", """select cell, b, round(sum(neg * (tp - 0.5 * pos)) / nullif(sum(pos) * sum(neg), 0), 9) auroc,
 round(sum(case when pos > 0 then pos * tp / (tp + fp) else 0 end) / nullif(sum(pos), 0), 9) ap from bc group by all"""),
    ("ci", """select cell, round(quantile_cont(auroc, 0.025), 9) auroc_lower, round(quantile_cont(auroc, 0.975), 9) auroc_upper,
 round(quantile_cont(ap, 0.025), 9) ap_lower, round(quantile_cont(ap, 0.975), 9) ap_upper from pb group by cell"""),
]


@query("experiment_grid", fx.with_views(
    f"""select estimator, resampler, features, outcome_within, n_features, ev.* exclude (cell), ci.* exclude (cell)
 from {_GRID_TABLE} join ev using (cell) join ci using (cell)""", "slots", "spells", extra=_BASE + _GRID_CTES + eval_ctes("cell") + _CI_CTES))
def q_experiment_grid(spark, d):
    s = labelled(spark, d)
    st = gr.level_scores(s.where("split = 'train'"), s.where("split = 'test'"), "spell_id", levels(), {w: f"y{w}" for w in WITHIN}, CELLS, FEATURES)
    got = gr.evaluate_cells(st, ["cell"], 0.05, N_RESAMPLES)
    return gr.cell_table(spark, CELLS, FEATURES).join(got, "cell").drop("cell")


@query("sink_metrics_table", fx.with_views("select * from ev", "scores", extra=[
    ("sc", "select substr(o_orderpriority, 1, 1) cell, label y, score from scores join orders on o_orderkey = spell_id"), *eval_ctes("cell")]))
def q_sink_metrics_table(spark, d):
    """Metrics of each segment, written as a table and read back."""
    o = read_table(spark, d, "orders", ["o_orderkey", "o_orderpriority"])
    s = fx.scores(spark, d).join(o, F.col("spell_id") == F.col("o_orderkey")).withColumn("cell", F.substring("o_orderpriority", 1, 1))
    path = scratch_path(spark, f"metrics-{uuid.uuid4().hex}")
    write_table(gr.evaluate_cells(mt.score_table(s, "label", "score", group=["cell"]), ["cell"], 0.05), path)
    return spark.read.parquet(path)


@query("feature_set_grid", fx.with_views(" union all ".join(
    f"select '{s}' feature_set, {len(cols)} n_features, count(*) n, cast(count_if({' and '.join(f'{c} is not null' for c in cols)}) as bigint) n_complete, "
    f"round(avg({' + '.join(f'cast({c} is null as int)' for c in cols)}) / {len(cols)}, 6) missing_share from spells"
    for s, cols in ps.GRID_SETS.items()), "spells"))
def q_feature_set_grid(spark, d):
    s = fx.spells(spark, d)
    one = s.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"{k}_{n}") for n, cols in ps.GRID_SETS.items() for k, x in {
        "c": F.count_if(F.greatest(*[F.col(c).isNull() for c in cols]) == F.lit(False)) if len(cols) > 1 else F.count_if(F.col(cols[0]).isNotNull()),
        "m": F.avg(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)))}.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature_set"), F.lit(len(cols)).alias("n_features"), F.col("n"), F.col(f"c_{n}").alias("n_complete"),
                                        F.round(F.col(f"m_{n}") / len(cols), 6).alias("missing_share")) for n, cols in ps.GRID_SETS.items()]))
    return one.select(rows.alias("r")).select("r.*")
