"""Composed preparation flows (D27-D30, T1-T3) over the fixture layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from wardlens.functions import codes as cd
from wardlens.functions import families as fam
from wardlens.functions import repair as rp
from wardlens.functions import text as tx
from wardlens.operators import clean as cl
from wardlens.operators import derive as dv
from wardlens.operators import features as ft
from wardlens.operators import lookup as lk
from wardlens.operators import project as pj
from wardlens.plans import presets as ps

NEWS_PARTS = ["temp_score", "hr_score", "o2_score", "resp_score", "bp_score", "air_score", "con_score"]


def from_raw(spells: DataFrame, codes: DataFrame | None = None, names: Mapping[str, str] = ps.RAW_NAMES, n: int = 50) -> DataFrame:
    """Raw stays -> clean cohort, in the reference's order: drop list, placeholders,
    cohort filter, booleans, renames, patient groups, vague texts, top complaints, labs
    of every analyte, trimming, the cleaned (unjustified) code family, then the manual
    observations. Steps act on the columns that ``spells`` has (see ``presets``)."""
    s = pj.drop_tolerant(spells, [*ps.RAW_REDUNDANT, *[c for c in spells.columns if c.endswith(ps.RAW_REDUNDANT_SUFFIX)]])
    s = pj.placeholder_to_null(s, ps.RAW_PLACEHOLDERS)
    s = pj.cohort_filter(s, "los_band", "patient_id", "age", 16)
    s = pj.binarize(s, ps.RAW_TRUE_VALUES).withColumnsRenamed(dict(names))
    if "patient_group" in s.columns:
        s = s.withColumn("patient_group", tx.merge_levels("patient_group", tx.PATIENT_GROUP_MERGE_NEW, lower_after=True))
    s = vague_texts(s, ps.RAW_VAGUE, "complaint", None, n)
    s = s.withColumns({c: pj.lab_repair(c, pj.LAB_DELETE.get(lab, ()), pj.LAB_CONVERT.get(lab))
                       for lab, name in ps.LABS.items() for c in ps.family(s, name)})
    s = pj.trim_all(s)
    s = s.join(codes, "spell_id", "left") if codes is not None else s
    return clean_obs(s)


def vague_texts(df: DataFrame, cols: Sequence[str], top: str, replacement: str | None, n: int) -> DataFrame:
    """Texts of ``cols`` normalised, vague ones replaced, and of column ``top`` all but
    the ``n`` most frequent replaced."""
    out = df.withColumns({c: tx.vague_to(tx.normalise(c), replacement) for c in cols if c in df.columns})
    return cl.topn_keep(out, top, n, sentinel=replacement) if top in out.columns else out


def clean_obs(df: DataFrame, n: int = 16) -> DataFrame:
    """Manual observations at every snapshot: respiration, device, saturation (outliers
    by mean - 3 std over the snapshots together), temperature, blood pressure, heart
    rate, nausea and vomiting."""
    f = {k: ps.family(df, k) for k in ["resp_rate", "device", "o2_sat", "temperature", "dbp", "sbp", "heart_rate", "nausea", "vomiting"]}
    sat = lambda c: rp.shift_single(rp.invert_negatives(c))
    dia = {c: rp.clip_sentinel(c, 20, 200) for c in f["dbp"]}
    s = df.withColumns({
        **{c: rp.clip_sentinel(rp.shift_triple(rp.invert_negatives(c)), 5, 80) for c in f["resp_rate"]},
        **{c: tx.device_text(c) for c in f["device"]},
        **{c: F.when((sat(c) > 0) & (sat(c) <= 100), sat(c)) for c in f["o2_sat"]},
        **{c: rp.clip_sentinel(rp.invert_negatives(c), 25, 45) for c in f["temperature"]},
        **dia,
        **{c: rp.mask_against(rp.clip_sentinel(c, 40, 300), dia["dbp" + c[3:]], 5) if "dbp" + c[3:] in dia
           else rp.clip_sentinel(c, 40, 300) for c in f["sbp"]},
        **{c: rp.clip_sentinel(rp.invert_negatives(c), 25, 300) for c in f["heart_rate"]},
        **{c: F.coalesce(F.col(c) == "1 - Nausea present", F.lit(False)) for c in f["nausea"]},
        **{c: F.coalesce(F.col(c) == "1 - Vomiting since last round", F.lit(False)) for c in f["vomiting"]},
    })
    bound = cl.fit_sigma_bound(s, f["o2_sat"], 3.0) if f["o2_sat"] else None
    if bound is not None:
        s = s.withColumns({c: F.when(F.col(c) > F.lit(bound), F.col(c)) for c in f["o2_sat"]})
    for c in f["device"]:
        s = cl.topn_keep(s, c, n)
    return s


def clean_all(obs: DataFrame, patient: str = "patient_id", ts: str = "taken", key: str = "obs_id") -> DataFrame:
    """Old-layout repair chain, in the reference's order: blood pressure,
    consciousness, assisted air, heart rate, device, oxygen flow, saturation,
    respiration, temperature, emergency texts and patient groups, early-warning total;
    then vague diagnoses, readmission by patient, same-day care, and no venous gases.
    Steps act on the columns that ``obs`` has (see ``presets``)."""
    diagnoses = [c for c in ps.DIAGNOSES if c in obs.columns]
    o = cl.repair_bp(obs, "sbp", "dbp", "bp_score")
    o = cl.repair_consciousness(o, "alert", "con_score")
    o = cl.repair_device_air(o, "assisted", "air_score")
    o = cl.repair_hr(o, "heart_rate", "hr_score")
    o = cl.repair_device(o, "device", "assisted", 16)
    o = o.withColumn("o2_flow", rp.flow_to_fraction("o2_flow", "device"))
    # the saturation bound depends on the raw reading only: fitted on the input
    bound = cl.fit_sigma_bound(obs.select(cl.o2_prepared("o2_sat").alias("s")), ["s"], 3.0)
    o = cl.repair_o2(o, "o2_sat", "o2_score", "assisted", "device", diagnoses, ["op1"], bound)
    o = cl.repair_resp(o, "resp_rate", "resp_score")
    o = cl.repair_temp(o, "temperature", "temp_score")
    o = vague_texts(o, ps.RAW_VAGUE, "complaint", "other", 50)
    if "patient_group" in o.columns:
        o = o.withColumn("patient_group", tx.merge_levels("patient_group", tx.PATIENT_GROUP_MERGE_OLD, lower_before=True))
    o = cl.recompute_total(o, NEWS_PARTS, "news_score")
    if diagnoses:
        kept = F.transform(F.array(*diagnoses), lambda x: F.when(~cd.is_vague(x), x))
        o = o.withColumn("_diagnoses", fam.justify(kept, "left"))
        o = o.withColumns({c: F.get("_diagnoses", F.lit(i)) for i, c in enumerate(diagnoses)}).drop("_diagnoses")
    o = dv.readmission_spans(o, patient, ts, key)
    o = o.withColumn("readmission", dv.readmission(F.col("prev_gap_s"), 30)).drop("prev_gap_s", "next_gap_s")
    if "admit_ward" in o.columns:
        o = o.withColumn("sent_to_sdec", dv.sdec(F.col("admit_ward")))
    return pj.drop_tolerant(o, ps.VBG)


def augment(stays: DataFrame, charlson: DataFrame, within: float = 1,
            wards: Sequence[str] = dv.CRITICAL_WARDS, ignore_admit_ward: bool = True) -> DataFrame:
    """Outcome columns in one projection, readmission by one window, Charlson by
    one keyed join. Defaults: events within a day, on the CCU ward, not counting the
    admission ward."""
    p, died, los = F.col("path"), F.col("died_flag"), F.col("total_los")
    s = stays.withColumns({
        "mortality": dv.mortality(died, los, within),
        "critical_care": dv.critical_care(p, wards, within, ignore_admit_ward),
        "critical_event": dv.critical_event(died, los, p, within, wards, ignore_admit_ward),
        "sent_to_sdec": dv.sdec(F.col("admit_ward")),
    })
    s = dv.readmission_spans(s, "patient_id", "admitted", "spell_id")
    s = s.withColumn("readmission", dv.readmission(F.col("prev_gap_s"), 30))
    return s.join(charlson, "spell_id", "left")


def from_params(df: DataFrame, params: Mapping) -> DataFrame:
    """Configuration-driven preparation: a fold of named operators. ``omit``: groups
    dropped; ``keep``: groups that rows must have in full; ``raw``: readings or scores
    only; ``grouping``: look-up (key, value) that replaces the diagnosis columns' codes,
    with ``grouping_onehot`` one flag per group (named by ``grouping_name``); then rows
    lacking a diagnosis go, and categories are encoded."""
    out = df
    for g in params.get("omit", []):
        out = ps.omit(out, g)
    for g in params.get("keep", []):
        out = pj.mandate(out, ps.SPELL_GROUPS[g])
    if params.get("raw") is True:
        out = ps.raw_only(out)
    elif params.get("raw") is False:
        out = ps.scored_only(out)
    diagnoses = [c for c in ps.DIAGNOSES if c in out.columns]
    if params.get("grouping") is not None:
        table, key, value = params["grouping"]
        for c in diagnoses:
            out = lk.cascade_join(out, c, table, key, value, "_group").withColumn(c, F.col("_group")).drop("_group")
        if params.get("grouping_onehot"):
            # the look-up's groups and the sentinel: levels without a pass over the rows
            found = [r[0] for r in table.select(value).where(F.col(value).isNotNull()).distinct().collect()]
            name, codes = params.get("grouping_name", "CCS"), F.array(*diagnoses)
            out = out.withColumns({f"{name}__{x}": F.coalesce(F.array_contains(F.filter(codes, lambda y: y.isNotNull()), x), F.lit(False)).cast("int")
                                   for x in sorted({*found, lk.CCS_SENTINEL})}).drop(*diagnoses)
    out = pj.mandate(out, diagnoses)
    if params.get("onehot"):
        out = ft.onehot(out, list(params["onehot"]), levels=params.get("levels"))
    if params.get("fillna"):
        out = ft.fill_na(out)
    return out


def bools_as_text(df: DataFrame) -> DataFrame:
    """Booleans print as True/False in text rows."""
    return df.withColumns({f.name: F.when(F.col(f.name), "True").when(~F.col(f.name), "False")
                           for f in df.schema.fields if isinstance(f.dataType, BooleanType)})


def to_text(df: DataFrame, key: str, columns: Sequence[str], target: str, with_names: bool = False,
            patient: str | None = "patient_id") -> DataFrame:
    """(key, text, label): chosen columns joined by ' [SEP] '; the label and the
    patient id never enter the text."""
    cols = [c for c in columns if c not in (target, patient)]
    src = bools_as_text(df.select(key, *cols, F.col(target).cast("int").alias("_label")))
    return src.select(key, tx.row_text(cols, with_names).alias("text"), F.col("_label").alias("label"))
