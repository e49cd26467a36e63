"""Column presets: named groups, orders, display names and drop lists.

The core operators take column names as parameters; these presets wire them to
the fixture stay table (and document the reference's own layouts' groups).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardlens.operators.project import drop_tolerant

SPELL_GROUPS = {
    "ids": ["spell_id", "patient_id"],
    "demographics": ["age", "gender"],
    "admission": ["admitted", "admit_method", "specialty", "los_band"],
    "outcome": ["died"],
    "labs": ["urea_first", "urea_last"],
    "obs": ["resp_rate", "resp_score", "sbp", "dbp"],
}
#: Named groups that experiments combine.
FEATURE_GROUPS = {"demographics": ["age", "gender"], "obs": ["resp_rate", "sbp", "dbp"], "obs_scores": ["resp_score"],
                  "labs": ["urea_first", "urea_last"], "admission": ["admit_method", "specialty"]}
#: Unions of groups by name.
FEATURE_COMBINATIONS = {
    "obs_with_demographics": ["obs", "demographics"], "scores_with_demographics": ["obs_scores", "demographics"],
    "with_labs": ["obs", "demographics", "labs"], "scores_with_labs": ["obs_scores", "demographics", "labs"],
    "with_admission": ["obs", "demographics", "admission"], "scores_with_admission": ["obs_scores", "demographics", "admission"],
    "with_labs_and_admission": ["obs", "demographics", "labs", "admission"],
    "scores_with_labs_and_admission": ["obs_scores", "demographics", "labs", "admission"],
}


def feature_sets(groups=FEATURE_GROUPS, combinations=FEATURE_COMBINATIONS) -> dict[str, list[str]]:
    """Columns of every group and of every union of groups, in order and without repeats."""
    return {**{n: list(c) for n, c in groups.items()},
            **{n: list(dict.fromkeys(c for g in gs for c in groups[g])) for n, gs in combinations.items()}}


GRID_CATEGORICAL = ["gender", "admit_method", "specialty"]
GRID_SETS = {**feature_sets(), "all": ["age", "gender", "resp_rate", "sbp", "dbp", "admit_method", "specialty"]}
SPELL_RAW = ["resp_rate", "sbp", "dbp"]
SPELL_SCORED = ["resp_score"]
SPELL_REDUNDANT = ["patient_id", "admitted", "los_band"]
# Layout of the raw-to-clean and old-layout flows. Steps act on the columns that a table
# has, so a table without, say, complaints passes their steps unchanged.
SNAPSHOTS = ["first", "24h_post_adm", "24h_pre_disch", "last"]
RAW_REDUNDANT = ["patient_type", "ccg", "admission_consultant", "over_7_days", "over_14_days", "gp_practice",
                 "spell_count", "admit_ward_end"]
RAW_REDUNDANT_SUFFIX = "_recorded_dtm"  # collection times of scores and time series
RAW_PLACEHOLDERS = {"gender": "Other", "ethnicity": "NOT STATED", "ae_diagnosis": "UNKNOWN", "ae_location": "System Generated"}
RAW_TRUE_VALUES = {"gender": ["Female"], "died": ["Yes"], "died_within_30": ["Yes"], "admission_type": ["Elective"],
                   "care_home": ["Yes"], "resus_status": ["DNA - CPR", "Unified DNA - CPR"]}
RAW_NAMES = {"gender": "female", "admission_type": "elective_admission", "resus_status": "has_dnar"}
RAW_VAGUE = ["complaint", "ae_diagnosis"]
LABS = {"Blood_Urea": "urea", "Blood_Sodium": "sodium", "Blood_Potassium": "potassium", "Blood_Creatinine": "creatinine",
        "Blood_DDimer": "ddimer", "Blood_Albumin": "albumin", "Blood_CRP": "crp", "VBG_O2": "vbg_o2"}
DIAGNOSES = [f"diag{i}" for i in range(1, 8)]
VBG = ["vbg_temperature", "vbg_pco2", "vbg_pco2_corrected", "vbg_ph", "vbg_ph_corrected", "vbg_o2", "vbg_o2_corrected"]
SPELL_ORDER = ["spell_id", "admitted", "patient_id", "age", "gender", "died", "admit_method", "specialty"]
SPELL_DISPLAY_NAMES = {"spell_id": "SpellSerial", "patient_id": "PatientNumber", "admitted": "AdmissionDate",
                       "age": "Age", "gender": "Gender"}
# Fixed values of the fixture: ordered priority levels and segment levels.
PRIORITY_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENT_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


def family(df: DataFrame, name: str) -> list[str]:
    """The table's columns of a measurement: ``name`` itself and ``name`` at a snapshot."""
    return [c for c in [name, *[f"{name}_{s}" for s in SNAPSHOTS]] if c in df.columns]


def omit(df: DataFrame, group: str) -> DataFrame:
    return drop_tolerant(df, SPELL_GROUPS[group])


def raw_only(df: DataFrame) -> DataFrame:
    """Keep raw readings, drop their scores."""
    return drop_tolerant(df, SPELL_SCORED)


def scored_only(df: DataFrame) -> DataFrame:
    """Keep scores, drop raw readings."""
    return drop_tolerant(df, SPELL_RAW)
