"""String functions: normalisation, vague terms, stems, level merges, row text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A&E diagnosis stems (first match in text order wins, then list
# order), in the order the new admission layout lists them ("weak" appears twice).
AE_DIAGNOSIS_STEMS = [
    "confus", "weak", "found", "fof", "dementia", "discharged", "sob", "unwitnessed",
    "gcs", "diarrh", "vomit", "collaps", "sudden", "woke", "dizz", "tight", "head",
    "fall", "fell", "pain", "bang", "mobility", "cope", "coping", "weak", "deterio",
    "pneumon",
]

# Complaint / diagnosis texts that carry no information.
VAGUE_TERMS = [
    "referral to service (procedure)", "generally unwell (finding)", "unwell adult",
    "unknown", "other", "general deterioration", "generally unwell", "gen unwell",
]

# A&E patient-group merges (new layout, applied before lower-casing).
PATIENT_GROUP_MERGE_NEW = {
    "FALLS": "TRAUMA", "ACCIDENT": "TRAUMA", "SELF HARM": "TRAUMA",
    "ROAD TRAFFIC ACCIDENT": "TRAUMA", "ASSAULT": "TRAUMA", "SPORTS INJURY": "TRAUMA",
    "KNIFE INJURIES INFLICTED": "TRAUMA", "FIREWORK INJURY": "TRAUMA",
}
# A&E patient-group merges (old layout, applied after lower-casing).
PATIENT_GROUP_MERGE_OLD = {
    "other than above": "other", "falls": "trauma", "road traffic accident": "trauma",
    "sports injury": "trauma", "knife injuries inflicted": "trauma", "assault": "trauma",
    "self harm": "trauma", "accident": "trauma", "eyes": "other", "dental": "other",
    "s/guarding issue/vunerable per": "other", "rheumatology": "other",
}

STRIP_CHARS = " .?+"
WHITESPACE = " \t\n\r\x0b\x0c"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def normalise(c, strip: str = STRIP_CHARS, case: str = "lower") -> Column:
    """Lower (or upper) case, then strip the characters of ``strip`` from both ends."""
    x = _c(c)
    x = F.lower(x) if case == "lower" else F.upper(x) if case == "upper" else x
    return F.btrim(x, F.lit(strip)) if strip else x


def strip_ws(c) -> Column:
    """Trim ASCII whitespace on both ends (what str.strip() removes for ASCII)."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def vague_to(c, replacement: str | None = None, terms: Sequence[str] = VAGUE_TERMS) -> Column:
    """Vague values become null (new layout) or ``replacement`` (old: "other")."""
    x = _c(c)
    return F.when(x.isin(list(terms)), F.lit(replacement)).otherwise(x)


def stem_pattern(stems: Sequence[str]) -> str:
    return "(" + "|".join(re.escape(s) for s in stems) + ")"


def first_stem(c, stems: Sequence[str] = AE_DIAGNOSIS_STEMS) -> Column:
    """Leftmost stem found in the lower-cased text (list order breaks ties at the
    same position); null when none. Only the first stem is reported."""
    return F.nullif(F.regexp_extract(F.lower(_c(c)), stem_pattern(stems), 1), F.lit(""))


def merge_levels(c, mapping: Mapping[str, str], lower_after: bool = False, lower_before: bool = False) -> Column:
    """Replace values by a merge map (unlisted values kept); optionally lower-case
    before the look-up (old layout) or after it (new layout)."""
    x = _c(c)
    if lower_before:
        x = F.lower(x)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    out = F.coalesce(F.try_element_at(m, x), x)
    return F.lower(out) if lower_after else out


def device_text(c) -> Column:
    """Device free text: upper-case, drop "OTHER;", trim, keep the part before ';'."""
    x = F.btrim(F.replace(F.upper(_c(c)), F.lit("OTHER;"), F.lit("")), F.lit(WHITESPACE))
    return F.split_part(x, F.lit(";"), F.lit(1))


def row_text(cols: Sequence[str], with_names: bool = False, sep: str = " [SEP] ",
             null_text: str = "nan") -> Column:
    """One text per row: each value (missing -> ``null_text``), optionally prefixed
    with ``name: ``, followed by ``sep``."""
    parts = []
    for c in cols:
        if with_names:
            parts.append(F.lit(f"{c}: "))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit(null_text)))
        parts.append(F.lit(sep))
    return F.concat(*parts)
