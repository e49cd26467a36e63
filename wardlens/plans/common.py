"""Shared inputs for the catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions import families as fam
from wardlens.operators import derive as dv
from wardlens.plans import fixtures as fx


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spell_id, path) with path = sorted array<struct<slot, ward, los, code>>."""
    return fam.pack_long(fx.slots(spark, sf_dir), "spell_id", "slot", ["ward", "los", "code"], "path")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture stays with their packed path, stay length, admission ward and a
    boolean death flag. Stays without any step keep a null path."""
    s = fx.spells(spark, sf_dir, segment=False).drop("specialty").join(paths(spark, sf_dir), "spell_id", "left")
    return s.withColumns({
        "died_flag": F.coalesce(F.col("died").isin("Yes"), F.lit(False)),
        "total_los": dv.total_los(F.col("path")),
        "admit_ward": dv.admit_ward(F.col("path")),
    })


# SQL twins -------------------------------------------------------------------

# long-form path with elapsed time before each step and step rank
SQL_STEPS = """select spell_id, slot, ward, los, code,
 round(coalesce(sum(los) over (partition by spell_id order by slot rows between unbounded preceding and 1 preceding), 0), 6) elapsed,
 row_number() over (partition by spell_id order by slot) rn from slots"""

SQL_STAYS = """select s.*, coalesce(s.died = 'Yes', false) died_flag, t.total_los, a.ward admit_ward
 from spells s
 left join (select spell_id, round(sum(los), 6) total_los from slots group by spell_id) t using (spell_id)
 left join (select spell_id, ward from steps where rn = 1) a using (spell_id)"""


def sql_cc_time(wards: list[str], ignore_admit: bool, name: str = "cc") -> str:
    """(spell_id, cc_time) for stays whose path reaches one of ``wards``."""
    ws = ", ".join(f"'{w}'" for w in wards)
    skip = " and rn > 1" if ignore_admit else ""
    return f"""select spell_id, arg_min(elapsed, slot) cc_time from steps
 where ward in ({ws}){skip} group by spell_id"""
