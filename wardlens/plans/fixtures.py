"""Fixture views that give the driver tables the shape of an admission table.

The admission data the operators were designed for is not public, so the views
below derive a stay table (``spells``), a ward path (``slots``), code look-ups and
model scores from the TPC-H-like driver tables. Each view exists twice: as a
Spark DataFrame (what the queries run) and as SQL text (what the DuckDB oracle
runs). The two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.sources import read_table

# Fixed values of the fixture: ward names by supplier key mod 7, code suffixes by
# part key mod 6, look-up suffixes.
FIXTURE_WARDS = ["CCU", "HH1M", "AEC", "AAA", "EAU", "W5", "W6"]
FIXTURE_CODE_SUFFIXES = ["", ".1", ".X", ".12D", ".1 D", ".99"]
REF_CODE_SUFFIXES = ["", ".1", ".12", ".99"]
REF_CCS_VARIANTS = [("", 3, 1), ("1", 5, 3), ("12", 7, 7)]  # (suffix, n modulus, i factor)


def _pick(index: F.Column, values: list[str]) -> F.Column:
    """values[index] for index 0..len-1, the last value otherwise (CASE ... ELSE)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.coalesce(F.try_element_at(arr, (index + 1).cast("int")), F.lit(values[-1]))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (stay, path step). Line items of an order sharing a line number
    are merged first; the aggregate is partial (map-side), so even an order holding
    a large share of all line items ships one row per step, not its raw rows."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    g = li.groupBy(F.col("l_orderkey").alias("spell_id"), F.col("l_linenumber").alias("slot")).agg(
        F.max("l_partkey").alias("_pk"), F.max("l_suppkey").alias("_sk"), F.sum("l_quantity").alias("_qty"))
    pk, sk = F.col("_pk"), F.col("_sk")
    ward = F.when(pk % 13 == 0, F.lit(None)).otherwise(_pick(sk % 7, FIXTURE_WARDS))
    los = F.when(pk % 17 == 0, F.lit(None)).otherwise(F.col("_qty") / 10)
    code = F.concat(F.char(F.lit(65) + pk % 26), F.lpad((pk % 100).cast("string"), 2, "0"),
                    _pick(pk % 6, FIXTURE_CODE_SUFFIXES))
    return g.select("spell_id", "slot", ward.alias("ward"), los.alias("los"), code.alias("code"))


def spells(spark: SparkSession, sf_dir: str, segment: bool = True) -> DataFrame:
    """One row per stay (order), with nulls, placeholders, censored lab strings and
    sign/scale errors planted by key arithmetic.

    ``specialty`` comes from a left join to customer on its unique key. Callers
    that do not need it pass ``segment=False``: the join cannot change the row
    set, and at scale it would be a large shuffle join."""
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    k = F.col("o_orderkey")
    ck = F.col("o_custkey")
    nul = F.lit(None)
    if segment:
        c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
        j = o.join(c, o.o_custkey == c.c_custkey, "left")
    else:
        j = o.withColumn("c_mktsegment", F.lit(None).cast("string"))
    return j.select(
        k.alias("spell_id"),
        F.when(k % 97 == 0, nul).otherwise(ck).alias("patient_id"),
        F.col("o_orderdate").alias("admitted"),
        F.when(k % 89 == 0, nul).otherwise((ck % 90 + 10).cast("int")).alias("age"),
        F.when(ck % 50 == 0, "Other").when(ck % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(k % 11 == 0, "Yes").when(k % 11 == 1, nul).otherwise("No").alias("died"),
        F.when(k % 40 == 0, "Still In").when(k % 41 == 0, nul).otherwise("In Band").alias("los_band"),
        F.col("o_orderpriority").alias("admit_method"),
        F.col("c_mktsegment").alias("specialty"),
        F.when(k % 20 == 0, "<1.8").when(k % 33 == 0, ">107.0").when(k % 19 == 0, nul)
         .otherwise((k % 30).cast("string")).alias("urea_first"),
        F.when(k % 23 == 0, nul).otherwise((k % 27).cast("string")).alias("urea_last"),
        F.when(k % 29 == 0, nul).when(k % 50 == 0, (-(k % 40)).cast("double"))
         .when(k % 51 == 0, (10 * (k % 40)).cast("double"))
         .otherwise((k % 40).cast("double")).alias("resp_rate"),
        F.when(k % 31 == 0, nul).otherwise((k % 4).cast("double")).alias("resp_score"),
        F.when(k % 37 == 0, nul).otherwise((k % 320).cast("double")).alias("sbp"),
        F.when(k % 43 == 0, nul).otherwise((k % 220).cast("double")).alias("dbp"),
    )


def ref_codes(spark: SparkSession) -> DataFrame:
    """Reference code list (7,800 rows whatever the scale: safe to broadcast)."""
    r = spark.range(2600).select((F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).alias("n"))
    r = r.where((F.col("i") * 100 + F.col("n")) % 4 != 0)
    r = r.select("*", F.explode(F.array(*[F.lit(s) for s in REF_CODE_SUFFIXES])).alias("sfx"))
    letter = F.char(F.lit(65) + F.col("i"))
    return r.select(
        F.concat(letter, F.lpad(F.col("n").cast("string"), 2, "0"), F.col("sfx")).alias("code"),
        F.concat(F.lit("desc "), letter, F.col("n").cast("string")).alias("descr"))


def ref_ccs(spark: SparkSession) -> DataFrame:
    """Undotted code -> group (1,794 rows, constant size)."""
    r = spark.range(2600).select((F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).alias("n"))
    v = F.array(*[F.struct(F.lit(s).alias("sfx"), F.lit(m).alias("m"), F.lit(k).alias("k"))
                  for s, m, k in REF_CCS_VARIANTS])
    r = r.select("i", "n", F.explode(v).alias("v")).where(F.col("n") % F.col("v.m") == 0)
    return r.select(
        F.concat(F.char(F.lit(65) + F.col("i")), F.lpad(F.col("n").cast("string"), 2, "0"),
                 F.col("v.sfx")).alias("code"),
        ((F.col("i") * F.col("v.k") + F.col("n")) % 258 + 1).alias("grp"))


def ref_hsmr(spark: SparkSession) -> DataFrame:
    """Group -> aggregate group, groups 1..249 (250..259 stay unmatched)."""
    return spark.range(1, 250).select(F.col("id").alias("grp"), (F.col("id") % 56 + 1).alias("agg_grp"))


def ref_shmi(spark: SparkSession) -> DataFrame:
    """Group -> SHMI group and its description, groups 1..255."""
    shmi = (F.col("id") * 7 % 142 + 1).alias("shmi_grp")
    return spark.range(1, 256).select(F.col("id").alias("grp"), shmi, F.concat(F.lit("shmi "), shmi.cast("string")).alias("shmi_desc"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary label and a rounded, heavily tied score per order."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return o.select(F.col("o_orderkey").alias("spell_id"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
                    F.round(F.col("o_totalprice") / 1000).alias("score"))


# ---------------------------------------------------------------------------
# The same views in SQL, for the DuckDB oracle.
# ---------------------------------------------------------------------------

SQL = {
    "slots": """select l_orderkey spell_id, l_linenumber slot,
 case when max(l_partkey) % 13 = 0 then null else case max(l_suppkey) % 7 when 0 then 'CCU' when 1 then 'HH1M' when 2 then 'AEC' when 3 then 'AAA' when 4 then 'EAU' when 5 then 'W5' else 'W6' end end ward,
 case when max(l_partkey) % 17 = 0 then null else sum(l_quantity) / 10 end los,
 concat(chr(cast(65 + max(l_partkey) % 26 as int)), lpad(cast(max(l_partkey) % 100 as varchar), 2, '0'),
  case max(l_partkey) % 6 when 0 then '' when 1 then '.1' when 2 then '.X' when 3 then '.12D' when 4 then '.1 D' else '.99' end) code
 from lineitem group by l_orderkey, l_linenumber""",
    "spells": """select o.o_orderkey spell_id, case when o_orderkey % 97 = 0 then null else o_custkey end patient_id, o_orderdate admitted,
 case when o_orderkey % 89 = 0 then null else cast(o_custkey % 90 + 10 as int) end age,
 case when o_custkey % 50 = 0 then 'Other' when o_custkey % 2 = 0 then 'Female' else 'Male' end gender,
 case o_orderkey % 11 when 0 then 'Yes' when 1 then null else 'No' end died,
 case when o_orderkey % 40 = 0 then 'Still In' when o_orderkey % 41 = 0 then null else 'In Band' end los_band,
 o_orderpriority admit_method, c_mktsegment specialty,
 case when o_orderkey % 20 = 0 then '<1.8' when o_orderkey % 33 = 0 then '>107.0' when o_orderkey % 19 = 0 then null else cast(o_orderkey % 30 as varchar) end urea_first,
 case when o_orderkey % 23 = 0 then null else cast(o_orderkey % 27 as varchar) end urea_last,
 case when o_orderkey % 29 = 0 then null when o_orderkey % 50 = 0 then cast(-(o_orderkey % 40) as double) when o_orderkey % 51 = 0 then cast(10 * (o_orderkey % 40) as double) else cast(o_orderkey % 40 as double) end resp_rate,
 case when o_orderkey % 31 = 0 then null else cast(o_orderkey % 4 as double) end resp_score,
 case when o_orderkey % 37 = 0 then null else cast(o_orderkey % 320 as double) end sbp,
 case when o_orderkey % 43 = 0 then null else cast(o_orderkey % 220 as double) end dbp
 from orders o left join customer on c_custkey = o_custkey""",
    "ref_codes": """select concat(chr(cast(65 + i as int)), lpad(cast(n as varchar), 2, '0'), sfx) code, concat('desc ', chr(cast(65 + i as int)), cast(n as varchar)) descr
 from range(26) t(i) cross join range(100) u(n) cross join (values (''), ('.1'), ('.12'), ('.99')) v(sfx) where (i * 100 + n) % 4 <> 0""",
    "ref_ccs": """select concat(chr(cast(65 + i as int)), lpad(cast(n as varchar), 2, '0'), sfx) code, (i * k + n) % 258 + 1 grp
 from range(26) t(i) cross join range(100) u(n) cross join (values ('', 3, 1), ('1', 5, 3), ('12', 7, 7)) v(sfx, m, k) where n % m = 0""",
    "ref_hsmr": """select id grp, id % 56 + 1 agg_grp from range(1, 250) t(id)""",
    "ref_shmi": """select id grp, id * 7 % 142 + 1 shmi_grp, 'shmi ' || (id * 7 % 142 + 1)::varchar shmi_desc from range(1, 256) t(id)""",
    "scores": """select o_orderkey spell_id, case when o_orderstatus = 'F' then 1 else 0 end label, round(o_totalprice / 1000) score from orders""",
}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named fixture views (and extra CTEs).

    ``body`` may itself start with ``with``; its CTEs are appended after ours."""
    ctes = [f"{n} as ({SQL[n]})" for n in names] + [f"{n} as ({s})" for n, s in (extra or [])]
    b = body.strip()
    if not ctes:
        return b
    if b[:5].lower() == "with ":
        return "with " + ",\n".join(ctes) + ",\n" + b[5:]
    return "with " + ",\n".join(ctes) + "\n" + b


# ---------------------------------------------------------------------------
# Measurement and free-text views (this repo's additions to the fixture set).
# ---------------------------------------------------------------------------

OBS_DEVICES = ["A - Air", "N - Nasal cannula", "Other; NHF 40L", "V - Venturi 28%", "NIV - NIV",
               "SM - Simple mask"]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation round per event: vital signs, their early-warning scores,
    flags, device text, oxygen flow and two code columns, with planted sign,
    scale, zero and impossible-score errors."""
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "value"])
    k, v = F.col("event_id"), F.col("value")
    base = F.floor(v)  # bigint
    nul = F.lit(None)
    dbl = lambda x: x.cast("double")
    o2 = base % 101
    device = (F.when(k % 9 == 0, nul)
              .when(k % 9 == 1, OBS_DEVICES[0]).when(k % 9 == 2, OBS_DEVICES[1])
              .when(k % 9 == 3, OBS_DEVICES[2]).when(k % 9 == 4, OBS_DEVICES[3])
              .when(k % 9 == 5, OBS_DEVICES[4]).when(k % 9 == 6, OBS_DEVICES[5])
              .otherwise(F.concat(F.lit("D"), (F.col("user_id") % 30).cast("string"))))
    return e.select(
        k.alias("obs_id"), F.col("user_id").alias("patient_id"), F.col("ts").alias("taken"),
        F.when(k % 41 == 0, nul).when(k % 47 == 0, -(v / 10)).otherwise(v / 10).alias("temperature"),
        F.when(k % 43 == 0, nul).otherwise(dbl(k % 4)).alias("temp_score"),
        F.when(k % 37 == 0, nul).when(k % 53 == 0, -v).otherwise(v).alias("heart_rate"),
        F.when(k % 31 == 0, nul).otherwise(dbl(k % 4)).alias("hr_score"),
        F.when(k % 29 == 0, nul).when(k % 59 == 0, dbl(-o2)).when(k % 61 == 0, dbl(o2) / 10)
         .otherwise(dbl(o2)).alias("o2_sat"),
        F.when(k % 23 == 0, nul).otherwise(dbl(k % 4)).alias("o2_score"),
        F.when(k % 19 == 0, nul).otherwise(k % 3 == 0).alias("assisted"),
        F.when(k % 17 == 0, nul).otherwise(dbl(k % 3)).alias("air_score"),
        F.when(k % 13 == 0, nul).otherwise(k % 5 != 0).alias("alert"),
        F.when(k % 11 == 0, nul).otherwise(dbl(k % 5)).alias("con_score"),
        device.alias("device"),
        F.when(k % 7 == 0, nul).otherwise(dbl(base) / 5).alias("o2_flow"),
        F.when(k % 27 == 0, nul).when(k % 50 == 0, dbl(-(base % 60)))
         .when(k % 51 == 0, dbl((base % 60) * 10)).otherwise(dbl(base % 60)).alias("resp_rate"),
        F.when(k % 25 == 0, nul).otherwise(dbl(k % 4)).alias("resp_score"),
        F.when(k % 21 == 0, nul).when(k % 67 == 0, dbl(-(base % 320))).otherwise(dbl(base % 320)).alias("sbp"),
        F.when(k % 22 == 0, nul).otherwise(dbl(F.floor(v * 7) % 220)).alias("dbp"),
        F.when(k % 26 == 0, nul).otherwise(dbl(k % 4)).alias("bp_score"),
        F.when(k % 14 == 0, nul).otherwise(dbl(k % 15)).alias("news_score"),
        F.when(F.col("user_id") % 7 == 0, "J44.1").when(F.col("user_id") % 11 == 0, "J44.X")
         .otherwise("A01").alias("diag1"),
        F.when(k % 10 == 0, "E85.2").alias("op1"),
    )


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text complaint and patient group per part, with vague values,
    stray punctuation and case noise."""
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    k = F.col("p_partkey")
    nul = F.lit(None)
    complaint = (F.when(k % 37 == 0, " Unknown.").when(k % 41 == 0, "Other?").when(k % 43 == 0, nul)
                 .otherwise(F.concat(F.when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")),
                                     F.when(k % 3 == 0, " ").when(k % 3 == 1, ".").otherwise(""))))
    group = (F.when(k % 8 == 0, "FALLS").when(k % 8 == 1, "ASSAULT").when(k % 8 == 2, "Other than above")
             .when(k % 8 == 3, "Eyes").when(k % 8 == 4, nul).when(k % 8 == 5, "SELF HARM")
             .otherwise(F.upper("p_brand")))
    return p.select(k.alias("item_id"), complaint.alias("complaint"), group.alias("patient_group"))


SQL["obs"] = """select event_id obs_id, user_id patient_id, ts taken,
 case when event_id % 41 = 0 then null when event_id % 47 = 0 then -(value / 10) else value / 10 end temperature,
 case when event_id % 43 = 0 then null else cast(event_id % 4 as double) end temp_score,
 case when event_id % 37 = 0 then null when event_id % 53 = 0 then -value else value end heart_rate,
 case when event_id % 31 = 0 then null else cast(event_id % 4 as double) end hr_score,
 case when event_id % 29 = 0 then null when event_id % 59 = 0 then cast(-(cast(floor(value) as bigint) % 101) as double)
      when event_id % 61 = 0 then cast(cast(floor(value) as bigint) % 101 as double) / 10
      else cast(cast(floor(value) as bigint) % 101 as double) end o2_sat,
 case when event_id % 23 = 0 then null else cast(event_id % 4 as double) end o2_score,
 case when event_id % 19 = 0 then null else event_id % 3 = 0 end assisted,
 case when event_id % 17 = 0 then null else cast(event_id % 3 as double) end air_score,
 case when event_id % 13 = 0 then null else event_id % 5 <> 0 end alert,
 case when event_id % 11 = 0 then null else cast(event_id % 5 as double) end con_score,
 case when event_id % 9 = 0 then null when event_id % 9 = 1 then 'A - Air' when event_id % 9 = 2 then 'N - Nasal cannula'
      when event_id % 9 = 3 then 'Other; NHF 40L' when event_id % 9 = 4 then 'V - Venturi 28%' when event_id % 9 = 5 then 'NIV - NIV'
      when event_id % 9 = 6 then 'SM - Simple mask' else concat('D', cast(user_id % 30 as varchar)) end device,
 case when event_id % 7 = 0 then null else cast(cast(floor(value) as bigint) as double) / 5 end o2_flow,
 case when event_id % 27 = 0 then null when event_id % 50 = 0 then cast(-(cast(floor(value) as bigint) % 60) as double)
      when event_id % 51 = 0 then cast((cast(floor(value) as bigint) % 60) * 10 as double)
      else cast(cast(floor(value) as bigint) % 60 as double) end resp_rate,
 case when event_id % 25 = 0 then null else cast(event_id % 4 as double) end resp_score,
 case when event_id % 21 = 0 then null when event_id % 67 = 0 then cast(-(cast(floor(value) as bigint) % 320) as double)
      else cast(cast(floor(value) as bigint) % 320 as double) end sbp,
 case when event_id % 22 = 0 then null else cast(cast(floor(value * 7) as bigint) % 220 as double) end dbp,
 case when event_id % 26 = 0 then null else cast(event_id % 4 as double) end bp_score,
 case when event_id % 14 = 0 then null else cast(event_id % 15 as double) end news_score,
 case when user_id % 7 = 0 then 'J44.1' when user_id % 11 = 0 then 'J44.X' else 'A01' end diag1,
 case when event_id % 10 = 0 then 'E85.2' end op1
 from events"""

SQL["complaints"] = """select p_partkey item_id,
 case when p_partkey % 37 = 0 then ' Unknown.' when p_partkey % 41 = 0 then 'Other?' when p_partkey % 43 = 0 then null
      else concat(case when p_partkey % 5 = 0 then upper(p_name) else p_name end,
                  case when p_partkey % 3 = 0 then ' ' when p_partkey % 3 = 1 then '.' else '' end) end complaint,
 case when p_partkey % 8 = 0 then 'FALLS' when p_partkey % 8 = 1 then 'ASSAULT' when p_partkey % 8 = 2 then 'Other than above'
      when p_partkey % 8 = 3 then 'Eyes' when p_partkey % 8 = 4 then null when p_partkey % 8 = 5 then 'SELF HARM'
      else upper(p_brand) end patient_group
 from part"""


# Comorbidity and chapter look-ups (constant size, built from ranges).
# Charlson comorbidity names and weights.
CHARLSON_WEIGHTS = {
    "myocardial_infarction": 1, "congestive_heart_failure": 1, "periphral_vascular_disease": 1,
    "cerebrovascular_disease": 1, "dementia": 1, "chronic_pulmonary_disease": 1,
    "connective_tissue_disease_rheumatic_disease": 1, "peptic_ulcer_disease": 1,
    "mild_liver_disease": 1, "diabetes_wo_complications": 1, "diabetes_w_complications": 2,
    "paraplegia_and_hemiplegia": 2, "renal_disease": 2, "cancer": 2,
    "moderate_or_sever_liver_disease": 3, "metastitic_carcinoma": 6, "aids_hiv": 6,
}
_CONDITIONS = list(CHARLSON_WEIGHTS)


def ref_comorbid(spark: SparkSession) -> DataFrame:
    """3-character code -> comorbidity name (every 9th (i*7+n) combination)."""
    r = spark.range(2600).select((F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).alias("n"))
    r = r.where((F.col("i") * 7 + F.col("n")) % 9 == 0)
    names = F.array(*[F.lit(c) for c in _CONDITIONS])
    return r.select(F.concat(F.char(F.lit(65) + F.col("i")), F.lpad(F.col("n").cast("string"), 2, "0")).alias("code3"),
                    F.element_at(names, ((F.col("i") + F.col("n")) % len(_CONDITIONS) + 1).cast("int")).alias("condition"))


def ref_chapters(spark: SparkSession) -> DataFrame:
    """3-character code -> chapter number/description, group code/description, code description."""
    r = spark.range(2600).select((F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).alias("n"))
    r = r.where((F.col("i") + F.col("n")) % 3 != 0)
    letter = F.char(F.lit(65) + F.col("i"))
    code3 = F.concat(letter, F.lpad(F.col("n").cast("string"), 2, "0"))
    grp = F.concat(letter, (F.col("n") / 10).cast("int").cast("string"))
    return r.select(code3.alias("code3"), (F.col("i") % 22 + 1).cast("int").alias("chapter_no"),
                    F.concat(F.lit("chapter "), (F.col("i") % 22 + 1).cast("string")).alias("chapter_desc"),
                    grp.alias("group_code"), F.concat(F.lit("group "), grp).alias("group_desc"),
                    F.concat(F.lit("three "), code3).alias("code3_desc"))


def charlson_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHARLSON_WEIGHTS.items()), "condition string, weight int")


SQL["ref_comorbid"] = ("select concat(chr(cast(65 + i as int)), lpad(cast(n as varchar), 2, '0')) code3, "
                       "(['" + "', '".join(_CONDITIONS) + "'])[cast((i + n) % " + str(len(_CONDITIONS)) + " + 1 as int)] condition "
                       "from range(26) t(i) cross join range(100) u(n) where (i * 7 + n) % 9 = 0")
SQL["ref_chapters"] = """select concat(chr(cast(65 + i as int)), lpad(cast(n as varchar), 2, '0')) code3,
 cast(i % 22 + 1 as int) chapter_no, concat('chapter ', cast(i % 22 + 1 as varchar)) chapter_desc,
 concat(chr(cast(65 + i as int)), cast(cast(floor(n / 10) as int) as varchar)) group_code,
 concat('group ', chr(cast(65 + i as int)), cast(cast(floor(n / 10) as int) as varchar)) group_desc,
 concat('three ', chr(cast(65 + i as int)), lpad(cast(n as varchar), 2, '0')) code3_desc
 from range(26) t(i) cross join range(100) u(n) where (i + n) % 3 <> 0"""
SQL["charlson_weights"] = "select * from (values " + ", ".join(
    f"('{k}', {w})" for k, w in CHARLSON_WEIGHTS.items()) + ") t(condition, weight)"
