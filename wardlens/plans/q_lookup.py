"""Code-family and look-up queries (J-rows, code cleaning, sets, Charlson)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlens.functions import codes as cd
from wardlens.functions import families as fam
from wardlens.operators import lookup as lk
from wardlens.operators.derive import charlson_age_points
from wardlens.plans import common as cm
from wardlens.plans import fixtures as fx
from wardlens.plans.registry import query
from wardlens.session import scratch_path
from wardlens.sources import read_json_map, read_table, write_table

STD_SQL = """case when regexp_matches(s1, '[A-Z]$') then left(s1, greatest(length(s1) - 1, 0)) else s1 end"""
STEP1_SQL = """case when contains(code, ' ') or ends_with(code, '.X') then left(code, greatest(length(code) - 2, 0)) else code end"""
STD_CTE = ("std", f"select spell_id, slot, code code_raw, {STD_SQL} code from (select *, {STEP1_SQL} s1 from slots) t")
CLEAN_CTE = ("clean", "select spell_id, slot, code_raw, case when code in (select code from ref_codes) then code end code from std")
ALL_WANTED = ["A60", "B25.1"]
ANY_WANTED = ["L09.1", "M88", "P57.99"]


def v(body, *names, extra=()):
    return fx.with_views(body, *names, extra=list(extra))


def std_codes(spark, d):
    s = fx.slots(spark, d)
    return s.select("spell_id", "slot", F.col("code").alias("code_raw"), cd.standardise("code").alias("code"))


def clean_codes(spark, d):
    return lk.keep_members(std_codes(spark, d), "code", fx.ref_codes(spark), "code")


def _joined(arr_expr):
    """Array -> 'a,b,~' text (missing entries as '~') for order-sensitive compare."""
    return F.array_join(F.transform(arr_expr, lambda x: F.coalesce(x.cast("string"), F.lit("~"))), ",")


def packed(df, value, name="codes"):
    """(spell_id, slot, value) -> (spell_id, array of value in slot order)."""
    p = fam.pack_long(df.select("spell_id", "slot", F.col(value).alias("v")), "spell_id", "slot", ["v"], "_p")
    return p.select("spell_id", F.transform("_p", lambda x: x["v"]).alias(name))


@query("clean_codes", v("select spell_id, slot, code_raw, code from clean", "slots", "ref_codes", extra=[STD_CTE, CLEAN_CTE]))
def q_clean_codes(spark, d):
    return clean_codes(spark, d)


@query("codes_semi", v("select spell_id, slot, code from std where code in (select code from ref_codes)",
                       "slots", "ref_codes", extra=[STD_CTE]))
def q_codes_semi(spark, d):
    return lk.semi(std_codes(spark, d), "code", fx.ref_codes(spark), "code").select("spell_id", "slot", "code")


@query("codes_anti", v("select spell_id, slot, code from std where code not in (select code from ref_codes)",
                       "slots", "ref_codes", extra=[STD_CTE]))
def q_codes_anti(spark, d):
    return lk.semi(std_codes(spark, d), "code", fx.ref_codes(spark), "code", anti=True).select("spell_id", "slot", "code")


CASCADE_CTE = ("casc", """select spell_id, slot, std.code, case when std.code is null then null else coalesce(e.grp, p3.grp, p4.grp, 259) end grp
 from std left join ref_ccs e on e.code = replace(std.code, '.', '')
 left join ref_ccs p3 on p3.code = left(replace(std.code, '.', ''), 3)
 left join ref_ccs p4 on p4.code = left(replace(std.code, '.', ''), 4)""")


def cascade(spark, d):
    return lk.cascade_join(std_codes(spark, d), "code", fx.ref_ccs(spark), "code", "grp", "grp",
                           prefixes=(3, 4), sentinel=lk.CCS_SENTINEL)


@query("fuzzy_group_join", v("select spell_id, slot, code, grp from casc", "slots", "ref_ccs", extra=[STD_CTE, CASCADE_CTE]))
def q_fuzzy_group_join(spark, d):
    return cascade(spark, d).select("spell_id", "slot", "code", "grp")


@query("regroup_codes", v("select spell_id, slot, casc.grp, h.agg_grp from casc left join ref_hsmr h on h.grp = casc.grp",
                          "slots", "ref_ccs", "ref_hsmr", extra=[STD_CTE, CASCADE_CTE]))
def q_regroup_codes(spark, d):
    c = cascade(spark, d).select("spell_id", "slot", "grp")
    return lk.lookup_join(c, "grp", fx.ref_hsmr(spark), "grp", ["agg_grp"])


def derive_groups(spark, d, grouping="HSMR"):
    """Clean codes, cascade to CCS groups, optionally regroup; packed per stay."""
    lk.check_grouping(grouping)
    c = lk.cascade_join(clean_codes(spark, d), "code", fx.ref_ccs(spark), "code", "grp", "grp")
    if grouping == "HSMR":
        c = lk.lookup_join(c, "grp", fx.ref_hsmr(spark), "grp", ["agg_grp"])
        val = "agg_grp"
    elif grouping == "SHMI":
        c = lk.lookup_join(c, "grp", fx.ref_shmi(spark), "grp", ["shmi_grp"])
        val = "shmi_grp"
    else:
        val = "grp"
    return packed(c, val, "groups").select("spell_id", _joined(F.col("groups")).alias("groups"))


@query("derive_groups", v(
    """select spell_id, string_agg(coalesce(cast(h.agg_grp as varchar), '~'), ',' order by slot) groups
 from casc2 left join ref_hsmr h on h.grp = casc2.grp group by spell_id""", "slots", "ref_codes", "ref_ccs", "ref_hsmr",
    extra=[STD_CTE, CLEAN_CTE, ("casc2", CASCADE_CTE[1].replace("from std", "from clean").replace("std.code", "clean.code"))]))
def q_derive_groups(spark, d):
    return derive_groups(spark, d, "HSMR")


_CASC2 = ("casc2", CASCADE_CTE[1].replace("from std", "from clean").replace("std.code", "clean.code"))


@query("derive_groups_shmi", v(
    """select spell_id, string_agg(coalesce(cast(h.shmi_grp as varchar), '~'), ',' order by slot) groups
 from casc2 left join ref_shmi h on h.grp = casc2.grp group by spell_id""", "slots", "ref_codes", "ref_ccs", "ref_shmi",
    extra=[STD_CTE, CLEAN_CTE, _CASC2]))
def q_derive_groups_shmi(spark, d):
    return derive_groups(spark, d, "SHMI")


@query("derive_groups_ccs", v("select spell_id, string_agg(coalesce(cast(grp as varchar), '~'), ',' order by slot) groups from casc2 group by spell_id",
                              "slots", "ref_codes", "ref_ccs", extra=[STD_CTE, CLEAN_CTE, _CASC2]))
def q_derive_groups_ccs(spark, d):
    return derive_groups(spark, d, None)


@query("group_descriptions", v(
    """select spell_id, slot, casc2.grp, h.agg_grp, 'aggregate ' || h.agg_grp::varchar hsmr_desc, m.shmi_grp, m.shmi_desc
 from casc2 left join ref_hsmr h on h.grp = casc2.grp left join ref_shmi m on m.grp = casc2.grp""",
    "slots", "ref_codes", "ref_ccs", "ref_hsmr", "ref_shmi", extra=[STD_CTE, CLEAN_CTE, _CASC2]))
def q_group_descriptions(spark, d):
    c = lk.cascade_join(clean_codes(spark, d), "code", fx.ref_ccs(spark), "code", "grp", "grp")
    hsmr = fx.ref_hsmr(spark).withColumn("hsmr_desc", F.concat(F.lit("aggregate "), F.col("agg_grp").cast("string")))
    c = lk.lookup_join(c, "grp", hsmr, "grp", ["agg_grp", "hsmr_desc"])
    c = lk.lookup_join(c, "grp", fx.ref_shmi(spark), "grp", ["shmi_grp", "shmi_desc"])
    return c.select("spell_id", "slot", "grp", "agg_grp", "hsmr_desc", "shmi_grp", "shmi_desc")


def code_levels(df, lookup, code, levels=("chapter", "group", "code3"), drop_code=True):
    """Joins any of a diagnosis code's chapter, group and 3-character code; the full
    code goes unless it is kept."""
    cols = {"chapter": ["chapter_no", "chapter_desc"], "group": ["group_code"], "code3": []}
    want = [c for level in levels for c in cols[level]]
    out = df.withColumn("code3", cd.stem3(code))
    out = lk.lookup_join(out, "code3", lookup, "code3", want) if want else out
    return out.drop(*([] if "code3" in levels else ["code3"]), *([code] if drop_code else []))


_LEVEL_SQL = "select spell_id, slot, {cols} from std left join ref_chapters c on c.code3 = split_part(std.code, '.', 1)"


@query("code_levels_chapter", v(_LEVEL_SQL.format(cols="c.chapter_no, c.chapter_desc"), "slots", "ref_chapters", extra=[STD_CTE]))
def q_code_levels_chapter(spark, d):
    c = std_codes(spark, d).select("spell_id", "slot", "code")
    return code_levels(c, fx.ref_chapters(spark), "code", ["chapter"])


@query("code_levels_all", v(_LEVEL_SQL.format(cols="std.code, split_part(std.code, '.', 1) code3, c.chapter_no, c.chapter_desc, c.group_code"),
                            "slots", "ref_chapters", extra=[STD_CTE]))
def q_code_levels_all(spark, d):
    c = std_codes(spark, d).select("spell_id", "slot", "code")
    return code_levels(c, fx.ref_chapters(spark), "code", drop_code=False)


@query("stored_lookup_join", v("select spell_id, slot, casc.grp, h.agg_grp, rc.condition from casc left join ref_hsmr h on h.grp = casc.grp left join ref_comorbid rc on rc.code3 = split_part(casc.code, '.', 1)",
                               "slots", "ref_ccs", "ref_hsmr", "ref_comorbid", extra=[STD_CTE, CASCADE_CTE]))
def q_stored_lookup_join(spark, d):
    """Look-ups as a user has them: a Parquet table and a JSON map, read from storage."""
    at = scratch_path(spark, f"lookups-{uuid.uuid4().hex}")
    write_table(fx.ref_hsmr(spark), f"{at}/hsmr")
    pairs = fx.ref_comorbid(spark).select("code3", "condition").distinct()
    one = pairs.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("code3", "condition")))).alias("value"))  # a fixed list
    one.write.text(f"{at}/comorbid")
    c = lk.lookup_join(cascade(spark, d), "grp", spark.read.parquet(f"{at}/hsmr"), "grp", ["agg_grp"])
    c = c.withColumn("code3", cd.stem3("code"))
    c = lk.lookup_join(c, "code3", read_json_map(spark, f"{at}/comorbid", "k", "condition"), "k", ["condition"])
    return c.select("spell_id", "slot", "grp", "agg_grp", "condition")


_MAIN_CTE = ("main", f"select spell_id, code main_code from std where slot = (select min(slot) from slots s2 where s2.spell_id = std.spell_id)")


@query("prefix_join_chapter", v(
    """select spell_id, split_part(main_code, '.', 1) main_code3, c.chapter_no, c.chapter_desc, c.group_code
 from main left join ref_chapters c on c.code3 = split_part(main_code, '.', 1)""",
    "slots", "ref_chapters", extra=[STD_CTE, _MAIN_CTE]))
def q_prefix_join_chapter(spark, d):
    m = cm.paths(spark, d).select("spell_id", cd.standardise(F.try_element_at("path", F.lit(1))["code"]).alias("main_code"))
    m = m.withColumn("main_code3", cd.stem3("main_code"))
    j = lk.lookup_join(m, "main_code3", fx.ref_chapters(spark), "code3",
                       ["chapter_no", "chapter_desc", "group_code"])
    return j.select("spell_id", "main_code3", "chapter_no", "chapter_desc", "group_code")


@query("join_descriptions", v("select spell_id, main_code, r.descr main_code_desc from main left join ref_codes r on r.code = main_code",
                              "slots", "ref_codes", extra=[STD_CTE, _MAIN_CTE]))
def q_join_descriptions(spark, d):
    m = cm.paths(spark, d).select("spell_id", cd.standardise(F.try_element_at("path", F.lit(1))["code"]).alias("main_code"))
    j = lk.lookup_join(m, "main_code", fx.ref_codes(spark), "code", ["descr"])
    return j.withColumnRenamed("descr", "main_code_desc")


@query("expand_descriptions", v(
    """select clean.spell_id, clean.slot, r.descr code_desc, g.grp_desc
 from clean left join ref_codes r on r.code = clean.code
 left join casc2 on casc2.spell_id = clean.spell_id and casc2.slot = clean.slot
 left join (select distinct grp, 'group ' || cast(grp as varchar) grp_desc from ref_ccs) g on g.grp = casc2.grp""",
    "slots", "ref_codes", "ref_ccs",
    extra=[STD_CTE, CLEAN_CTE, ("casc2", CASCADE_CTE[1].replace("from std", "from clean").replace("std.code", "clean.code"))]))
def q_expand_descriptions(spark, d):
    c = clean_codes(spark, d)
    c = lk.lookup_join(c, "code", fx.ref_codes(spark), "code", ["descr"])
    c = lk.cascade_join(c, "code", fx.ref_ccs(spark), "code", "grp", "grp")
    # the group -> description table is many-to-one: de-duplicate before joining
    gd = fx.ref_ccs(spark).select("grp").distinct().withColumn("grp_desc", F.concat(F.lit("group "), F.col("grp").cast("string")))
    c = lk.lookup_join(c, "grp", gd, "grp", ["grp_desc"])
    return c.select("spell_id", "slot", F.col("descr").alias("code_desc"), "grp_desc")


@query("justify_left", v("select spell_id, string_agg(coalesce(code, '~'), ',' order by (code is null), slot) codes from clean group by spell_id",
                         "slots", "ref_codes", extra=[STD_CTE, CLEAN_CTE]))
def q_justify_left(spark, d):
    p = packed(clean_codes(spark, d), "code")
    return p.select("spell_id", _joined(fam.justify(F.col("codes"), "left")).alias("codes"))


@query("justify_right", v("select spell_id, string_agg(coalesce(code, '~'), ',' order by (code is not null), slot) codes from clean group by spell_id",
                          "slots", "ref_codes", extra=[STD_CTE, CLEAN_CTE]))
def q_justify_right(spark, d):
    p = packed(clean_codes(spark, d), "code")
    return p.select("spell_id", _joined(fam.justify(F.col("codes"), "right")).alias("codes"))


def _vague_sql(x):
    conds = " or ".join(
        f"(substr({x}, 1, 1) = '{l_}' and regexp_matches(substr({x}, 2, 2), '^[0-9]{{2}}$') and cast(substr({x}, 2, 2) as int) between {lo} and {hi})"
        for l_, lo, hi in cd.VAGUE_CODE_RANGES)
    return f"coalesce({conds}, false)"


@query("vague_codes", v(
    f"""select spell_id, string_agg(coalesce(c, '~'), ',' order by (c is null), slot) codes from
 (select spell_id, slot, case when {_vague_sql('code')} then null else code end c from std) t group by spell_id""",
    "slots", extra=[STD_CTE]))
def q_vague_codes(spark, d):
    p = packed(std_codes(spark, d), "code")
    kept = F.transform("codes", lambda x: F.when(cd.is_vague(x), F.lit(None)).otherwise(x))
    return p.select("spell_id", _joined(fam.justify(kept, "left")).alias("codes"))


def _in(vals):
    return ", ".join(f"'{x}'" for x in vals)


@query("contains_all", v(
    f"""select spell_id, count(distinct case when code in ({_in(ALL_WANTED)}) then code end) = {len(ALL_WANTED)} has_all
 from std group by spell_id""", "slots", extra=[STD_CTE]))
def q_contains_all(spark, d):
    p = packed(std_codes(spark, d), "code")
    return p.select("spell_id", fam.contains_all("codes", ALL_WANTED).alias("has_all"))


@query("contains_any", v(f"select spell_id, bool_or(coalesce(code in ({_in(ANY_WANTED)}), false)) has_any from std group by spell_id",
                         "slots", extra=[STD_CTE]))
def q_contains_any(spark, d):
    p = packed(std_codes(spark, d), "code")
    return p.select("spell_id", fam.contains_any("codes", ANY_WANTED).alias("has_any"))


@query("code_flag_any", v(
    f"""select s.spell_id, coalesce(a.hit, false) and coalesce(s.admitted >= timestamp '1995-01-01', false) code_flag
 from spells s left join (select spell_id, bool_or(coalesce(code in ({_in(ANY_WANTED)}), false)) hit from std group by spell_id) a using (spell_id)""",
    "slots", "spells", extra=[STD_CTE]))
def q_code_flag_any(spark, d):
    from wardlens.operators.derive import code_flag_any
    p = packed(std_codes(spark, d), "code")
    s = fx.spells(spark, d).select("spell_id", "admitted").join(p, "spell_id", "left")
    return s.select("spell_id", code_flag_any(F.col("codes"), "admitted", ANY_WANTED, "1995-01-01").alias("code_flag"))


@query("code_flag_all", v(
    f"""select s.spell_id, coalesce(a.n = {len(ALL_WANTED)}, false) code_flag
 from spells s left join (select spell_id, count(distinct case when code in ({_in(ALL_WANTED)}) then code end) n from std group by spell_id) a using (spell_id)""",
    "slots", "spells", extra=[STD_CTE]))
def q_code_flag_all(spark, d):
    from wardlens.operators.derive import code_flag_all
    p = packed(std_codes(spark, d), "code")
    s = fx.spells(spark, d).select("spell_id").join(p, "spell_id", "left")
    return s.select("spell_id", code_flag_all(F.col("codes"), ALL_WANTED).alias("code_flag"))


def charlson(spark, d):
    """Comorbidity weights of the stay's cleaned 3-codes (each code counts) plus
    age points; long form + two broadcast joins + one partial aggregate."""
    c = clean_codes(spark, d).where(F.col("code").isNotNull()).select("spell_id", cd.stem3("code").alias("code3"))
    c = lk.lookup_join(c, "code3", fx.ref_comorbid(spark), "code3", ["condition"])
    c = lk.lookup_join(c, "condition", fx.charlson_weights(spark), "condition", ["weight"])
    w = c.groupBy("spell_id").agg(F.sum("weight").alias("w"))
    s = fx.spells(spark, d).select("spell_id", "age").join(w, "spell_id", "left")
    return s.select("spell_id", (F.coalesce(F.col("w"), F.lit(0)) + charlson_age_points("age")).cast("int").alias("charlson"))


@query("charlson", v(
    """select s.spell_id, cast(coalesce(w.w, 0) + case when age > 50 and age <= 59 then 1 when age > 60 and age <= 69 then 2
   when age > 70 and age <= 79 then 3 when age > 79 then 4 else 0 end as int) charlson
 from spells s left join (select spell_id, sum(cw.weight) w from clean
   left join ref_comorbid rc on rc.code3 = split_part(clean.code, '.', 1)
   left join charlson_weights cw on cw.condition = rc.condition
   where clean.code is not null group by spell_id) w using (spell_id)""",
    "slots", "spells", "ref_codes", "ref_comorbid", "charlson_weights", extra=[STD_CTE, CLEAN_CTE]))
def q_charlson(spark, d):
    return charlson(spark, d)


_MULTI_WARDS = fx.FIXTURE_WARDS


@query("multi_hot", v(
    "select s.spell_id, " + ", ".join(f"coalesce(max(case when sl.ward = '{w}' then 1 else 0 end), 0) ward__{w}" for w in _MULTI_WARDS)
    + " from spells s left join slots sl using (spell_id) group by s.spell_id", "slots", "spells"))
def q_multi_hot(spark, d):
    s = fx.spells(spark, d).select("spell_id").join(cm.paths(spark, d), "spell_id", "left")
    wards = F.transform(F.coalesce(F.col("path"), F.array().cast("array<struct<slot:int,ward:string,los:double,code:string>>")),
                        lambda x: x["ward"])
    return s.select("spell_id", *[fam.any_of(wards, lambda x, w=w: x == w).cast("int").alias(f"ward__{w}")
                                  for w in _MULTI_WARDS])


@query("mapping_loss", v("select count(code_raw) n_before, count(code) n_after, count(code_raw) - count(code) n_lost from clean",
                         "slots", "ref_codes", extra=[STD_CTE, CLEAN_CTE]))
def q_mapping_loss(spark, d):
    c = clean_codes(spark, d)
    return c.agg(F.count("code_raw").alias("n_before"), F.count("code").alias("n_after"),
                 (F.count("code_raw") - F.count("code")).alias("n_lost"))


# --- keyed overlaps between tables --------------------------------------------

@query("cohort_overlap_semi", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def q_cohort_overlap_semi(spark, d):
    docs = read_table(spark, d, "documents", ["doc_id", "lang"])
    return lk.semi(docs, "doc_id", read_table(spark, d, "labels", ["doc_id"]), "doc_id")


@query("key_intersect", "select doc_id from documents intersect select doc_id from labels")
def q_key_intersect(spark, d):
    a = read_table(spark, d, "documents", ["doc_id"])
    b = read_table(spark, d, "labels", ["doc_id"])
    return a.intersect(b)


@query("align_full_outer", """select coalesce(a.doc_id, b.doc_id) doc_id, a.n_chars, b.quality
 from documents a full outer join labels b on a.doc_id = b.doc_id""")
def q_align_full_outer(spark, d):
    a = read_table(spark, d, "documents", ["doc_id", "n_chars"])
    b = read_table(spark, d, "labels", ["doc_id", "quality"])
    return a.join(b, "doc_id", "full_outer")


@query("label_agreement", """select count(*) n_common, count_if(a) n_a, count_if(b) n_b, count_if(a and b) n_both,
 round(count_if(a and b) / nullif(count_if(a), 0), 6) agreement
 from (select doc_id, n_chars < 2000 a from documents) x join (select doc_id, quality = 0 b from labels) y using (doc_id)""")
def q_label_agreement(spark, d):
    a = read_table(spark, d, "documents", ["doc_id", "n_chars"]).select("doc_id", (F.col("n_chars") < 2000).alias("a"))
    b = read_table(spark, d, "labels", ["doc_id", "quality"]).select("doc_id", (F.col("quality") == 0).alias("b"))
    j = a.join(b, "doc_id")
    return j.agg(F.count(F.lit(1)).alias("n_common"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"),
                 F.count_if(F.col("a") & F.col("b")).alias("n_both"),
                 F.round(F.count_if(F.col("a") & F.col("b")) / F.nullif(F.count_if("a"), F.lit(0)), 6).alias("agreement"))


@query("overlap_stats", """select count_if(a is not null) n_left, count_if(b is not null) n_right, count_if(a is not null and b is not null) n_both,
 round(100.0 * count_if(a is not null and b is not null) / count_if(a is not null), 6) pct_left,
 round(100.0 * count_if(a is not null and b is not null) / count_if(b is not null), 6) pct_right
 from (select distinct doc_id a from documents) x full outer join (select distinct doc_id b from labels) y on a = b""")
def q_overlap_stats(spark, d):
    a = read_table(spark, d, "documents", ["doc_id"]).distinct().select(F.col("doc_id").alias("a"))
    b = read_table(spark, d, "labels", ["doc_id"]).distinct().select(F.col("doc_id").alias("b"))
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return j.agg(F.count("a").alias("n_left"), F.count("b").alias("n_right"), both.alias("n_both"),
                 F.round(100.0 * both / F.count("a"), 6).alias("pct_left"),
                 F.round(100.0 * both / F.count("b"), 6).alias("pct_right"))
