"""The composed flows run every survey row on tables that have its columns."""

from pyspark.sql import functions as F

from wardlens.plans import flows as fl

SPELL = {"spell_id": 1, "patient_id": "7", "age": 40, "los_band": "In", "gender": "Female", "died": "No", "care_home": "Yes",
         "admission_type": "Elective", "ethnicity": "NOT STATED", "patient_type": "x", "news_first_recorded_dtm": "t",
         "patient_group": "FALLS", "complaint": "Chest Pain.", "ae_diagnosis": "Unknown", "sodium_first": "<80",
         "ddimer_last": "<150", "crp_24h_post_adm": "<4.0", "urea_first": " 5 ", "resp_rate_first": -180.0, "o2_sat_first": 9.5,
         "o2_sat_last": 96.0, "temperature_last": -37.0, "dbp_last": 80.0, "sbp_last": 84.0, "heart_rate_first": 400.0,
         "device_last": "Other; cpap; x", "nausea_last": "1 - Nausea present", "vomiting_last": None}
TYPES = ", ".join(f"{c} {'long' if c == 'spell_id' else 'int' if c == 'age' else 'double' if isinstance(v, float) else 'string'}"
                  for c, v in SPELL.items())


def test_from_raw_runs_every_step(spark):
    rows = [SPELL] + [{**SPELL, "spell_id": i, "complaint": f"c{i % 3}", "o2_sat_first": 95.0 + i % 3} for i in range(2, 80)]
    rows += [{**SPELL, "spell_id": 90, "o2_sat_first": 30.0, "complaint": "rare", "patient_group": "Eyes", "ae_diagnosis": "Flu"},
             {**SPELL, "spell_id": 91, "los_band": "Still In"}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], TYPES)
    got = {r.spell_id: r for r in fl.from_raw(df, n=3).collect()}
    assert len(got) == 80
    r = got[1].asDict()
    assert not {"patient_type", "news_first_recorded_dtm", "gender", "admission_type"} & set(r)  # P4, P7
    assert r["female"] and r["care_home"] and r["elective_admission"] and r["ethnicity"] is None  # P13, P11
    assert r["patient_group"] == "trauma" and got[90].patient_group == "eyes"  # F5e
    assert r["ae_diagnosis"] is None and got[90].ae_diagnosis == "flu"  # F2
    assert r["complaint"] is None and got[90].complaint is None and got[2].complaint == "c2"  # A2: outside the top 3
    assert r["sodium_first"] is None and r["ddimer_last"] == 125 and r["crp_24h_post_adm"] == 2.25 and r["urea_first"] == 5  # P12
    assert r["resp_rate_first"] == 18 and r["temperature_last"] == 37 and r["dbp_last"] == 80 and r["sbp_last"] is None  # D23
    assert r["heart_rate_first"] is None and r["o2_sat_first"] == 95 and got[90].o2_sat_first is None and r["o2_sat_last"] == 96
    assert r["device_last"] == "CPAP" and r["nausea_last"] is True and r["vomiting_last"] is False


def test_clean_all_runs_every_step(spark):
    from tests.conftest import SF_SMALL
    from wardlens.plans import fixtures as fx
    k = F.col("obs_id")
    obs = fx.obs(spark, SF_SMALL).limit(300).withColumns({
        "complaint": F.when(k % 2 == 0, F.lit("Gen Unwell.")).otherwise(F.lit("Fall ")), "patient_group": F.lit("Sports Injury"),
        "diag1": F.lit("R10.1"), "diag2": F.lit("J44.1"), "diag3": F.lit(None).cast("string"), "diag4": F.lit("Z40"),
        "admit_ward": F.when(k % 3 == 0, "AEC").otherwise("W5"), "vbg_ph": F.lit(7.4)})
    got = fl.clean_all(obs).toPandas()
    assert len(got) == 300 and "vbg_ph" not in got  # P3
    assert (got.complaint == ["other" if i % 2 == 0 else "fall" for i in got.obs_id]).all()  # D24
    assert set(got.patient_group) == {"trauma"}  # D25
    assert set(got.diag1) == {"J44.1"} and set(got.diag2) == {"Z40"} and got.diag3.isna().all() and got.diag4.isna().all()  # D11
    assert (got.sent_to_sdec == (got.obs_id % 3 == 0)).all()  # D7


def test_from_params_keeps_groups_and_one_hots(spark):
    df = spark.createDataFrame([(1, 9.0, "A01.1", "B02"), (2, None, "A01.1", "B02"), (3, 9.0, "A01.1", None), (4, 9.0, "A01", "Q99")],
                               "spell_id long, resp_rate double, diag1 string, diag2 string")
    table = spark.createDataFrame([("A011", 5), ("A01", 6), ("B02", 7)], "code string, grp long")
    p = {"keep": ["obs"], "grouping": (table, "code", "grp")}
    assert sorted(fl.from_params(df, p).collect()) == [(1, 9.0, 5, 7), (4, 9.0, 6, 259)]
    got = fl.from_params(df, {**p, "grouping_onehot": True}).orderBy("spell_id")
    assert got.columns == ["spell_id", "resp_rate", "CCS__5", "CCS__6", "CCS__7", "CCS__259"]
    assert [tuple(r[2:]) for r in got.collect()] == [(1, 0, 1, 0), (1, 0, 0, 0), (0, 1, 0, 1)]
