"""Columns of a table may have the names that operators use inside."""

import pytest
from pyspark.sql import functions as F

from wardlens.llm import mixing, quality, simhash, substrings
from wardlens.llm.common import table, unused

SF = "/root/testdata/sf0.001"
NAMES = ["_tie", "_row", "_position", "_key", "_spans", "_g", "_pool", "_x0", "_doc", "_text", "_by0", "_id", "_fp", "_w", "_h", "_n", "_s", "_b", "Size"]


@pytest.fixture(scope="module")
def clash(spark):
    d = table(spark, SF, "documents").limit(120)
    return d.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in NAMES]).persist()


def check(got, ids=None):
    rows = got.collect()
    assert set(NAMES) <= set(got.columns) and rows
    for r in rows:
        assert all(r[n] == f"{n}:{r.doc_id}" for n in NAMES)
    return [r.doc_id for r in rows]


@pytest.mark.parametrize("stage", [
    lambda d: simhash.keep_one(d), lambda d: mixing.reorder(d), lambda d: quality.keep_good(d), lambda d: quality.rate(d),
    lambda d: substrings.remove_repeats(d)], ids=["keep_one", "reorder", "keep_good", "rate", "remove_repeats"])
def test_values_of_clashing_columns_are_kept(clash, stage):
    check(stage(clash))


def test_clashing_columns_change_no_result(clash):
    plain = clash.drop(*NAMES)
    for stage in (simhash.keep_one, quality.keep_good):
        assert sorted(check(stage(clash))) == sorted(r.doc_id for r in stage(plain).collect())
    spans = lambda d: sorted((r.doc_id, r.repeats.n_removed, r.repeats.kept_sha256) for r in substrings.remove_repeats(d).collect())
    assert spans(clash) == spans(plain)


def test_rate_replaces_its_own_columns(clash):
    d = clash.withColumns({"distance": F.lit("far"), "kept": F.lit("yes"), "n_words": F.lit("many")})
    got = quality.rate(d)
    assert len(got.columns) == len({c.lower() for c in got.columns})
    assert dict(got.dtypes)["kept"] == "boolean" and dict(got.dtypes)["n_words"] == "bigint"
    check(got)


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert unused(df, "a", "b") == ["a__", "b"]


def test_position_is_part_of_the_mix(spark):
    """The registered mix is sorted by range of the curriculum's positions."""
    from wardlens.llm import queries
    import contextlib
    import io
    got = queries.QUERIES["op4_curriculum_mix"](spark, SF)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        got.explain("formatted")
    assert "rangepartitioning(position" in out.getvalue() and "SQRT" in out.getvalue()
    rows = got.collect()
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)
    assert all((r.position is None) == (r.copies == 0) for r in rows)
