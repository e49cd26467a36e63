"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Each text gives a vector of five transformed statistics (``FEATURES``). Per group the
minimum-covariance-determinant estimate is found by concentration steps: from median
and MAD, keep the ``core`` share of rows with the smallest distance, take their mean and
covariance, and repeat. A row is rejected if its squared Mahalanobis distance is above
the ``confidence`` quantile of chi-square. Each feature's variance has a floor, since
statistics such as repeated lines are zero in most clean texts and a covariance without
a floor would reject the first text that has one. The two repeated shares are taken as
logits, so each can pass the cut alone: where repeats are unusual, over about half of
the lines or 0.18 of the words.

A group is a language and source with ``least`` or more rows that pass the limits; the
rows of smaller groups are pooled by language, and those of smaller languages together.
A pool of under ``few`` rows rejects none: it cannot say what is usual.

Everything is DataFrame functions. Distances are counted in narrow bins of their
logarithm, so a group's core is found by partial counts and never by sorting a group;
means and covariances are sums. The groups' estimates are one row each and are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import WORD, stored, unused

SPACE = r"[\x20\x09-\x0D]+"
#: Logit of a share, with 0.05 added on both sides.
LOGIT = "ln(({0} + 0.05D) / (1.05D - {0}))"
#: Transformed statistic, and the floor of its standard deviation.
FEATURES = {
    "_x0": ("ln(1 + n_words)", 0.5),
    "_x1": ("ln(1 + word_chars / n_words)", 0.1),
    "_x2": ("ln(1 + 100 * n_symbols / greatest(word_chars, 1))", 0.25),
    "_x3": (LOGIT.format("n_dup_lines / greatest(n_lines, 1)"), 0.6),
    "_x4": (LOGIT.format("n_repeat_words / n_words"), 0.35),
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``STATS``, ``n_lines`` (lines with a word) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({
        "_w": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "_l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"), "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_w": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_l")
    five = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(5)])
    starts = F.when(F.col("n_words") >= 5, F.sequence(F.lit(0), F.size("_w") - 5)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_h", F.transform(starts, five)).drop("_w")
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(twice, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.drop("_h")
    same = lambda x, i: (x["h"] == F.get("_s", i - 1)["h"]) | (x["h"] == F.get("_s", i + 1)["h"])
    at = F.array_sort(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), x["h"] == F.get("_s", i - 1)["h"],
                                                                           x["h"] == F.get("_s", i + 1)["h"], F.lit(False))),
                                  lambda x: x["i"]))
    d = d.withColumn("_p", at).drop("_s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-10).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).cast("long").alias("n"), p.alias("last"))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate("_p", start, step)["n"], F.lit(0).cast("long"))).drop("_p")
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function for odd ``k``."""
    out, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, k, 2):
        out -= term
        term *= x / (i + 2)
    return out


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _distance(xs: list[str]) -> Column:
    """Squared Mahalanobis distance from mean ``m_x`` and inverse Cholesky factor ``w_ij``."""
    rows = [sum((F.col(f"w_{i}{j}") * (F.col(xs[j]) - F.col(f"m_{xs[j]}")) for j in range(i + 1)), F.lit(0.0))
            for i in range(len(xs))]
    return sum((r * r for r in rows), F.lit(0.0))


def _whiten(moments: DataFrame, xs: list[str], floors: list[float], scale: float) -> DataFrame:
    """From counts, sums and products to means and the inverse Cholesky factor."""
    p = range(len(xs))
    m = moments.withColumns({f"m_{x}": F.col(f"s_{x}") / F.col("n") for x in xs})
    m = m.withColumns({f"c_{i}{j}": F.lit(scale) * (F.col(f"s_{i}{j}") / F.col("n") - F.col(f"m_{xs[i]}") * F.col(f"m_{xs[j]}"))
                       + F.lit(floors[i] ** 2 if i == j else 0.0) for i in p for j in range(i + 1)})
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"c_{i}{j}") - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
            # rounding aside, a pivot is at least its floor
            m = m.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2))) if i == j else rest / F.col(f"l_{j}{j}"))
    for i in p:
        for j in range(i, -1, -1):
            acc = F.lit(1.0) if i == j else -sum((F.col(f"l_{i}{k}") * F.col(f"w_{k}{j}") for k in range(j, i)), F.lit(0.0))
            m = m.withColumn(f"w_{i}{j}", acc / F.col(f"l_{i}{i}"))
    return m.select("_g", *[f"m_{x}" for x in xs], *[f"w_{i}{j}" for i in p for j in range(i + 1)])


def pool_of(by: tuple[str, ...]) -> list[Column]:
    """Names of the pools that a row can be in, from its own group to all rows."""
    cols = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by]
    return [F.to_json(F.array(*cols[:k])) if k else F.lit("[]") for k in range(len(by), -1, -1)]


def pool_table(measured: DataFrame, by: tuple[str, ...] = ("lang", "source"), least: int = 200, few: int = 50) -> DataFrame:
    """(_pool, _g): the pool that each group's rows are judged in (null: too few to judge).
    Settled on a table of one row per group."""
    names = pool_of(by)
    ok = measured.where(~F.col("base_failed"))
    pools = ok.groupBy(names[0].alias("_g0"), *[n.alias(f"_g{i}") for i, n in enumerate(names[1:], 1)]).agg(F.count(F.lit(1)).alias("n"))
    pools = pools.withColumn("_g", F.when(F.col("n") >= least, F.col("_g0")))
    for k in range(1, len(names)):
        left = F.sum(F.when(F.col("_g").isNull(), F.col("n")).otherwise(0)).over(Window.partitionBy(f"_g{k}"))
        pools = pools.withColumn("_g", F.coalesce("_g", F.when(left >= (least if k < len(names) - 1 else few), F.col(f"_g{k}"))))
    return stored(pools.select(F.col("_g0").alias("_pool"), "_g"), "quality-pools")


def estimates(rows: DataFrame, core: float = 0.75, steps: int = 4) -> DataFrame:
    """Means and inverse Cholesky factors per ``_g`` of ``rows`` (_g and the features)."""
    xs, floors = list(FEATURES), [f for _, f in FEATURES.values()]
    rows = rows.where(F.col("_g").isNotNull()).select("_g", *xs)
    mid = stored(rows.groupBy("_g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m_{x}") for x in xs]), "quality-medians")
    off = rows.join(mid, "_g").groupBy("_g", *[f"m_{x}" for x in xs]).agg(
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5, 1000).alias(f"d_{x}") for x in xs])
    start = {f"w_{i}{j}": 1 / F.greatest(1.4826 * F.col(f"d_{xs[i]}"), F.lit(floors[i])) if i == j else F.lit(0.0)
             for i in range(len(xs)) for j in range(i + 1)}
    now = stored(off.select("_g", *[f"m_{x}" for x in xs], *[v.alias(k) for k, v in start.items()]), "quality-estimates")
    p = len(xs)
    scale = core / chi2_cdf(chi2_quantile(core, p), p + 2)
    upto = Window.partitionBy("_g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(steps):
        d = rows.join(now, "_g").select("_g", *xs, F.floor(64 * F.ln(_distance(xs) + 1e-6)).alias("bin"))
        bins = d.groupBy("_g", "bin").agg(F.count(F.lit(1)).alias("n"))
        bins = bins.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)),
                                 "all": F.sum("n").over(Window.partitionBy("_g"))})
        edge = bins.where(F.col("before") < core * F.col("all")).groupBy("_g").agg(F.max("bin").alias("edge"))
        near = d.join(edge, "_g").where("bin <= edge")
        sums = {f"s_{x}": F.sum(x) for x in xs} | {
            f"s_{i}{j}": F.sum(F.col(xs[i]) * F.col(xs[j])) for i in range(p) for j in range(i + 1)}
        moments = near.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
        now = stored(_whiten(moments, xs, floors, scale), "quality-estimates")
    return now


def judge(stats: DataFrame, by: tuple[str, ...] = ("lang", "source"), confidence: float = 0.999, least: int = 200,
          few: int = 50, core: float = 0.75, steps: int = 4) -> DataFrame:
    """``stats`` (a stored result of ``measure``) with ``distance`` (null where not
    judged) and ``kept``."""
    xs = list(FEATURES)
    m = stats.withColumn("_pool", F.when(~F.col("base_failed"), pool_of(by)[0]))
    m = m.join(pool_table(stats, by, least, few), "_pool", "left").drop("_pool")
    m = m.withColumns({x: F.when(F.col("_g").isNotNull(), F.expr(e)) for x, (e, _) in FEATURES.items()})
    fit = estimates(stored(m.select("_g", *xs), "quality-vectors"), core, steps)
    out = m.join(fit, "_g", "left").withColumn("distance", _distance(xs))
    limit = F.lit(chi2_quantile(confidence, len(xs)))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))
    return out.select(*stats.columns, "distance", "kept")


def rate(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), **limits) -> DataFrame:
    """One row per row of ``docs``: its columns but the text, the statistics,
    base_failed, distance and kept.

    Null texts have no words and fail the limits, as do texts under 10 words or with over
    a fifth of their words in repeated 5-word windows. Null languages and sources are
    groups of their own. Repeated rows are judged alike, one by one; an empty table gives
    no rows. Columns of ``docs`` named like one of those added are replaced; others may have
    any names."""
    own = [*STATS, "n_lines", "base_failed", "distance", "kept"]
    rest = [c for c in docs.columns if c != text and c not in own]
    # the row travels as one column, so none of its names can clash
    lean = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("_doc"), F.col(text).alias("_text"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    got = judge(stored(measure(lean, "_text").drop("_text"), "quality-stats"), tuple(f"_by{i}" for i in range(len(by))), **limits)
    return got.select(*[F.col("_doc")[c].alias(c) for c in rest], *own)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source"), **limits) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, unchanged. Verdicts meet their rows by id
    and a hash of the whole row.

    Null, empty and short texts go, as do texts over the limits; null ids, languages and
    sources are values like others; repeated rows stay or go together; an empty table gives
    no rows. Columns may have any names."""
    at, = unused(docs, "_row")
    row = docs.withColumn(at, F.struct(F.col(id_col).alias("_id"), F.xxhash64(*[F.col(c) for c in docs.columns]).alias("_tie")))
    lean = row.select(at, F.col(text).alias("text"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(by)])
    good = stored(rate(lean, "text", tuple(f"by{i}" for i in range(len(by))), **limits).where("kept").select(at).distinct(), "quality-kept")
    return row.join(good.hint("shuffle_hash"), at, "left_semi").select(*docs.columns)
