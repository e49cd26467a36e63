"""Mixing sources to target weights by a time-varying curriculum.

Targets. Sources in code-point order (null last) have the base weights 5, 2, 1, 5, ...
and share ``share`` times all words; a target stops at ``most`` times its source's words
and the excess goes to the others by weight until none is above.

Curriculum. Over training time 0..1 a source's weight is a straight line, 1 + a (2t - 1)
times its base weight with its own tilt ``a``. Integrated, a source has had
target * (t + a (t^2 - t)) words by time t. Its documents come in the order of an MD5 of
their ids, whole passes first; the cumulative words at a document's middle, put through
the inverse of that demand, give its training position. Sorting by position by range
interleaves all sources as the schedules ask.

Whole documents are taken. After whole passes, the last pass takes documents in order as
long as they fit the target, then the one document left over whose words come nearest to
what is missing, if that brings the source nearer to its target.

Running sums are taken inside 4096 hash buckets of a source on top of the buckets'
totals, so a source with a third of all rows is not ordered in one task; equal rows are
counted before any window. Nothing but a few totals goes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import n_words, stored, unused


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), tilts: Sequence[float] = (-0.5, 0.0, 0.5),
                   share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, tilt) from rows of (source, size): one row a source.
    Ordering the sources is a window over one row for each source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("_r") % len(xs) + 1)
    s = s.withColumn("_r", rank.cast("int")).select("source", "source_size", pick(weights).alias("weight"), pick(tilts).alias("tilt"))
    s = stored(s, "sources")
    cap = F.col("source_size") * F.lit(most)
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, at = 0.0, None
    while total:  # raise the level until the sources that it lifts above their cap stay the same
        over = F.col("weight") * F.lit(level) > cap if at is not None else F.lit(False)
        full, n, w = s.agg(F.sum(F.when(over, cap)), F.count_if(over), F.sum(F.when(~over, F.col("weight")))).first()
        if n == at or not w:
            break
        at, level = n, (share * total - (full or 0.0)) / w
    return s.select("source", "source_size", F.least(F.col("weight") * F.lit(level), cap).alias("target"), "tilt")


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size, and others that only break ties) with source_size, target, ``copies`` (times
    that the document is taken), ``taken`` (words) and ``positions`` (training positions of
    its copies, from 0 to 1). Every row of a repeated document is taken on its own."""
    ties = [x for x in sized.columns if x not in ("doc_id", "source", "size")]
    c = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    c = c.withColumns({"_b": F.substring("_h", 1, 3), "_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = c.groupBy("_s", "_b").agg(F.sum(F.col("size") * F.col("_n")).alias("_t"))
    off = off.select("_s", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_l", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0))).join(off, ["_s", "_b"])
    c = c.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    c = c.withColumn("_end", F.col("_o") + F.col("_l") + F.col("_copy") * F.col("size"))
    t = targets.withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    t = t.withColumn("_passes", passes).withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
    c = stored(c.drop("_o", "_l", "_n", "_b"), "mix-order").join(t, "_s")
    fits = F.col("_end") <= F.col("_rest")
    had = c.where(fits).groupBy("_s").agg(F.max("_end").alias("_had"))
    gap = t.select("_s", "_rest").join(had, "_s", "left").select(
        "_s", (F.col("_rest") - F.coalesce("_had", F.lit(0))).alias("_gap"))
    off_by = F.abs(F.col("_gap") - F.col("size"))
    best = F.struct(off_by.alias("_off"), "_h", "doc_id", "size", *ties, "_copy")
    extra = c.where(~fits).join(gap, "_s").where(off_by < F.col("_gap")).groupBy("_s").agg(F.min(best).alias("_extra"))
    c = c.join(stored(gap.join(extra, "_s", "left"), "mix-extra"), "_s")
    last = F.col("_extra").isNotNull()
    for x in ("_h", "doc_id", "size", *ties, "_copy"):
        last &= F.col(f"_extra.{x}").eqNullSafe(F.col(x))
    c = c.withColumn("_last", F.when(fits, F.col("_end")).when(last, F.col("_rest") - F.col("_gap") + F.col("size")))
    c = c.withColumn("copies", (F.col("_passes") + F.col("_last").isNotNull().cast("long")).cast("long"))
    # words that the source has had by the middle of each copy, as a share of its target
    middle = lambda i: F.when(i <= F.col("_passes"), (i - 1) * F.col("source_size") + F.col("_end")).otherwise(
        F.col("_passes") * F.col("source_size") + F.col("_last")) - F.col("size") / 2
    asked = lambda i: F.least(F.greatest(middle(i) / F.col("target"), F.lit(0.0)), F.lit(1.0))

    def when(i):
        a, y = F.col("tilt"), asked(i)
        root = F.sqrt((1 - a) * (1 - a) + 4 * a * y)
        return F.when(F.col("target") > 0, 2 * y / ((1 - a) + root)).otherwise(F.lit(0.0))

    some = F.transform(F.expr("sequence(1L, greatest(copies, 1L))"), when)
    return c.select("doc_id", "source", "size", *ties, "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"),
                    F.when(F.col("copies") > 0, some).otherwise(F.array().cast("array<double>")).alias("positions"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text",
               ties: Sequence[str] = (), **shape) -> DataFrame:
    """The mix of all documents: one row per row of ``docs`` with doc_id, source, size,
    source_size, target, copies, taken and positions (and ``ties``, columns that order
    rows which share an id).

    Size is the number of words; null or word-less texts have size 0 and are taken as
    often as their place in the order says, at no cost. Null sources are a source of
    their own, the last. Rows with a null id are ordered like the empty id; repeated rows
    are taken one by one; if no text has a word all targets are 0; an empty table gives
    no rows. Columns other than those named are not read."""
    s = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *ties)
    s = stored(s, "sizes")
    return mix(s, source_targets(s, **shape))


def reorder(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **shape) -> DataFrame:
    """``docs`` as the curriculum takes them: each row as often as it is taken, sorted by
    range of training position. Rows equal in full are interchangeable. A null text has no
    words and costs nothing; a null id is ordered like the empty one and a null source is a
    source; an empty table gives no rows. Columns may have any names."""
    tie, at, position = unused(docs, "_tie", "_row", "_position")
    d = docs.withColumn(tie, F.xxhash64(*[F.col(c) for c in docs.columns]))
    plan = curriculum(d, id_col, source, text, [tie], **shape).where("copies > 0")
    plan = plan.select(F.struct(F.col("doc_id").alias("_id"), F.col(tie).alias("_tie")).alias(at), F.explode("positions").alias(position))
    d = d.withColumn(at, F.struct(F.col(id_col).alias("_id"), F.col(tie).alias("_tie"))).dropDuplicates([at])
    out = d.join(plan, at).select(*docs.columns, position, tie)
    return out.repartitionByRange(position, tie).sortWithinPartitions(position, tie).select(*docs.columns)


ORACLE = r"""
with d as (select doc_id, source, md5(coalesce(doc_id::varchar, '')) h,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
s0 as (select source, sum(size)::bigint source_size from d group by source),
s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 r from s0),
s as (select source, source_size, [5.0, 2.0, 1.0][r + 1]::double w, [-0.5, 0.0, 0.5][r + 1]::double a from s1),
q as (select *, 2.0::double * source_size / w ratio, row_number() over (order by 2.0::double * source_size / w, source nulls last) k from s),
lv as (select k, ratio, (1.5::double * sum(source_size) over ()
   - coalesce(sum(2.0::double * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))
   / sum(w) over (order by k rows between current row and unbounded following) lam from q),
level as (select arg_min(lam, k) lam from lv where ratio >= lam),
t as (select source, source_size, least(w * coalesce(lam, 0), 2.0::double * source_size) target, a from s, level),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint passes from t),
c as (select d.*, p.source_size, p.target, p.a, p.passes, target - passes * p.source_size rest,
  row_number() over (partition by d.doc_id, d.source, d.size) copy,
  sum(size) over (partition by d.source order by h, d.doc_id, size rows unbounded preceding) e
  from d join p on d.source is not distinct from p.source),
g as (select source, any_value(rest) - coalesce(max(e) filter (e <= rest), 0) gap from c group by source),
x as (select c.source, min((abs(gap - size), h, doc_id, size, copy)) b from c join g on c.source is not distinct from g.source
  where e > rest and abs(gap - size) < gap group by c.source),
f as (select c.*, gap, case when e <= rest then e
  when (h, doc_id, size, copy) is not distinct from (b[2], b[3], b[4], b[5]) then rest - gap + size end lst
  from c join g on c.source is not distinct from g.source left join x on c.source is not distinct from x.source),
y as (select *, case when target > 0 then least(greatest(((case when passes >= 1 then e else lst end) - size / 2) / target, 0), 1) else 0 end y from f)
select doc_id, size, source_size, target, ((passes + (lst is not null)::bigint) * size)::bigint taken,
 (passes + (lst is not null)::bigint)::bigint copies,
 case when passes + (lst is not null)::bigint > 0 then round(case when target > 0 then 2 * y / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * y)) else 0 end, 9) end "position" from y
"""
