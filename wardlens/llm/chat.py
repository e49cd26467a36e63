"""Chat formatting after cumulative-snapshot collapse.

Logged conversations often repeat an earlier snapshot with further turns. A turn's hash
covers its position, role and text; the running sum of a conversation's turn hashes is
the rolling hash of its prefix. A conversation whose whole-length hash is also the
prefix hash of a longer conversation is one of its snapshots and is dropped by an
anti-join; of equal conversations the one with the smallest id stays. Those left are
rendered.

Two independent 64-bit hashes are summed exactly as decimals, so sums can be formed in
any order: the turns are cut into ranges of (conversation, turn number, hash) of near-equal
rows, a conversation is numbered and summed inside each range, and the ranges' totals
give the offsets. So one with a third of all rows is not handled in one task, whatever
its turn numbers are. A rendered row holds at most ``block`` turns, cut by position, in
parts numbered from 0. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import stored


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  block: int = 256) -> DataFrame:
    """Distinct turns with their position (from 1), part, and prefix hashes p1 and p2."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                     F.col(text).alias("text")).where(F.col("conv_id").isNotNull())
    full = F.concat_ws("\x1f", F.col("role").isNull().cast("string"), "role", F.col("text").isNull().cast("string"), "text")
    t = t.withColumn("h", F.xxhash64(full)).dropDuplicates(["conv_id", "turn", "h"])
    # a given number of ranges, which adaptive execution does not read in another layout
    ranges = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartitionByRange(ranges, "conv_id", "turn", "h").withColumn("range", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "range").orderBy("turn", "h")
    t = stored(t.withColumn("at", F.row_number().over(inside).cast("long")), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    def with_before(df, **values):
        sums = df.groupBy("conv_id", "range").agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
        off = sums.select("conv_id", "range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(k) for k in values])
        return df.join(off, ["conv_id", "range"])

    t = with_before(t, before=F.lit(1)).withColumn("pos", F.col("before") + F.col("at"))
    wide = "decimal(38,0)"
    full = F.concat_ws("\x1f", F.col("pos").cast("string"), F.col("h").cast("string"), F.col("role"), F.col("text"))
    t = t.withColumns({"h1": F.xxhash64("pos", "role", "text").cast(wide),
                       "h2": F.conv(F.substring(F.md5(full), 1, 15), 16, 10).cast(wide)}).drop("before", "h")
    t = with_before(t, b1="h1", b2="h2")
    upto = Window.partitionBy("conv_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "turn", "role", "text", F.floor((F.col("pos") - 1) / block).cast("int").alias("part"), "pos",
                    (F.col("b1") + F.sum("h1").over(upto)).cast(wide).alias("p1"),
                    (F.col("b2") + F.sum("h2").over(upto)).cast(wide).alias("p2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no prefix of a longer one."""
    key = ["pos", "p1", "p2"]
    last = F.struct("pos", "p1", "p2")
    ends = prefixes.groupBy("conv_id").agg(F.max(last).alias("e")).select("conv_id", "e.*")
    ends = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    n = ends.select("conv_id", F.col("pos").alias("n_turns"))
    inner = prefixes.join(n, "conv_id").where("pos < n_turns").select(*key).distinct()
    return ends.join(inner, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"))


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = 256) -> DataFrame:
    """(conv_id, part, n_turns, chat): maximal conversations, rendered as
    ``<|role|>`` line, text and ``<|end|>`` line for each turn in order of turn number.

    Rows repeated in full are one turn; turns that share a number stand in hash order; a
    null turn number comes first; null roles render as ``unknown`` and null texts as
    empty; rows without a conversation id are dropped; an empty table gives no rows.
    ``part`` counts a conversation's blocks of ``block`` turns; ``n_turns`` is the whole
    conversation's. Other columns are not read."""
    p = stored(turn_prefixes(turns, conv, turn, role, text, block), "prefixes")
    kept = p.join(maximal(p), "conv_id")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")),
                    F.lit("\n<|end|>\n"))
    parts = kept.groupBy("conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))).alias("ls"))
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.col("ls.l"), "").alias("chat"))


ORACLE = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (select conv_id, list(struct_pack(turn := turn, role := role, text := text) order by turn) ts from t group by conv_id),
k as (select conv_id, ts, [coalesce(x.role, chr(0)) || chr(31) || coalesce(x.text, chr(0)) for x in ts] s from c),
one as (select min(conv_id) conv_id, s from k group by s),
pre as (select distinct s[1:n] s from (select s, unnest(range(1, len(s))) n from one))
select conv_id::bigint conv_id, (dense_rank() over (partition by conv_id order by x.turn // 256) - 1)::int part,
 len(s)::bigint n_turns,
 string_agg('<|' || coalesce(x.role, 'unknown') || '|>' || chr(10) || coalesce(x.text, '') || chr(10) || '<|end|>' || chr(10), ''
   order by x.turn) chat
from (select conv_id, s, unnest(ts) x from k join one using (conv_id, s) where s not in (select s from pre)) group by conv_id, s, x.turn // 256
"""
