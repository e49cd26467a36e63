"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges`` that has a link to another node;
    ``root`` is the smallest node of its component. Null ends and loops are ignored.

    Each round points every node's larger neighbours at the smallest one it knows
    (large star), then every node and its smaller neighbours (small star). Minima are
    partial aggregates, so a node with a third of all links is never gathered; its
    links meet its minimum in a join that Spark can split. Each round is written to
    the shared folder; it ends when a round changes nothing."""
    x, y = F.col(a), F.col(b)
    e = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = stored(e, "links")
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select("v", "v")).distinct()
        seen = mark
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).union(e.select("v", "u"))
        low = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("x > n").join(low, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(low.select("u", "m")).distinct(), "links")
