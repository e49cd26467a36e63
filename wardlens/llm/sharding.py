"""Sharding by vector bin packing over bytes, tokens and rows.

Documents with equal texts form a group, placed together. The items placed are vectors
(bytes, tokens, rows), each as a share of its total:

* a group above 1 / (shards * ``fine``) of any total is an item of its own, cut into
  pieces by a hash of its documents if it is above that share several times, so a text
  that a third of all rows hold is spread;
* all other groups fall by a hash of their text into ``cells`` cells, one item each.

So there are at most cells + 6 * shards * fine items whatever the table's size. They go
to the driver, which places them from the largest down, each in the shard where the dot
product of the item with the shard's residual capacity is highest, and then swaps items
between the fullest and the emptiest shard as long as that evens out the bytes. The
placement goes back as a broadcast of that bounded size; rows meet their item by hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import crc32, n_words, numbered, stored


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``items``: shares of each total)."""
    shard = np.zeros(len(items), np.int64)
    left = np.full((shards, items.shape[1]), 1 / shards)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        s = int(np.argmax(left @ items[i]))
        shard[i] = s
        left[s] -= items[i]
    for _ in range(8 * len(items)):  # even out the bytes
        hi, lo = int(np.argmin(left[:, 0])), int(np.argmax(left[:, 0]))
        gap = (left[lo, 0] - left[hi, 0]) / 2
        a, b = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
        if gap <= 1e-6 / shards or not len(a):
            break
        # the move (b: none) or swap that brings the difference nearest to the gap
        bs = np.concatenate([[0.0], items[b, 0]])
        order = np.argsort(bs, kind="stable")
        at = np.clip(np.searchsorted(bs[order], items[a, 0] - gap), 1, len(bs) - 1) if len(bs) > 1 else np.zeros(len(a), int)
        near = np.stack([order[at - 1], order[at]]) if len(bs) > 1 else np.zeros((1, len(a)), int)
        miss = np.abs(items[a, 0] - bs[near] - gap)
        k, j = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[k, j] >= gap * (1 - 1e-9):
            break
        move = [(a[j], lo), *([(b[near[k, j] - 1], hi)] if near[k, j] else [])]
        for i, s in move:
            left[shard[i]] += items[i]
            left[s] -= items[i]
            shard[i] = s
    return shard


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", cells: int = 2048,
          fine: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes plus 1), text_crc32, shard
    and slot (gapless from 0 in the shard).

    A null text has no bytes and is a group with other null texts; null ids are allowed;
    repeated rows are rows of their own, equal ones interchangeable; an empty table gives
    no rows. Columns other than the two named are not read."""
    spark = docs.sparkSession
    t = F.col(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
                       n_words(t).alias("_tokens"), crc32(t).alias("text_crc32"),
                       F.coalesce(F.sha2(t, 256), F.lit("")).alias("_key"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = stored(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n"), "shard-rows")
    vector = [F.sum("size").alias("b"), F.sum("_tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    total = rows.agg(*vector).first()
    part = F.greatest(*[F.col(x) / F.lit(max(total[x] or 0, 1)) for x in "btr"]) * shards * fine
    heavy = rows.groupBy("_key").agg(*vector).withColumn("_parts", F.ceil(part)).where("_parts > 1").select("_key", "_parts")
    # at most 3 * shards * fine groups can be above that share
    rows = rows.join(F.broadcast(stored(heavy, "shard-heavy")), "_key", "left")
    cell = F.pmod(F.xxhash64("_key"), F.lit(cells)).cast("string")
    piece = F.concat_ws(":", "_key", F.pmod(F.xxhash64("doc_id", "_copy"), F.col("_parts")).cast("string"))
    rows = rows.withColumn("_item", F.when(F.col("_parts").isNull(), cell).otherwise(piece))
    items = rows.groupBy("_item").agg(*vector).toPandas().sort_values("_item")
    shares = items[["b", "t", "r"]].to_numpy(float) / [max(total[x] or 0, 1) for x in "btr"]
    placed = list(zip(items["_item"], place(shares, shards).tolist()))
    to = F.broadcast(spark.createDataFrame(placed, "_item string, shard int"))
    rows = rows.join(to, "_item").select("doc_id", "size", "text_crc32", "_copy", "shard")
    return numbered(rows, ["shard"], ["doc_id", "_copy", "size", "text_crc32"], "slot").drop("_copy")
