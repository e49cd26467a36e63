"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.session import checkpoint_dir

#: A word is a maximal run of characters other than the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table lower-casing A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: The folder that holds the package.
HOME = str(Path(__file__).resolve().parents[2])


def on_path(spark: SparkSession) -> None:
    """Put the package's folder on the path of Python workers started from here on."""
    env = spark.sparkContext.environment
    if HOME not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (HOME, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    on_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor's later work re-reads the table instead of
    recomputing it, and every reader sees the same rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add: ``names``, lengthened where ``df`` has such a column."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Words of a text (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes (of no bytes for null)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; a null id counts as the empty text."""
    return crc32(doc_id.cast("string"))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: int = 64) -> DataFrame:
    """Add ``name``: each row's gapless number from 0 within ``group`` (no nulls there).

    No group is ordered in one task: rows fall into ``buckets`` by a hash of their
    ``order`` columns, the buckets' totals give offsets, and only a (group, bucket)
    is ordered. Equal rows are counted first and spread out again at the end, so a
    row repeated on a third of the table is one row in the windows."""
    cols = df.columns
    c = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    c = c.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = c.groupBy(*group, "_b").agg(F.sum("_n").alias("_t"))
    off = off.select(*group, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_b").orderBy(*order, *[x for x in cols if x not in order]).rowsBetween(
        Window.unboundedPreceding, -1)
    c = c.withColumn("_l", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = F.col("_o") + F.col("_l")
    return c.join(off, [*group, "_b"]).select(
        *cols, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(name))
