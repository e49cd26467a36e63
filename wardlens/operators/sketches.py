"""Mergeable column profiles (A9, A11): sketches per file, kept and merged later.

The exact profiles read a whole column again whenever a file is added. Here each file
leaves one small row per column: its counts, a HyperLogLog sketch of its distinct values
and, for numbers, a KLL sketch of their quantiles. Rows merge in any order, so a later
run sketches the new files alone and merges the rest from the store. Estimates are
opt-in: ``profile`` and ``ranking`` hold the exact forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

#: Relative standard error of a distinct count is about 1.04 / sqrt(2 ** LG_K): 1.6%.
LG_K = 12
#: KLL size: a quantile's rank is off by about 1.33% of the rows at most (99% confidence).
KLL_K = 200


def column_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """(by..., col_name, n_rows, n_present, distinct, quantiles): one row per column and
    value of ``by``, from one pass with partial aggregates. ``quantiles`` is null for a
    column that is not a number; a NaN counts as missing. Null values of ``by`` are a
    group; an empty table gives no rows (none but zero counts without ``by``)."""
    aggs = []
    for i, c in enumerate(cols):
        kind, x = df.schema[c].dataType, F.col(c)
        number = isinstance(kind, NumericType)
        if number:
            x = F.when(~F.isnan(x.cast("double")), x.cast("double"))
        aggs += [F.count(x).alias(f"_n{i}"), F.hll_sketch_agg(x.cast("string"), F.lit(lg_k)).alias(f"_d{i}")]
        if number:
            aggs.append(F.kll_sketch_agg_double(x, F.lit(k)).alias(f"_q{i}"))
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    have = set(wide.columns)
    rows = F.array(*[F.struct(
        F.lit(c).alias("col_name"), F.col("_rows").alias("n_rows"), F.col(f"_n{i}").alias("n_present"), F.col(f"_d{i}").alias("distinct"),
        (F.col(f"_q{i}") if f"_q{i}" in have else F.lit(None).cast("binary")).alias("quantiles")) for i, c in enumerate(cols)])
    return wide.select(*by, F.explode(rows).alias("_s")).select(*by, "_s.*")


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of each (by, column) as one. Counts and distinct counts are the same
    for any order of merging; quantiles differ within their bound, as KLL draws at random."""
    return sketches.groupBy(*by, "col_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("n_present"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def estimates(merged: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(..., n_rows, n_present, n_distinct, quantiles): what merged sketches say. The
    quantiles are null where a column is no number or has no value."""
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    some = (F.col("n_present") > 0) & F.col("quantiles").isNotNull() & (F.coalesce(F.kll_sketch_get_n_double("quantiles"), F.lit(0)) > 0)
    found = F.when(some, F.kll_sketch_get_quantile_double("quantiles", at))
    return merged.withColumns({"n_distinct": F.hll_sketch_estimate("distinct"), "quantiles": found}).drop("distinct")


def refresh(spark: SparkSession, data: str, store: str, schema: StructType | str, cols: Sequence[str]) -> DataFrame:
    """Merged sketches of all Parquet files under ``data``; the store at ``store`` keeps one
    row per file and column. Only files that the store does not know, by path and time of
    change, are read; rows of files that are gone or have changed take no part. A file
    without rows is read again each time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(data)
    files = files.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"))  # contents are not read
    kept = "file string, changed timestamp, col_name string, n_rows long, n_present long, distinct binary, quantiles binary"
    spark.createDataFrame([], kept).write.mode("append").parquet(store)  # so that a first run finds a table
    known = spark.read.schema(kept).parquet(store).where(F.col("col_name").isin(*cols))
    full = known.groupBy("file", "changed").agg(F.count_distinct("col_name").alias("_c")).where(F.col("_c") == len(set(cols)))
    new = [r["file"] for r in files.join(full, ["file", "changed"], "left_anti").collect()]  # one name per new file
    if new:
        rows = spark.read.schema(schema).parquet(*new).select(
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_changed"), *cols)
        made = column_sketches(rows, cols, ["_file", "_changed"])
        made.withColumnsRenamed({"_file": "file", "_changed": "changed"}).write.mode("append").parquet(store)
    now = spark.read.schema(kept).parquet(store).where(F.col("col_name").isin(*cols)).join(files, ["file", "changed"], "left_semi")
    return merge(now.dropDuplicates(["file", "changed", "col_name"]))
