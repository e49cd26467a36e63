"""Readers and writers.

Every read names an explicit schema and projects only the wanted columns, so the
Parquet scan shows a pruned ``ReadSchema`` and filters written on raw columns are
pushed into it (``PushedFilters``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField,
    StructType, TimestampNTZType,
)


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, L, D, TS = StringType(), IntegerType(), LongType(), DoubleType(), TimestampNTZType()

SCHEMAS: dict[str, StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                        ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                        ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                        ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _schema(("vec_id", L), ("embedding", ArrayType(FloatType())), ("label", I)),
    "pages": _schema(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _schema(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None, nan_to_null: bool = True,
               where: Column | None = None) -> DataFrame:
    """Scan one table with its declared schema, keeping only ``columns``.

    Double columns have NaN turned into null (NaN sorts above every number and is
    not "missing" to Spark's aggregates), which is the reference's missing marker.
    ``where`` filters the raw columns first, so that it reaches the Parquet reader on
    doubles too (NaN counts as larger than any number there).
    """
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    if where is not None:
        df = df.where(where)
    if columns is not None:
        df = df.select(*columns)
    if nan_to_null:
        doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
        if doubles:
            df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return df


def read_parts(spark: SparkSession, paths: Iterable[str], fmt: str = "parquet",
               schema: StructType | None = None, **options) -> DataFrame:
    """Read a table delivered in several parts (files or folders) as one DataFrame."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(list(paths))


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Append parts by column name; a column missing in one part becomes null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Save a processed table. Categorical levels are plain strings, so a save is
    one Parquet write; ``partition_by`` gives directory pruning on re-read."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_json_map(spark: SparkSession, path: str, key_name: str = "key",
                  value_name: str = "value") -> DataFrame:
    """Load a JSON object ``{"k": "v", ...}`` (one document, possibly multi-line) as a
    two-column table; the result is a small dimension meant for a broadcast join."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json(F.col("value"), "map<string,string>")
    return raw.select(F.explode(m).alias(key_name, value_name))
