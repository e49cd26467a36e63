"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.common import on_path, stored, table
from wardlens.llm.mixing import reorder
from wardlens.llm.packing import pack
from wardlens.llm.quality import keep_good
from wardlens.llm.simhash import keep_one
from wardlens.llm.substrings import remove_repeats

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the quality limits and their group's usual range; others go."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 4 or fewer bits."""
    on_path(spark)
    return keep_one(docs, shingle=4, seed=42, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 35-word windows that occur anywhere else; a
    text that loses words is rejoined by single spaces, others stay as they are."""
    on_path(spark)
    left = remove_repeats(docs, window=35)
    cut = F.col("repeats.kept").isNotNull()
    return left.select(*[
        F.coalesce("repeats.kept", "text").alias("text") if c == "text"
        else F.when(cut, F.length("repeats.kept")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of training position."""
    return reorder(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed into sequences of at most 4096 tokens."""
    on_path(spark)
    return pack(docs, TOKENIZER, cap=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sequence_packing", sequence_packing),
]

#: The fingerprints' hash, the covariance estimates and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
