"""Registered queries of the training-data operators, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from wardlens.llm import chat, codes, mixing, phrases
from wardlens.llm.chat import render
from wardlens.llm.codes import compress
from wardlens.llm.common import id_crc, table
from wardlens.llm.embeddings import near_vectors
from wardlens.llm.langid import fit, identify
from wardlens.llm.lm import score
from wardlens.llm.mixing import curriculum
from wardlens.llm.neighbours import nearest
from wardlens.llm.packing import pack
from wardlens.llm.phrases import mine
from wardlens.llm.quality import STATS, rate
from wardlens.llm.sharding import shard
from wardlens.llm.simhash import simhash_groups
from wardlens.llm.substrings import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op4_curriculum_mix": mixing.ORACLE,
    "op9_snapshot_chats": chat.ORACLE,
    "op11_gnat_codes": codes.ORACLE,
    "op12_phrase_growth": phrases.ORACLE,
    "op6_phrase_automata": r"""
with d as (select row_number() over () rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
i as (select rid, unnest(range(0, len(w) - 34)) i, w from d where len(w) >= 35),
x as (select rid, i, array_to_string(w[i + 1:i + 35], ' ') k from i),
r as (select rid, i from (select *, count(*) over (partition by k) n from x) where n > 1),
c as (select distinct rid, unnest(range(i, i + 35)) p from r),
l as (select rid, list(p) ps from c group by rid)
select doc_id, len(w)::bigint n_words, len(coalesce(ps, []))::bigint n_removed,
 sha256(array_to_string(case when ps is null then w
   else list_filter(w, lambda y, j: not list_contains(ps, j - 1)) end, ' ')) kept_sha256
from d left join l using (rid)""",
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 3 == 1
    got = identify(docs, fit(docs.where(~held_out)))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "shares")


@query
def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 4-word shingles, at most 4 differing bits."""
    return simhash_groups(table(spark, sf_dir, "documents"), shingle=4, seed=42, max_bits=4)


@query
def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of all words: weights 5, 2, 1, targets up to twice a source;
    sorted by range of the position at which a document is first trained on."""
    got = curriculum(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    got = got.withColumn("position", F.round(F.get("positions", F.lit(0)), 9))
    got = got.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return got.select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


@query
def op6_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur anywhere else."""
    got = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return got.select("doc_id", "repeats.n_words", "repeats.n_removed", "repeats.kept_sha256")


@query
def op3_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near-equal bytes, tokens and rows."""
    got = shard(table(spark, sf_dir, "documents"), shards=8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_snapshot_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return render(table(spark, sf_dir, "conversations"))


@query
def op5_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked within a label at cosine 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op7_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), corpus_pipeline.TOKENIZER, cap=4096, end_id=1)


@query
def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return rate(table(spark, sf_dir, "documents")).select("doc_id", *STATS, "base_failed", "kept", "distance")


@query
def op10_gated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model trained on nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc(F.col("doc_id")) % 10 == 0
    got = score(docs, ~held_out)
    return got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of four entries from codebooks of 256."""
    return compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


@query
def op12_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language over all documents."""
    return mine(table(spark, sf_dir, "documents"), top=2000, least=10, share=50)


@query
def op13_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every vector whose id is divisible by 50, among all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
