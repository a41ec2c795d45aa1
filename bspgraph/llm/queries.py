"""The registered queries of the ten operators: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text, learned from labels outside the held-out quarter."""
    from bspgraph.llm.toxicity import held_out, toxicity_scores, train

    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels").where(~held_out()))
    scores = toxicity_scores(spark, docs, model)
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text by the two-tier lookup."""
    from bspgraph.llm.token_counts import token_counts

    return token_counts(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k as chosen and 2k+1 as rejected of pair k."""
    from bspgraph.llm.preference import preference_pairs

    turns = table(spark, sf_dir, "conversations").withColumn("pair_id", F.expr("conv_id div 2"))
    return preference_pairs(turns.where("conv_id % 2 = 0"), turns.where("conv_id % 2 = 1"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked at a Jaccard similarity of 0.85 on 3-word shingles."""
    from bspgraph.llm.neardup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("key")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts along a Hilbert curve over language, source and size."""
    from bspgraph.llm.hilbert import hilbert_shards

    out = hilbert_shards(spark, table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after every repeated window of 20 words is removed but for its first occurrence."""
    from bspgraph.llm.substring import removal_digest

    return removal_digest(spark, table(spark, sf_dir, "documents"), window=20)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside any 13-word window of a benchmark item."""
    from bspgraph.llm.decontaminate import contamination

    out = contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=13)
    return out.drop("items", "key")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image in tar shards, read back and described."""
    from bspgraph.llm.media import media_columns

    out = media_columns(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text in files of independent frames, and what a reader finds there."""
    from bspgraph.llm.token_files import token_files

    return token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded by the automaton and decoded again."""
    from bspgraph.llm.bpe import bpe_round_trip

    return bpe_round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_preference_formatting, op4_minhash_near_dedup, op5_hilbert_sharding, op6_substring_dedup, op7_benchmark_decontamination, op8_media_columns, op9_token_files, op10_bpe_automaton)}


def oracle_sql() -> dict[str, str]:
    from bspgraph.llm import decontaminate, hilbert, neardup, preference, substring

    return {
        "op3_preference_formatting": preference.ORACLE, "op4_minhash_near_dedup": neardup.ORACLE, "op5_hilbert_sharding": hilbert.ORACLE,
        "op6_substring_dedup": substring.ORACLE, "op7_benchmark_decontamination": decontaminate.ORACLE,
    }
