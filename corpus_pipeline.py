"""A training-corpus pipeline: five stages, each one operator of ``bspgraph.llm`` applied to all that the stage before it kept.

Each stage is written as Parquet in the shared folder and read again, so a later stage never recomputes an earlier one and a lost
executor costs only its own tasks. All stages but the last return the columns of ``documents``.

Empty tables pass through every stage; null and empty texts are kept by the filters (they score the prior, have no shingles, no
windows and no benchmark words) and have no tokens; other columns pass through; each operator's module says how it treats ties,
repeated rows and nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph.llm.bpe import bpe_encode
from bspgraph.llm.decontaminate import contamination, small
from bspgraph.llm.neardup import without_near_duplicates
from bspgraph.llm.shared import few_files, fresh_path, materialize, stored_bytes
from bspgraph.llm.substring import remove_repeats
from bspgraph.llm.toxicity import held_out, train, without_toxic

#: A passage that stands in several places is cut out from this many words on, all its occurrences but the first.
PASSAGE_WORDS = 50
BENCHMARK_WORDS = 13


def compact(docs: DataFrame, out: DataFrame) -> DataFrame:
    """A stage's rows in files of no less than 32 MB of its input's."""
    return few_files(out, stored_bytes(docs), 32 << 20)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the model learns from labelled documents outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return compact(docs, without_toxic(spark, docs, train(spark, docs, labels), threshold=0.3))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: shingles of five words, similarity 0.8."""
    return compact(docs, without_near_duplicates(spark, docs, shingle=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document, or an earlier place, already holds."""
    out = remove_repeats(spark, docs, window=PASSAGE_WORDS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole benchmark window and without benchmark text that makes up a twentieth of them."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(spark, docs, benchmark, size=BENCHMARK_WORDS).where(F.col("contaminated") | (F.col("n_hit") >= BENCHMARK_WORDS))
    leaks = materialize(spark, found.select(F.col("doc_id").alias("leak"), "key").distinct(), "leaks")
    # An id, or a null one, may stand for clean and contaminated rows at once.
    match = docs["doc_id"].eqNullSafe(leaks["leak"]) & (F.xxhash64(docs["text"]) == leaks["key"])
    return compact(docs, docs.join(small(leaks, leaks.count()), match, "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) by the tokenization automaton."""
    import public_tokenizers

    out = bpe_encode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
    return compact(docs, out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]
#: A fitted classifier can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}", fresh_path(spark, f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
