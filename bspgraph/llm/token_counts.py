"""Operator 2: token counts by a map-side two-tier lookup.

Tier one is a broadcast table from frequent pre-tokens to their token counts, those that are at least one in ``table_size`` of the
corpus. Tier two is a bounded cache in each worker; a pre-token found in neither is encoded once by the tokenizers library. No
pre-token of a text is ever shuffled: counting is one scan and one Arrow map. The table comes from a scan before it, in which each
task sums up its own texts and sends its frequent pre-tokens alone.

Cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows are counted each;
an empty table gives an empty result; columns other than the two named ones are ignored unless listed in ``keep``.
"""

from __future__ import annotations

import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.pretokens import BytePretokens, library
from bspgraph.llm.shared import Scratch, bounded_batches
from bspgraph.llm.textops import chunks, gathered, string_buffers, trimmed

#: Pre-tokens longer than this are encoded without being cached.
LONG = 48
_caches: dict[str, dict[str, int]] = {}


def count_pretokens(pieces: list[list[str]], frequent: dict[str, int], path: str, most: int) -> list[int]:
    """Token counts of split texts by the two tiers."""
    cache = _caches.setdefault(path, {})
    if len(cache) > most:
        cache.clear()
    new = set(itertools.chain.from_iterable(pieces))
    new = [x for x in new if x not in frequent and x not in cache]
    once = {}
    if new:
        for x, got in zip(new, library(path).encode_batch_fast(new, add_special_tokens=False), strict=True):
            (cache if len(x) <= LONG else once)[x] = len(got.ids)

    def one(x: str) -> int:
        n = frequent.get(x)
        if n is None:
            n = cache.get(x)
            if n is None:
                n = once[x]
        return n

    return [sum(map(one, x)) for x in pieces]


def _summaries(path: str, table_size: int, most: int = 250_000):
    """Per task: pre-tokens that are at least one in ``table_size`` of its own with their counts; the number of all goes under a null one."""

    def rows(batches):
        split, seen, total = BytePretokens(path).split, Counter(), 0
        for batch in chunks(batches, 0):
            for text in batch.column(0).to_pylist():
                pieces = split(text)
                total += len(pieces)
                seen.update(pieces)
            if len(seen) > most:  # the rarer half has no place in the table
                seen = Counter(dict(seen.most_common(most // 2)))
        kept = [(x, n) for x, n in seen.items() if n > 1 and n * table_size >= total and len(x) <= LONG]
        yield pa.RecordBatch.from_arrays([pa.array([None, *(x for x, _ in kept)], pa.string()), pa.array([total, *(n for _, n in kept)], pa.int64())], ["piece", "n"])

    return rows


def frequent_table(spark: SparkSession, docs: DataFrame, text: str, path: str, table_size: int) -> dict[str, int]:
    """Token counts of the pre-tokens that are at least one in ``table_size`` of the whole corpus, so of no more than that many.

    All texts are counted, and only the tasks' summaries move. What a summary leaves out is encoded: the table bears on speed alone.
    """
    scratch = Scratch(spark, "pretokens")
    texts = docs.select(F.col(text).alias("t")).where(F.octet_length("t") > 0)
    counts = scratch.save(texts.mapInArrow(trimmed(_summaries(path, table_size)), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("piece IS NULL").first()
    words = [r["piece"] for r in counts.where(F.col("piece").isNotNull() & (F.col("n") * table_size >= total["n"])).collect()] if total else []
    scratch.drop(counts)
    got = library(path).encode_batch_fast(words, add_special_tokens=False) if words else []
    return {x: len(y.ids) for x, y in zip(words, got, strict=True)}


def token_counts(
    spark: SparkSession, docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    limit: int | None = None, table_size: int = 1 << 18, cache_size: int = 400_000,
) -> DataFrame:
    """(id, n_bytes, n_tokens[, over_limit]) of every whole text."""
    bounded_batches(spark)
    table = spark.sparkContext.broadcast(frequent_table(spark, docs, text_column, tokenizer, table_size))
    id_type = docs.schema[id_column].dataType

    def count(batches):
        split, frequent = BytePretokens(tokenizer).split, table.value
        for batch in chunks(gathered(batches, 1, 4 << 20), 1):
            texts = batch.column(1).fill_null("")
            sizes = string_buffers(texts)[1]
            n = count_pretokens([split(x) for x in texts.to_pylist()], frequent, tokenizer, cache_size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes[1:] - sizes[:-1], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(trimmed(count), schema)
    columns: list[Column] = [F.col("id").alias(id_column), F.col("n_bytes"), F.col("n_tokens")]
    if limit is not None:
        columns.append((F.col("n_tokens") > limit).alias("over_limit"))
    return out.select(*columns)
