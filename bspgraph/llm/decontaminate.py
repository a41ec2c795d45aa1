"""Operator 7: benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

``build_index`` turns the corpus into postings (term, doc, pos) of the terms that the test windows are looked up by: for every
window its ``rarest`` terms of the corpus, ties by position. Postings are stored as a table in the shared folder.
``phrase_candidates`` shifts each posting by the term's offset in a window and intersects the shifted lists: a start that every
list names survives. ``verified`` compares survivors with the words of their documents, so hits are exact.
``proximity_matches`` reports documents that hold a window's looked-up terms near each other in any order.

Frequencies count only terms of the benchmark. The benchmark's vocabulary, its windows and the ids of candidate documents are
broadcast while their counted rows stay below a limit and joined by shuffle beyond it.

Cases: null and empty texts have no words; items without words have no windows; an item of fewer words than a window is one
window; repeated rows are judged each; repeated windows and items count once per item id; a null id of a document or an item is
an id like any other (a null item id is left out of digests); an empty corpus gives an empty result and an empty benchmark gives
rows without hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bspgraph.llm.shared import Scratch

BROADCAST_ROWS = 500_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def test_windows(benchmark: DataFrame, item_column: str, text_column: str, size: int) -> DataFrame:
    """(item, phrase, terms) of every window of every item, each distinct one once."""
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), word_array(F.col(text_column)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = items.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(size)).alias("terms"))
    return cut.select("item", F.concat_ws(" ", "terms").alias("phrase"), "terms").distinct()


class PositionalIndex:
    """Postings and look-up terms of one benchmark against one corpus; ``postings`` is a stored table (term, doc, pos)."""

    def __init__(self, spark, docs, benchmark, size, rarest, id_column, text_column, item_column, item_text):
        self.scratch = Scratch(spark, "index")
        self.docs = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
        self.windows = self.scratch.save(test_windows(benchmark, item_column, item_text, size), "windows")
        phrases = self.windows.select("phrase", "terms").distinct()
        # Phrases go by number from here on; the stored table fixes the numbers.
        self.phrases = self.scratch.save(phrases.withColumn("pid", F.monotonically_increasing_id()), "phrases")
        terms = self.phrases.select("pid", F.posexplode("terms").alias("off", "term"))
        vocabulary = self.scratch.save(terms.select("term").distinct(), "vocabulary")
        n = vocabulary.count()
        words = self.docs.select(F.explode(word_array(F.col("text"))).alias("term"))
        counts = self.scratch.save(words.join(small(vocabulary, n), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")), "counts")
        self.rarest, self.ranks = rarest, terms.join(small(counts, n), "term", "left")
        # A window with a term that the corpus lacks can't occur.
        ranked = self.ranks.groupBy("pid").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("n", "off", "term"))), 1, rarest).alias("low"), F.count_if(F.col("n").isNull()).alias("absent")
        )
        listed = F.transform("low", lambda x, k: F.struct(x["off"].alias("off"), x["term"].alias("term"), F.call_function("shiftleft", F.lit(1), k).alias("bit")))
        lookups = ranked.where("absent = 0").select("pid", F.size("low").alias("k"), F.inline(listed))
        self.lookups = self.scratch.save(lookups, "lookups")
        self.n_lookups = self.lookups.count()
        chosen = self.lookups.select("term").distinct()
        postings = self.docs.select(F.xxhash64("text").alias("key"), "doc", F.posexplode(word_array(F.col("text"))).alias("pos", "term"))
        self.postings = self.scratch.save(postings.join(small(chosen, self.n_lookups), "term", "left_semi").select("term", "doc", "key", "pos"), "postings")

    def phrase_candidates(self) -> DataFrame:
        """(doc, key, pid, start): starts that the shifted lists of all look-up terms of a phrase agree on."""
        shifted = self.postings.join(small(self.lookups, self.n_lookups), "term").select("doc", "key", "pid", "k", (F.col("pos") - F.col("off")).alias("start"), "bit").where("start >= 0")
        agreed = shifted.groupBy("doc", "key", "start", "pid").agg(F.bit_or("bit").alias("lists"), F.max("k").alias("k"))
        return agreed.where(F.bit_count("lists") == F.col("k")).select("doc", "key", "pid", "start")

    def proximity_matches(self, slop: int) -> DataFrame:
        """(doc, item, first, last): the shortest stretches that hold all look-up terms of a window within ``slop`` words of one another, in any order.

        Look-up terms are here the window's ``rarest`` different terms of the corpus, whether or not the corpus has its others; a
        window of several terms of which the corpus has one says nothing about nearness and is left out. Each posting is judged by
        the nearest one before it of every other term, in one scan of the document's sorted postings.
        """
        present = F.array_sort(F.collect_set(F.when(F.col("n").isNotNull(), F.struct("n", "term"))))
        lists = self.ranks.groupBy("pid").agg(F.slice(present, 1, self.rarest).alias("low"), F.count_distinct("term").alias("terms"))
        lists = lists.where(F.size("low") >= F.least(F.lit(2), "terms", F.lit(self.rarest)))
        lookups = self.scratch.save(lists.select("pid", F.size("low").alias("k"), F.posexplode("low.term").alias("slot", "term")), "near")
        n = lookups.count()
        chosen = lookups.select("term").distinct()
        words = self.docs.select("doc", F.xxhash64("text").alias("key"), F.posexplode(word_array(F.col("text"))).alias("pos", "term"))
        at = words.join(small(chosen, n), "term", "left_semi").join(small(lookups, n), "term")
        until = Window.partitionBy("doc", "key", "pid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latest = F.array(*[F.max(F.when(F.col("slot") == j, F.col("pos"))).over(until) for j in range(self.rarest)])
        seen = at.select("doc", "key", "pid", "k", "pos", F.slice(latest, F.lit(1), F.col("k")).alias("latest"))
        near = seen.where(~F.exists("latest", lambda x: x.isNull())).select("doc", "key", "pid", F.array_min("latest").alias("first"), F.col("pos").alias("last"))
        near = near.where(F.col("last") - F.col("first") <= slop).groupBy("doc", "key", "pid", "first").agg(F.min("last").alias("last"))
        return near.join(self.phrases.select("pid", "phrase"), "pid").join(self.windows.select("phrase", "item"), "phrase").select("doc", "item", "first", "last").distinct()


def contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 13, rarest: int = 2, id_column: str = "doc_id",
    text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, items, key) of every document, key being the text's xxhash64."""
    index = PositionalIndex(spark, docs, benchmark, size, rarest, id_column, text_column, item_column, item_text)
    found = index.phrase_candidates().groupBy("doc", "key", "pid").agg(F.collect_list("start").alias("starts"))
    found = index.scratch.save(found, "candidates")
    ids = index.scratch.save(found.select("doc", "key").distinct(), "ids")
    rows = ids.count()
    keyed = index.docs.select("doc", F.xxhash64("text").alias("key"), "text")
    on = keyed["doc"].eqNullSafe(ids["doc"]) & (keyed["key"] == ids["key"])
    texts = keyed.join(small(ids, rows), on, "left_semi").dropDuplicates(["doc", "key"]).select("doc", "key", word_array(F.col("text")).alias("w"))
    n_phrases = index.phrases.count()
    found = found.join(small(index.phrases.select("pid", "phrase"), n_phrases), "pid")
    c, t = found.alias("c"), texts.alias("t")
    at = c.join(t, F.col("c.doc").eqNullSafe(F.col("t.doc")) & (F.col("c.key") == F.col("t.key")))
    n = F.size(F.split("c.phrase", " "))
    true = F.filter("c.starts", lambda s: F.concat_ws(" ", F.slice(F.col("t.w"), s + 1, n)) == F.col("c.phrase"))
    hits = index.scratch.save(at.select("c.doc", "c.key", "c.pid", "c.phrase", n.alias("n"), true.alias("starts")).where(F.size("starts") > 0), "hits")
    spans = hits.groupBy("doc", "key").agg(F.array_sort(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("a"), (s + F.col("n")).alias("b")))))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    union = F.aggregate("spans", zero, lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["hit"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0))).alias("hit")))
    n_windows = index.windows.count()
    items = hits.select("doc", "key", "phrase").join(small(index.windows.select("phrase", "item"), n_windows), "phrase").groupBy("doc", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = spans.select("doc", "key", union["hit"].cast("long").alias("n_hit")).join(items.withColumnsRenamed({"doc": "d2", "key": "k2"}), F.col("doc").eqNullSafe(F.col("d2")) & (F.col("key") == F.col("k2"))).select("doc", "key", "n_hit", "items")
    sizes = index.docs.select("doc", F.xxhash64("text").alias("key"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    a, m = sizes.alias("a"), marks.alias("m")
    out = a.join(m, F.col("a.doc").eqNullSafe(F.col("m.doc")) & (F.col("a.key") == F.col("m.key")), "left")
    hit, names = F.coalesce("m.n_hit", F.lit(0).cast("long")), F.coalesce("m.items", F.array().cast("array<string>"))
    return out.select(
        F.col("a.doc").alias(id_column), "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), names.alias("items"), F.col("a.key").alias("key"),
    )


#: The query op7 in DuckDB SQL.
ORACLE = r"""
WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item, len(w[s : s + 12]) AS k, array_to_string(w[s : s + 12], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT k FROM phrases),
dw AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM t, sizes),
found AS (SELECT doc_id, item, s, dw.k FROM dw JOIN phrases ON dw.k = phrases.k AND array_to_string(w[s : s + dw.k - 1], ' ') = g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM t LEFT JOIN hit ON t.doc_id = hit.doc_id LEFT JOIN items ON t.doc_id = items.doc_id
"""
