"""Operator 1: toxicity by a counterfactually regularised classifier.

The model is a logistic regression on the presence of words and word stems (the first 4, 5 and 6 bytes). It is fitted to a bounded
sample of labelled rows. For every labelled text that mentions an identity term, counterfactual texts swap the term for another of
its group, and the squared change of the score's logit is penalised: a mention alone can then not move a score, which keeps neutral
mentions of groups from being taken for abuse.

1. Sample: at most ``train_rows`` labelled rows, chosen by a hash of the id, are joined by a broadcast of that bounded id list.
2. Feature statistics: counts per feature, summed in each task before they are shuffled; the ``most_features`` features that set the
   classes apart most (at least ``least_z`` standard errors) are kept, and all identity terms.
3. Fit: the sample's kept features, a few dozen numbers a row, go to the driver, where L-BFGS runs.
4. Scores: one Arrow map over all whole texts with the broadcast weights.

Cases: null and empty texts score the intercept alone; without labelled rows of both classes every score is the share of label 1
(0 without rows); labels are one per id, the largest if there are several, nulls are ignored; repeated rows are scored each; an
empty table gives an empty result; scores use the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.shared import Scratch, bounded_batches
from bspgraph.llm.textops import BYTE_MIX, LOWER, WORD_BASE, Words, chunks, mix, powers, trimmed

#: Groups of identity terms; a counterfactual swaps a term for the others of its group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "natives"), ("old", "young"), ("blind", "deaf", "disabled"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
STEMS = (4, 5, 6)
#: Lower-cased letters, digits and bytes of multi-byte characters stay; all else is a space.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and stem, with repetitions."""
    words = Words(texts, table=LETTERS)
    length = words.end - words.start
    whole = words.hashes()
    rows, features = [words.doc], [whole]
    for size in STEMS:
        long = np.flatnonzero(length > size)
        h = np.full(len(long), size, np.uint64)
        base = powers(WORD_BASE, size + 1)
        for k in range(size):
            h += BYTE_MIX[words.data[words.start[long] + k]] * base[k]
        rows.append(words.doc[long])
        features.append(mix(h ^ np.uint64(0x57E4)))
    return np.concatenate(rows), np.concatenate(features)


def term_features(term: str) -> np.ndarray:
    return np.unique(text_features(pa.array([term]))[1])


def _statistics(batches):
    """Per chunk of (text, label): documents of each class that have a feature."""
    for batch in chunks(batches, 0, 2 << 20):
        row, feature = text_features(batch.column(0).fill_null(""))
        label = batch.column(1).to_numpy(zero_copy_only=False)
        pairs = np.unique(np.stack([feature, row.astype(np.uint64)], 1), axis=0) if len(row) else np.zeros((0, 2), np.uint64)
        names, inverse = np.unique(pairs[:, 0], return_inverse=True)
        toxic = label[pairs[:, 1].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(inverse, toxic, len(names)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(names)).astype(np.int64))], ["feature", "toxic", "n"])


def present(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index in the ascending vocabulary) of each kept feature, once a row, by row."""
    row, feature = text_features(texts)
    if not len(vocabulary) or not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, feature), len(vocabulary) - 1)
    hit = vocabulary[at] == feature
    pairs = np.unique(row[hit] * len(vocabulary) + at[hit])
    return pairs // len(vocabulary), pairs % len(vocabulary)


def _projected(table):
    def rows(batches):
        vocabulary = table.value
        for batch in chunks(batches, 0):
            row, at = present(batch.column(0).fill_null(""), vocabulary)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(at.astype(np.int32))), batch.column(1)], ["features", "label"])

    return rows


def minimise(value_and_slope, x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking."""
    f, g = value_and_slope(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        size = 1.0 if steps else 1 / max(1.0, np.linalg.norm(g))
        while size > 1e-10:
            new = x - size * q
            f2, g2 = value_and_slope(new)
            if f2 <= f - 1e-4 * size * (g @ q):
                break
            size /= 2
        else:
            break
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            steps = [*steps[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        x, f, g = new, f2, g2
        if done:
            break
    return x


def fit(rows: list[list[int]], labels: np.ndarray, size: int, swaps: list[tuple[list[int], list[int]]], penalty: float, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and intercept. ``swaps``: (features lost, features gained) by each counterfactual of a labelled row."""
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    s_row = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(swaps)]) if swaps else np.zeros(0, np.int64)
    s_col = np.concatenate([np.asarray([*a, *b], np.int64) for a, b in swaps]) if swaps else np.zeros(0, np.int64)
    s_sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in swaps]) if swaps else np.zeros(0)
    n = len(rows)

    def value_and_slope(x):
        w, b = x[:-1], x[-1]
        z = np.bincount(row, w[col], n) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = (np.logaddexp(0, z) - labels * z).sum() + ridge * (w @ w) / 2
        slope = np.bincount(col, (p - labels)[row], size) + ridge * w
        if len(swaps):
            change = np.bincount(s_row, s_sign * w[s_col], len(swaps))
            loss += penalty * (change @ change) / 2
            slope = slope + penalty * np.bincount(s_col, s_sign * change[s_row], size)
        return loss, np.append(slope, (p - labels).sum())

    share = labels.mean()
    x = minimise(value_and_slope, np.append(np.zeros(size), np.log(share / (1 - share))))
    return x[:-1], float(x[-1])


class ToxicityModel:
    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, intercept: float):
        self.vocabulary, self.weights, self.intercept = vocabulary, weights, intercept

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, at = present(texts, self.vocabulary)
        z = np.bincount(row, self.weights[at], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", train_rows: int = 20_000,
    most_features: int = 4096, least_z: float = 4.0, penalty: float = 4.0, ridge: float = 0.3, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
) -> ToxicityModel:
    """Fit a model to at most ``train_rows`` of the given labelled rows (the documented bound of the sample)."""
    bounded_batches(spark)
    scratch = Scratch(spark, "toxicity")
    known = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("label"))
    chosen = scratch.save(known.orderBy(F.xxhash64("id"), "id").limit(train_rows), "chosen")
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    sample = scratch.save(texts.join(F.broadcast(chosen), "id").select("text", "label"), "sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if toxic in (0, n):
        share = toxic / n if n else 0.0
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    share = toxic / n
    counts = sample.mapInArrow(trimmed(_statistics), "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("n >= 4")
    z = F.abs(F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    best = counts.select("feature", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most_features).collect()
    terms = {t: term_features(t) for g in groups for t in g}
    vocabulary = np.unique(np.concatenate([np.array([r["feature"] for r in best], np.int64).view(np.uint64), *terms.values()]))
    got = sample.mapInArrow(_projected(spark.sparkContext.broadcast(vocabulary)), "features array<int>, label int").collect()
    rows, y = [r["features"] for r in got], np.array([r["label"] for r in got], float)
    at = {t: [int(k) for k in np.searchsorted(vocabulary, f)] for t, f in terms.items()}
    swaps = []
    for own in map(set, rows):
        for group in groups:
            for term in (t for t in group if own.issuperset(at[t])):
                swaps += [(at[term], at[other]) for other in group if other != term]
    weights, intercept = fit(rows, y, len(vocabulary), swaps, penalty, ridge)
    return ToxicityModel(vocabulary, weights, intercept)


def toxicity_scores(spark: SparkSession, docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def rows(batches):
        for batch in chunks(batches, 1, 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(batch.column(1).fill_null("")))], ["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(trimmed(rows), schema).withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id"):
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def without_toxic(spark: SparkSession, docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more."""
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text.fill_null("")], ["text"])
        return pa.array(np.concatenate([held.value.scores(x.column(0)) for x in chunks([batch], 0, 2 << 20)] or [np.zeros(0)]))

    return docs.where(score(F.col(text_column)) < threshold)
