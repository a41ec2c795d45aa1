"""Operator 1: held-out accuracy, invariance to swapped identity terms, odd inputs."""

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import documents
from pyspark.sql import functions as F

from bspgraph.llm.queries import op1_toxicity
from bspgraph.llm.toxicity import fit, held_out, minimise, toxicity_scores, train, without_toxic

LABELS = "doc_id long, quality int, toxic int, text string, score string"


def labelled(spark, rows):
    return spark.createDataFrame([(i, 0, y, "x", "y") for i, y in rows], LABELS)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    """On the 10,000-document tables: labels of the held-out quarter are predicted without having been seen."""
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    got = op1_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").collect()
    score, said, label = (np.array([r[c] for r in rows], float) for c in ("score", "predicted", "toxic"))
    assert auc(score, label) > 0.95
    assert said[label == 1].mean() > 0.8
    assert (said == label).mean() > 0.9


def sentences():
    """Abuse comes with one group mostly, so that a plain model would blame its name."""
    bad, good = ["vile rubbish scum", "stupid filthy liars", "hateful vermin scum"], ["walked to the market", "cooked a pleasant dinner", "wrote a long letter"]
    rows, k = [], 0
    for n in range(40):
        for who, text, toxic in (("muslims", bad, 1), ("muslims", bad, 1), ("muslims", good, 0), ("christians", good, 0), ("jews", good, 0), ("christians", bad, 1 if n % 8 == 0 else None)):
            if toxic is not None:
                rows.append((k, f"the {who} {text[n % 3]} today", toxic))
                k += 1
    return rows


def test_swapped_terms_move_no_score(spark):
    rows = sentences()
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows]), labelled(spark, [(i, y) for i, _, y in rows])
    neutral = pa.array([f"the {who} walked to the market today" for who in ("muslims", "christians", "jews")])
    abusive = pa.array([f"the {who} vile rubbish scum today" for who in ("muslims", "christians", "jews")])
    plain = train(spark, docs, labels, least_z=1.0, penalty=0.0)
    fair = train(spark, docs, labels, least_z=1.0, penalty=20.0)
    assert np.ptp(fair.scores(neutral)) < 0.3 * np.ptp(plain.scores(neutral))
    assert (fair.scores(neutral) < 0.3).all()
    assert (fair.scores(abusive) > 0.7).all()


def test_slope_matches_the_value():
    """The fit is a minimum: no small step in any direction lowers the loss."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 12, 4)).tolist() for _ in range(60)]
    labels = np.array([float(0 in r or 1 in r) for r in rows])
    swaps = [([2], [3])] * 5
    w, b = fit(rows, labels, 12, swaps, 2.0, 0.5)

    def loss(w, b):
        z = np.array([w[r].sum() + b for r in rows])
        return (np.logaddexp(0, z) - labels * z).sum() + 0.25 * (w @ w) + sum(2.0 * (w[3] - w[2]) ** 2 / 2 for _ in swaps)

    at = loss(w, b)
    for k in range(12):
        for d in (-0.05, 0.05):
            x = w.copy()
            x[k] += d
            assert loss(x, b) > at
    assert loss(w, b + 0.05) > at and loss(w, b - 0.05) > at


def test_minimise():
    a = np.diag([1.0, 50.0, 400.0])
    x = minimise(lambda x: (0.5 * (x - 3) @ a @ (x - 3), a @ (x - 3)), np.zeros(3))
    assert np.allclose(x, 3, atol=1e-2)


def test_odd_rows(spark):
    rows = sentences()
    docs = documents(spark, [*[(i, t) for i, t, _ in rows], (9000, None), (9001, ""), (9002, "word " * 200_000), (None, "vile scum"), (5, rows[5][1]), (5, rows[5][1])])
    labels = labelled(spark, [*[(i, y) for i, _, y in rows], (None, 1), (3, None), (5, 0), (123456, 1)])
    model = train(spark, docs, labels, least_z=1.0)
    got = toxicity_scores(spark, docs, model)
    assert got.count() == docs.count()
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[9000] == by[9001] and all(0 <= x <= 1 for x in by.values())
    kept = without_toxic(spark, docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in by.items() if x < 0.3}


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class(spark, toxic):
    docs = documents(spark, [(k, f"text {k}") for k in range(8)])
    model = train(spark, docs, labelled(spark, [(k, toxic) for k in range(8)]))
    assert all(abs(r.score - toxic) < 1e-6 for r in toxicity_scores(spark, docs, model).collect())


def test_empty_tables(spark):
    none = labelled(spark, [])
    model = train(spark, documents(spark, []), none)
    assert toxicity_scores(spark, documents(spark, []), model).count() == 0
    assert without_toxic(spark, documents(spark, []), model).count() == 0
    some = toxicity_scores(spark, documents(spark, [(1, "text")]), train(spark, documents(spark, [(1, "text")]), none)).collect()
    assert some[0].score < 1e-6


def test_held_out_ids(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(200).select("id", held_out("id").alias("h")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 == 2 for k in range(200)}
    assert spark.createDataFrame([(None,)], "doc_id long").select(held_out().alias("h")).first().h is False


def test_scores_use_texts_alone(spark):
    rows = sentences()
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows]), labelled(spark, [(i, y) for i, _, y in rows])
    model = train(spark, docs, labels, least_z=1.0)
    one = {r.doc_id: r.score for r in toxicity_scores(spark, docs, model).collect()}
    other = {r.doc_id: r.score for r in toxicity_scores(spark, docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 10**6), model).collect()}
    assert one == {i - 10**6: x for i, x in other.items()}
