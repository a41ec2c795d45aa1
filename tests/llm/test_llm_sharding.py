"""Operator 5: the curve against its definition, the law against recounting."""

import itertools
import random
import zlib

import pytest
from llm_fixtures import documents
from pyspark.sql import functions as F

from bspgraph.llm.hilbert import hilbert_index, hilbert_shards
from bspgraph.llm.queries import op5_hilbert_sharding


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 1), (2, 4), (3, 1), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    """Every cell has one index, and consecutive indexes lie in cells one step apart."""
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    table = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(dims)))
    got = table.select(*table.columns, hilbert_index([F.col(c) for c in table.columns], bits).alias("h")).collect()
    by = {r.h: tuple(r)[:-1] for r in got}
    assert sorted(by) == list(range(1 << (bits * dims)))
    assert all(sum(abs(a - b) for a, b in zip(by[h], by[h + 1], strict=True)) == 1 for h in range(len(by) - 1))


def check(rows, shards, texts):
    """Size and crc of each row; shards one row apart; slots without a gap; shards are runs of the curve."""
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    held = {s: sorted((r for r in rows if r.shard == s), key=lambda r: r.slot) for s in range(shards)}
    assert sum(map(len, held.values())) == len(rows)
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    assert all([r.slot for r in x] == list(range(len(x))) for x in held.values())
    curve = [r.curve for s in range(shards) for r in held[s]]
    assert curve == sorted(curve)


@pytest.mark.parametrize("n", [0, 1, 5, 8, 9, 500])
def test_equal_counts(spark, n):
    rng = random.Random(n)
    texts = [(k, rng.choice(["", "same text", None, "é" * 40_000, f"own {k}"])) for k in range(n)]
    check(hilbert_shards(spark, documents(spark, texts), shards=8).collect(), 8, texts)


def test_ties_and_nulls(spark):
    texts = [(7, "same")] * 60 + [(None, "same")] * 3 + [(None, None)] * 5
    check(hilbert_shards(spark, documents(spark, texts), shards=8).collect(), 8, texts)


def test_metadata_prunes_files(spark):
    """Rows of one source lie in few shards although many values are interleaved in the input."""
    rows = [(k, "x" * (k * 37 % 3000), "en" if k % 2 else "de", f"s{k % 16:02d}") for k in range(3200)]
    out = hilbert_shards(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=16)
    spread = out.join(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id").groupBy("source").agg(F.count_distinct("shard").alias("n")).collect()
    assert sum(r.n for r in spread) / len(spread) <= 8


def test_query(spark, sf):
    rows = op5_hilbert_sharding(spark, sf).collect()
    check(rows, 8, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_plan_is_native(spark, sf):
    plan = op5_hilbert_sharding(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_values_with_one_beginning_fall_apart(spark):
    """Sources that share their first bytes still shape the curve."""
    rows = [(k, "same text", "en", f"https://site{k % 16:02d}.example") for k in range(320)]
    got = hilbert_shards(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=4)
    curves = {}
    for r in got.collect():
        curves.setdefault(r.doc_id % 16, set()).add(r.curve)
    assert all(len(c) == 1 for c in curves.values()) and len(set.union(*curves.values())) > 8


def test_query_against_sql(spark, sf):
    import duckdb

    from bspgraph.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = op5_hilbert_sharding(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op5_hilbert_sharding']})").fetchall()
    assert got == sorted(want, key=str)


def test_sql_on_odd_rows(spark, tmp_path):
    """Null ids, texts and metadata, repeated rows and fewer rows than shards."""
    import duckdb

    from bspgraph.llm import queries

    rows = [(None, None), (3, ""), (3, ""), (4, "é ß 漢 🙂"), (5, "x" * 5000)]
    docs = documents(spark, rows, clashing=False)
    for k, part in enumerate((docs, docs.where("doc_id = 4"), docs.where("false"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        df = op5_hilbert_sharding(spark, f"{tmp_path}/{k}")
        columns = sorted(df.columns)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/documents.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op5_hilbert_sharding']})").fetchall()
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)
