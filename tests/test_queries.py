"""Every engine query against its DuckDB oracle on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from bspgraph import queries  # noqa: E402


def rows(columns, values):
    return sorted((tuple(v) for v in values), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_against_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows(columns, ([r[c] for c in columns] for r in df.collect())) == rows(columns, con.execute(f"SELECT {listed} FROM ({queries.oracle_sql()[name]})").fetchall())
