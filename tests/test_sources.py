import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bspgraph.model import PropertyGraph, upsert, with_sources
from bspgraph.operators.partitioning import HIGHEST, LOWEST, TokenRange, in_ring_range, located, partition_count, range_table, ring_cut, ring_number, ring_ranges, ring_table, round_half_away, scan_range, split_range, token
from bspgraph.sources.dimacs import edge_reader, parse_edges, parse_vertices, vertex_reader
from bspgraph.sources.store import open_store, register_store

LINES = {
    "c comment": (None, None), "": (None, None), "p sp 3 4": (None, None), "v 1 -5 7": (("1", -5, 7), None), "v 1 99999999999 7": (None, None),
    "a 1 2 15": (None, ("1", "2", 15)), "a 1 2 +7": (None, ("1", "2", 7)), "a 1 2 -5": (None, ("1", "2", -5)), "a  1 2 3": (None, None), "a 1 2 x": (None, None),
    "a 1 2 1.5": (None, None), "a 1 2": (None, None), "abc 1 2 3": (None, ("1", "2", 3)), "a 1 2 3\r": (None, ("1", "2", 3)), "a 1 2  3": (None, None), "a 1 2 ": (None, None),
}


@pytest.mark.parametrize("line", LINES)
def test_lines(spark, line):
    df = spark.createDataFrame([(line,)], "value string")
    v = [(r["id"], r["value"]["x"], r["value"]["y"]) for r in parse_vertices(df).collect()]
    e = [tuple(r) for r in parse_edges(df).collect()]
    assert (v, e) == tuple([x] if x else [] for x in LINES[line])


def model(line, mark, kinds):
    t = line.removesuffix("\r").split(" ")
    if line[:1] != mark or len(t) != 4:
        return None
    out = []
    for x, bits in zip(t[4 - len(kinds) :], kinds, strict=True):
        sign = x[1:] if x[:1] in ("+", "-") else x
        if not (sign.isascii() and sign.isdigit()) or not -(2 ** (bits - 1)) <= int(x) < 2 ** (bits - 1):
            return None
        out.append(int(x))
    return (*t[1 : 4 - len(kinds)], *out)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("av 0123456789+-x\r"), max_size=14), min_size=30, max_size=60))
def test_parser_fuzz(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    want_v, want_e = ([m for m in (model(x, k, b) for x in lines) if m] for k, b in (("v", (32, 32)), ("a", (64,))))
    assert sorted((r["id"], r["value"]["x"], r["value"]["y"]) for r in parse_vertices(df).collect()) == sorted(want_v)
    assert sorted(map(tuple, parse_edges(df).collect())) == sorted(want_e)


def test_readers_by_name(spark, tmp_path):
    (tmp_path / "g.txt").write_bytes(b"c x\nv 1 2 3\r\na 1 2 4\n")
    assert vertex_reader("dimacs")(spark, str(tmp_path)).count() == 1 and edge_reader("dimacs")(spark, str(tmp_path)).count() == 1
    for reader in (vertex_reader, edge_reader):
        with pytest.raises(ValueError):
            reader("other")


def test_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", None, 2), ("b", None, 1)], "id string, value bigint, seq int")
    assert sorted(tuple(r) for r in upsert(df, ["id"], [F.col("seq")]).select("id", "value").collect()) == [("a", 2), ("b", None)]


def test_sources_become_vertices(spark):
    v = spark.createDataFrame([("a", 1)], "id string, value bigint")
    e = spark.createDataFrame([("b", "c", 1), ("a", "a", 1)], "src string, dst string, value bigint")
    assert sorted(tuple(r) for r in with_sources(v, e).collect()) == [("a", 1), ("b", None)]
    g = PropertyGraph.of(v, e)
    assert [tuple(r) for r in g.neighbours().orderBy("id").collect()] == [("a", ["a"]), ("b", ["c"])]
    assert g.has_vertices(spark.createDataFrame([("b",), ("c",)], "id string")).count() == 1
    assert g.has_edges(spark.createDataFrame([("b", "c"), ("c", "b")], "src string, dst string")).count() == 1


def test_store(spark, tmp_path):
    store = open_store(spark, "Parquet", {"directory": f"{tmp_path}/s", "edges": "arcs"})
    v = lambda *rows: spark.createDataFrame(list(rows), "id string, value bigint")
    store.save_vertices(v(("a", 1), ("b", 2)))
    store.save_vertices(v(("a", 9), ("c", None)))
    store.save_vertices(spark.createDataFrame([("d", 1, 2), ("d", 5, 1)], "id string, value bigint, seq int"))
    assert sorted(tuple(r) for r in store.load_vertices().collect()) == [("a", 9), ("b", 2), ("c", None), ("d", 1)]
    assert sum(store.load_vertices(r).count() for r in ring_ranges(3)) == 4 and store.row_count("vertices") == 4
    store.save_edges(spark.createDataFrame([("a", "b", 1)], "src string, dst string, value bigint"))
    assert [tuple(r) for r in store.load_edges().collect()] == [("a", "b", 1)] and (tmp_path / "s/arcs").exists()
    m = spark.createDataFrame([("a", "j", 1, 5), ("a", "j", 1, 5), ("a", "j", 2, 6)], "`to` string, job_id string, superstep int, value bigint")
    store.save_vertex_messages(m)
    assert store.load_vertex_messages("j", 1).count() == 2 and store.load_vertex_messages("k", 1).count() == 0
    h = spark.createDataFrame([("a", "j", 1), ("a", "j", 1)], "id string, job_id string, superstep int")
    store.save_halted_vertices(h)
    store.save_halted_vertices(h)
    assert [r["id"] for r in store.load_halted_vertices("j", 1).collect()] == ["a"]
    store.save_vertex_operations(spark.createDataFrame([("a", "j", 1, 1, 3)], "id string, job_id string, superstep int, type int, value bigint"))
    store.save_edge_operations(spark.createDataFrame([("a", "b", "j", 2, 1, 3)], "src string, dst string, job_id string, superstep int, type int, value bigint"))
    assert store.load_vertex_operations("j", 1).count() == store.load_edge_operations("j", 2).count() == 1 and store.load_edge_operations("j", 1).count() == 0
    assert len(store.vertex_ranges(2)) == 2
    with pytest.raises(ValueError):
        open_store(spark, "none", {})
    with pytest.raises(ValueError):
        register_store("Parquet", None)


def test_ranges(spark):
    ids = spark.range(500).select(F.concat(F.lit("v"), "id").alias("id"))
    for n in (1, 2, 7):
        parts = [scan_range(ids, "id", r).select("id").collect() for r in ring_ranges(n)]
        assert sum(map(len, parts)) == len({r["id"] for p in parts for r in p}) == 500
    around, inside = TokenRange(2**62, -(2**62)), TokenRange(-(2**62), 2**62)
    assert scan_range(ids, "id", around).count() + scan_range(ids, "id", inside).count() == 500
    assert scan_range(ids, "id", TokenRange(5, 5)).count() == 500  # a single token is the full ring, once
    assert sum(scan_range(ids, "id", r).count() for r in split_range(TokenRange(LOWEST, LOWEST), 500, 1.0, 100)) == 500
    assert split_range(TokenRange(0, 9), 10, 0.1, 100) == [TokenRange(0, 9)]
    assert TokenRange(LOWEST, HIGHEST).parts() == [(LOWEST, HIGHEST)]
    assert [round_half_away(x) for x in (2.5, -2.5, 2.4, 0)] == [3, -3, 2, 0] and partition_count(10, 1000) == 1 and partition_count(2500, 1000) == 3


def test_located_agrees_with_the_predicates(spark):
    ids = spark.range(300).select(F.concat(F.lit("v"), "id").alias("id"))
    for ranges in ([TokenRange(5, 5)], ring_ranges(1), ring_ranges(6), [TokenRange(2**62, -(2**62)), TokenRange(0, 2**61)], []):
        got = {r["id"]: r["range_id"] for r in located(ids, "id", ranges).collect()}
        want = dict.fromkeys(got)
        for k, r in enumerate(ranges):
            want |= {x["id"]: k + 1 for x in scan_range(ids, "id", r).collect()}
        assert got == want
    assert [tuple(r) for r in range_table(spark, ring_ranges(1)).collect()] == [(1, LOWEST, LOWEST)]


def test_ring_numbers_agree_with_the_ranges(spark):
    """ranges by arithmetic, on every cut and beside it, for few and for many ranges."""
    for n in (1, 2, 3, 7, 64, 1000, 2**31 - 1):
        some = range(n) if n <= 1000 else [0, 1, 2, n // 3, n // 2, n - 2, n - 1]
        starts = {k: LOWEST + 2**64 * k // n for k in some}
        cuts = {r["k"]: r["c"] for r in spark.createDataFrame([(k,) for k in some], "k bigint").select("k", ring_cut(F.col("k"), n).alias("c")).collect()}
        assert cuts == starts
        tokens = sorted({t for c in [*starts.values(), HIGHEST, 0] for t in (c - 1, c, c + 1) if LOWEST <= t <= HIGHEST})
        got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t bigint").coalesce(1).select(ring_number(F.col("t"), n)).collect()]
        assert got == [max(0, -(-(t - LOWEST) * n // 2**64) - 1) for t in tokens]
        if n <= 1000:
            want = [(k + 1, r.start, r.end) for k, r in enumerate(ring_ranges(n))]
            assert sorted(tuple(r) for r in ring_table(spark, n).collect()) == want
            if n > 1:
                assert all(want[k][1] < t <= want[k][2] or t == want[k][1] == LOWEST for k, t in zip(got, tokens, strict=True))
            near = spark.createDataFrame([(t, k + d) for k, t in zip(got, tokens, strict=True) for d in (-1, 0, 1)], "t bigint, k bigint")
            assert [r[0] for r in near.coalesce(1).select(in_ring_range(F.col("t"), F.col("k"), n)).collect()] == [False, True, False] * len(tokens)
    with pytest.raises(ValueError):
        ring_number(F.col("t"), 2**31)


def test_ranges_scanned_at_a_cost_that_does_not_grow_with_them(spark, tmp_path):
    """one comparison a range made plans of ranges times their size; 50,000 vertices are 500 ranges."""
    from bspgraph.queries import q31_ranges

    spark.range(1000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(49_000).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    out = q31_ranges(spark, str(tmp_path))
    spark.conf.set("spark.sql.debug.maxToStringFields", 100_000)
    try:
        assert out._jdf.queryExecution().analyzed().toString().count("<=") < 100
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert tuple(out.first()) == (500, 50_000, 50_000)


def test_located_among_thousands_of_ranges(spark):
    """a tree of as many comparisons takes the driver's memory."""
    ids = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("id"))
    whole = ring_ranges(5000)
    wide = [TokenRange(0, 2**61), *[TokenRange(2**61 + 10**6 * k, 2**61 + 10**6 * (k + 1)) for k in range(900)], TokenRange(2**62, -(2**62))]
    for ranges in (whole, whole[::3], wide):
        got = {r["id"]: (r["t"], r["range_id"]) for r in located(ids, "id", ranges).withColumn("t", token(F.col("id"))).collect()}
        assert len(got) == 3000
        for t, k in got.values():
            assert (k is None) == (not any((a < t or a == t == LOWEST) and t <= b for r in ranges for a, b in r.parts()) if ranges is not whole else False)
            assert k is None or any((a < t or a == t == LOWEST) and t <= b for a, b in ranges[k - 1].parts())


def test_a_cap_on_files(spark, tmp_path):
    store = open_store(spark, "Parquet", {"directory": f"{tmp_path}/s", "max_records_per_file": 10})
    store.save_vertices(spark.range(35).select(F.col("id").cast("string").alias("id"), F.col("id").alias("value")).coalesce(1))
    files = list((tmp_path / "s/vertices").rglob("*.parquet"))
    assert len(files) >= 4 and store.row_count("vertices") == 35


def test_storage_outside_local_mode_needs_a_shared_folder():
    from types import SimpleNamespace

    from bspgraph.storage import shared_root

    context = SimpleNamespace(isLocal=lambda: False, getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: context)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_root(session)
