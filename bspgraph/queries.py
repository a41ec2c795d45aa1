"""The engine's registered queries over the driver's tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph import testgraphs as tg
from bspgraph.functions.aggregators import AggregatorSet, aggregator_type
from bspgraph.model import OpType, PropertyGraph, upsert, with_sources
from bspgraph.operators.messages import combine, deliver, is_active, missing_targets, send_along_edges
from bspgraph.operators.mutations import apply_mutations, replay
from bspgraph.operators.partitioning import in_ring_range, partition_count, ring_number, token
from bspgraph.plans.algorithms import count_graph
from bspgraph.plans.program import Context, Contribution, Effects, SendAlong, VertexProgram, program
from bspgraph.plans.superstep import DealtEdges, SuperstepLoop, run_program
from bspgraph.sources.dimacs import parse_edges, parse_vertices
from bspgraph.storage import Workspace

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Shared beginnings of the oracles. G1: supply both ways; G2: nations; G3: supplier to part only.
G1 = """
e1 AS (SELECT l_suppkey AS s, l_partkey AS p, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2),
e AS (SELECT 'S' || s AS src, 'P' || p AS dst, w FROM e1 UNION ALL SELECT 'P' || p, 'S' || s, w FROM e1),
v AS (SELECT 'S' || s_suppkey AS id FROM supplier UNION ALL SELECT 'P' || p_partkey FROM part)
"""
G2 = """
e AS (SELECT 'N' || c_nationkey AS src, 'N' || s_nationkey AS dst, CAST(min(l_quantity) AS BIGINT) AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
v AS (SELECT 'N' || n_nationkey AS id FROM nation)
"""
#: Best distance per id over 1 to 14 hops from a source. The frontier keeps only what improves nothing but its own hop, which min() later settles.
PATHS = """
r(hop, id, d) AS (
  SELECT 1, dst, min(w) FROM e WHERE src = '{source}' GROUP BY dst
  UNION ALL
  SELECT r.hop + 1, e.dst, min(r.d + e.w) FROM r JOIN e ON e.src = r.id WHERE r.hop < 14 {stop} GROUP BY r.hop + 1, e.dst
)
"""


def query(sql: str | None):
    def take(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return take


def paths(source: str, stop: str = "") -> str:
    return PATHS.format(source=source, stop=stop)


def _lines(spark: SparkSession, rows: DataFrame, bad: list[str]) -> DataFrame:
    return rows.unionByName(spark.createDataFrame([(x,) for x in bad], "value string"))


BAD_LINES = ["c a comment", "", "p sp 3 4", "v 1 99999999999 7", "a  1 2 3", "a 1 2 x", "a 1 2 1.5", "a 1 2", "v 1 2", "v  1 2 3", "v a 1 2 3", "a x y 99999999999999999999", " v 1 2 3"]


@query("SELECT 'P' || p_partkey AS id, CAST(p_size AS INTEGER) AS x, CAST(-p_size AS INTEGER) AS y FROM part")
def q01_dimacs_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex lines rendered from parts among lines that don't fit, parsed."""
    part = tg.table(spark, sf_dir, "part")
    lines = part.select(F.concat_ws(" ", F.lit("v"), F.concat(F.lit("P"), "p_partkey"), F.col("p_size").cast("string"), (-F.col("p_size")).cast("string")).alias("value"))
    return parse_vertices(_lines(spark, lines, BAD_LINES)).select("id", F.col("value.x").alias("x"), F.col("value.y").alias("y"))


@query("SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, CAST(l_quantity AS BIGINT) AS weight FROM lineitem")
def q02_dimacs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines rendered from line items, some with a sign or a carriage return, parsed."""
    line = tg.table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_linenumber") % 2 == 0, F.lit("+")).otherwise(F.lit(""))
    end = F.when(F.col("l_linenumber") % 3 == 0, F.lit("\r")).otherwise(F.lit(""))
    text = F.concat(F.lit("a S"), "l_suppkey", F.lit(" P"), "l_partkey", F.lit(" "), sign, F.col("l_quantity").cast("bigint").cast("string"), end)
    return parse_edges(_lines(spark, line.select(text.alias("value")), BAD_LINES)).select("src", "dst", F.col("value").alias("weight"))


@query("SELECT 'C' || o_custkey AS id, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def q03_upsert_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vertex per customer, its last order winning."""
    rows = tg.table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("id"), F.col("o_totalprice").alias("value"), "o_orderdate", "o_orderkey")
    return upsert(rows, ["id"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("id", "value")


@query("""SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, CAST(l_quantity AS BIGINT) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1""")
def q04_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per (supplier, part), the last write winning."""
    rows = tg.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("value"), "l_shipdate", "l_orderkey", "l_linenumber")
    return upsert(rows, ["src", "dst"], [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "value")]).select("src", "dst", "value")


@query("""SELECT 'C' || c_custkey AS id, c_acctbal AS value FROM customer UNION ALL SELECT 'S' || s_suppkey, s_acctbal FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_retailprice FROM part""")
def q05_scan_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of three kinds with their values."""
    def one(name, mark, key, value):
        return tg.table(spark, sf_dir, name).select(F.concat(F.lit(mark), key).alias("id"), F.col(value).alias("value"))

    return one("customer", "C", "c_custkey", "c_acctbal").unionByName(one("supplier", "S", "s_suppkey", "s_acctbal")).unionByName(one("part", "P", "p_partkey", "p_retailprice"))


@query(f"WITH {G1} SELECT src, dst, w AS value FROM e")
def q06_scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of G1."""
    return tg.supply_edges(spark, sf_dir)


@query(f"WITH {G1} SELECT (SELECT count(DISTINCT id) FROM (SELECT id FROM v UNION SELECT src FROM e)) AS vertices, (SELECT count(*) FROM e) AS edges")
def q07_count_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count on G1."""
    return count_graph(tg.g1(spark, sf_dir))


@query(f"WITH {G1} SELECT id FROM v WHERE CAST(substr(id, 2) AS BIGINT) % 2 = 0 UNION SELECT src FROM e")
def q08_implicit_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the vertex table, and every edge source."""
    half = tg.supply_vertices(spark, sf_dir).where(F.substring("id", 2, 20).cast("bigint") % 2 == 0)
    return with_sources(half, tg.supply_edges(spark, sf_dir)).select("id")


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier sends its own number plus the edge's weight along its edges."""
    g = tg.g1(spark, sf_dir)
    senders = g.vertices.where(F.col("id").startswith("S"))
    return send_along_edges(senders, g.edges, F.substring("id", 2, 20).cast("bigint") + F.col("weight"))


_SENT = "m AS (SELECT dst AS \"to\", CAST(substr(src, 2) AS BIGINT) + w AS msg FROM e WHERE src LIKE 'S%')"


@query(f'WITH {G1}, {_SENT} SELECT "to", msg FROM m')
def q09_send_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sent(spark, sf_dir)


@query(f'WITH {G1}, {_SENT} SELECT "to", min(msg) AS msg FROM m GROUP BY 1')
def q10_combine_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(_sent(spark, sf_dir), F.min)


@query(f'WITH {G1}, {_SENT} SELECT v.id, i.msg FROM v LEFT JOIN (SELECT "to", min(msg) AS msg FROM m GROUP BY 1) i ON v.id = i."to"')
def q11_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex with its combined message; a stray message would fail the query."""
    return deliver(tg.g1(spark, sf_dir).vertices.select("id"), combine(_sent(spark, sf_dir), F.min)).select("id", "msg")


@query(f"""WITH {G1}, {_SENT} SELECT v.id, i.msg FROM v LEFT JOIN (SELECT "to", min(msg) AS msg FROM m GROUP BY 1) i ON v.id = i."to"
  WHERE i.msg IS NOT NULL OR CAST(substr(v.id, 2) AS BIGINT) % 3 <> 0""")
def q12_active_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids divisible by three have halted; a message wakes them."""
    halted = tg.g1(spark, sf_dir).vertices.select("id", (F.substring("id", 2, 20).cast("bigint") % 3 == 0).alias("halted"))
    return deliver(halted, combine(_sent(spark, sf_dir), F.min)).where(is_active(F.col("halted"), F.col("msg"))).select("id", "msg")


@query(f"""WITH {G1}, reached AS (SELECT DISTINCT dst AS id FROM e WHERE src = 'S1'), n AS (SELECT id, CAST(substr(id, 2) AS BIGINT) AS k FROM v)
  SELECT n.id, k % 2 = 0 AS halted, CAST(CASE WHEN k % 2 = 1 THEN 3 WHEN r.id IS NOT NULL THEN 2 ELSE 1 END AS BIGINT) AS last_computed FROM n LEFT JOIN reached r ON n.id = r.id""")
def q13_halt_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halt_states(spark, sf_dir)


def halt_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vertices after three supersteps: even ids halted in the first and stay so, though nobody votes again; messages from S1 wake their targets for one; odd ids never halt."""
    def compute(c: Context) -> Effects:
        even = F.substring("id", 2, 20).cast("bigint") % 2 == 0
        halt = even if c.superstep == 1 else even & c.msg.isNotNull()
        sends = (SendAlong(F.lit(1), c.id == "S1"),) if c.superstep == 1 else ()
        # Only vertices that compute write: the superstep they last did so.
        return Effects(halt=halt, mut=F.lit(c.superstep), sends=sends)

    loop = SuperstepLoop(spark, tg.g1(spark, sf_dir), VertexProgram("Halt", compute, lambda a: None, lambda r, p: "", combiner=F.min))
    for _ in range(3):
        loop.step()
    loop._cached.unpersist()
    return loop.state.select("id", "halted", F.col("mut").alias("last_computed"))


@query(f'WITH {G1}, {_SENT} SELECT DISTINCT "to" AS id FROM m WHERE "to" NOT IN (SELECT id FROM v WHERE CAST(substr(id, 2) AS BIGINT) % 5 <> 0)')
def q14_missing_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that are no vertices once every fifth id is taken away."""
    known = tg.supply_vertices(spark, sf_dir).where(F.substring("id", 2, 20).cast("bigint") % 5 != 0)
    return missing_targets(known, _sent(spark, sf_dir))


def _shortest(spark: SparkSession, graph: PropertyGraph, source: str, target: str, **options):
    return run_program(spark, graph, program("ShortestPath", {"from": source, "to": target}), **options)


@query(f"WITH RECURSIVE {G1}, {paths('S0')} SELECT id, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY id")
def q15_sssp_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from S0 on G1; the source's own value is its shortest cycle."""
    run = _shortest(spark, tg.g1(spark, sf_dir), "S0", "")
    return run.vertices.where("mut IS NOT NULL").select("id", F.col("mut").alias("distance"))


@query(f"WITH {G2} SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS targets, count(*) AS degree FROM e GROUP BY 1")
def q16_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-neighbours on G2."""
    return tg.g2(spark, sf_dir).neighbours().select("id", F.array_join("targets", ",").alias("targets"), F.size("targets").cast("bigint").alias("degree"))


def _answer(spark: SparkSession, rows: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "source string, target string, path_length bigint")


@query(f"WITH RECURSIVE {G1}, {paths('S0')} SELECT 'S0' AS source, t AS target, CAST(coalesce((SELECT min(d) FROM r WHERE id = t), -1) AS BIGINT) AS path_length FROM (VALUES ('P0'), ('S1')) AS x(t)")
def q17_shortest_path_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S0 to P0 and to S1 on G1."""
    g = tg.g1(spark, sf_dir)
    dealt = DealtEdges.of(spark, g)  # once for both runs
    try:
        return _answer(spark, [("S0", t, _shortest(spark, g, "S0", t, dealt=dealt).result["pathLength"]) for t in ("P0", "S1")])
    finally:
        dealt.unpersist()


@query("""WITH RECURSIVE e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, CAST(min(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2),
  """ + paths("P0") + " SELECT 'P0' AS source, 'S0' AS target, CAST(coalesce((SELECT min(d) FROM r WHERE id = 'S0'), -1) AS BIGINT) AS path_length")
def q18_shortest_path_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P0 to S0 where edges only lead to parts."""
    return _answer(spark, [("P0", "S0", _shortest(spark, tg.g3(spark, sf_dir), "P0", "S0").result["pathLength"])])


@query(f"WITH RECURSIVE {G1}, {paths('S0')} SELECT 'S0' AS source, 'S0' AS target, CAST(coalesce((SELECT min(d) FROM r WHERE id = 'S0'), -1) AS BIGINT) AS path_length")
def q19_shortest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From S0 back to itself."""
    return _answer(spark, [("S0", "S0", _shortest(spark, tg.g1(spark, sf_dir), "S0", "S0").result["pathLength"])])


def _vertex_ops(df: DataFrame, kind: OpType, id, value=None, mut=None, superstep: int = 1, seq=None) -> DataFrame:
    null = lambda x: (F.lit(None) if x is None else x).cast("bigint")
    return df.select(id.alias("id"), F.lit(int(kind)).alias("type"), null(value).alias("value"), null(mut).alias("mut"), F.lit("w").alias("writer"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"), F.lit(superstep).alias("superstep"))


def _edge_ops(df: DataFrame, kind: OpType, src, dst, value=None, mut=None, superstep: int = 1, seq=None) -> DataFrame:
    null = lambda x: (F.lit(None) if x is None else x).cast("bigint")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(int(kind)).alias("type"), null(value).alias("value"), null(mut).alias("mut"), F.lit("w").alias("writer"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"), F.lit(superstep).alias("superstep"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tg.table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("bigint"))


@query("""WITH old AS (SELECT 'C' || c_custkey AS id, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE c_custkey % 2 = 0),
  new AS (SELECT 'C' || o_custkey AS id, min_by(o_orderkey, o_orderkey) AS value FROM orders GROUP BY 1)
  SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NOT NULL THEN old.value ELSE new.value END AS value FROM old FULL JOIN new ON old.id = new.id""")
def q20_add_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order adds its customer; existing vertices and first additions win."""
    old = tg.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("value"))
    orders = tg.table(spark, sf_dir, "orders")
    g = PropertyGraph.of(old, spark.createDataFrame([], "src string, dst string, value bigint"))
    ops = _vertex_ops(orders, OpType.ADDED, F.concat(F.lit("C"), "o_custkey"), F.col("o_orderkey"), seq=F.col("o_orderkey"))
    return apply_mutations(g, ops, None).vertices.select("id", "value")


@query(f"WITH {G1} SELECT src, dst, w AS value FROM e WHERE NOT (w > 25 AND src LIKE 'S%')")
def q21_remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy edges from suppliers removed, one of them twice."""
    g = tg.g1(spark, sf_dir)
    heavy = _edge_ops(g.edges.where("value > 25 AND src LIKE 'S%'"), OpType.REMOVED, F.col("src"), F.col("dst"))
    return apply_mutations(g, None, heavy.unionByName(heavy)).edges.select("src", "dst", "value")


@query(f"""WITH {G1}, gone AS (SELECT id FROM v WHERE CAST(substr(id, 2) AS BIGINT) % 7 = 0)
  SELECT 'v' AS kind, id AS a, '' AS b FROM v WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'e', src, dst FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""")
def q22_remove_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vertex removed with all edges from and to it."""
    g = tg.g1(spark, sf_dir)
    out = apply_mutations(g, _vertex_ops(g.vertices.where(F.substring("id", 2, 20).cast("bigint") % 7 == 0), OpType.REMOVED, F.col("id")), None)
    v = out.vertices.select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"))
    return v.unionByName(out.edges.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"""WITH {G2}, added AS (SELECT 'N' || c_nationkey AS src, 'R' || (c_custkey % 50) AS dst, min_by(c_custkey, c_custkey) AS w FROM customer GROUP BY 1, 2
    UNION ALL SELECT src, dst, w + 1000 FROM e UNION ALL SELECT 'X' || n_nationkey, 'N' || n_nationkey, CAST(n_nationkey AS BIGINT) FROM nation),
  es AS (SELECT src, dst, w FROM e UNION ALL SELECT a.src, a.dst, a.w FROM added a LEFT JOIN e ON e.src = a.src AND e.dst = a.dst WHERE e.src IS NULL)
  SELECT 'e' AS kind, src AS a, dst AS b, w AS value FROM es UNION ALL SELECT 'v', id, '', NULL FROM (SELECT id FROM v UNION SELECT src FROM es)""")
def q23_add_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges added over existing ones (which win), repeatedly, and from sources that become vertices."""
    g = tg.g2(spark, sf_dir)
    customer = tg.table(spark, sf_dir, "customer")
    new = _edge_ops(customer, OpType.ADDED, F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("R"), (F.col("c_custkey") % 50).cast("string")), F.col("c_custkey"), seq=F.col("c_custkey"))
    again = _edge_ops(g.edges, OpType.ADDED, F.col("src"), F.col("dst"), F.col("value") + 1000)
    n = _nations(spark, sf_dir)
    strange = _edge_ops(n, OpType.ADDED, F.concat(F.lit("X"), "n_nationkey"), F.concat(F.lit("N"), "n_nationkey"), F.col("k"))
    out = apply_mutations(g, None, new.unionByName(again).unionByName(strange))
    e = out.edges.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "value")
    return e.unionByName(out.vertices.select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit(None).cast("bigint").alias("value")))


@query(f"""WITH {G2}, vm AS (SELECT 'N' || c_nationkey AS id, min_by(c_custkey, c_custkey) AS mut FROM customer GROUP BY 1 UNION ALL SELECT 'Z' || r_regionkey, CAST(r_regionkey AS BIGINT) FROM region),
  em AS (SELECT src, dst, w * 2 AS mut FROM e WHERE w % 2 = 0 UNION ALL SELECT 'Y' || r_regionkey, 'N0', CAST(r_regionkey AS BIGINT) FROM region)
  SELECT 'v' AS kind, coalesce(v.id, vm.id) AS a, '' AS b, CAST(NULL AS BIGINT) AS value, vm.mut FROM v FULL JOIN vm ON v.id = vm.id
  UNION ALL SELECT 'v', 'Y' || r_regionkey, '', NULL, NULL FROM region
  UNION ALL SELECT 'e', coalesce(e.src, em.src), coalesce(e.dst, em.dst), e.w, em.mut FROM e FULL JOIN em ON e.src = em.src AND e.dst = em.dst""")
def q24_set_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutable values set on vertices and edges, some of which didn't exist."""
    g = tg.g2(spark, sf_dir)
    customer, region = tg.table(spark, sf_dir, "customer"), tg.table(spark, sf_dir, "region")
    key = F.col("r_regionkey").cast("bigint")
    v = _vertex_ops(customer, OpType.VALUE_CHANGED, F.concat(F.lit("N"), "c_nationkey"), mut=F.col("c_custkey"), seq=F.col("c_custkey")).unionByName(_vertex_ops(region, OpType.VALUE_CHANGED, F.concat(F.lit("Z"), "r_regionkey"), mut=key))
    e = _edge_ops(g.edges.where("value % 2 = 0"), OpType.VALUE_CHANGED, F.col("src"), F.col("dst"), mut=F.col("value") * 2).unionByName(_edge_ops(region, OpType.VALUE_CHANGED, F.concat(F.lit("Y"), "r_regionkey"), F.lit("N0"), mut=key))
    out = apply_mutations(g, v, e)
    rows = out.vertices.select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "value", "mut")
    return rows.unionByName(out.edges.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "value", "mut"))


@query("""SELECT bool_and(c_acctbal > -1e9) AS all_true, bool_and(c_acctbal > 0) AS all_mixed, bool_or(c_acctbal > 0) AS any_mixed, bool_or(c_acctbal > 1e9) AS any_false FROM customer""")
def q25_agg_logical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, b = aggregator_type, F.col("c_acctbal")
    return tg.table(spark, sf_dir, "customer").agg(
        t("and").column(b > -1e9).alias("all_true"), t("and").column(b > 0).alias("all_mixed"), t("or").column(b > 0).alias("any_mixed"), t("or").column(b > 1e9).alias("any_false")
    )


_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"


@query(f"SELECT min({_CENTS}) AS lo, max({_CENTS}) AS hi, CAST(sum({_CENTS}) AS BIGINT) AS total, max(CASE WHEN c_acctbal < 0 THEN {_CENTS} END) AS hi_negative, min(CASE WHEN c_acctbal > 0 THEN {_CENTS} END) AS lo_positive FROM customer")
def q26_agg_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minima above zero and maxima below it included."""
    t, c = aggregator_type, F.round(F.col("c_acctbal") * 100).cast("bigint")
    return tg.table(spark, sf_dir, "customer").agg(
        t("minInt").column(c).alias("lo"), t("maxInt").column(c).alias("hi"), t("sumInt").column(c).alias("total"),
        t("maxInt").column(F.when(F.col("c_acctbal") < 0, c)).alias("hi_negative"), t("minInt").column(F.when(F.col("c_acctbal") > 0, c)).alias("lo_positive"),
    )


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi, bool_or(o_orderkey = 7) AS seven FROM orders")
def q27_agg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sets of sixteen slices of the orders, merged on the driver as a superstep merges its own."""
    t, k = aggregator_type, F.col("o_orderkey")
    parts = tg.table(spark, sf_dir, "orders").groupBy((k % 16).alias("slice")).agg(t("sumInt").column(k).alias("total"), t("minInt").column(k).alias("lo"), t("maxInt").column(k).alias("hi"), t("or").column(k == 7).alias("seven"))
    whole = AggregatorSet()
    for row in parts.collect():  # sixteen rows
        part = AggregatorSet()
        for id, kind in (("total", "sumInt"), ("lo", "minInt"), ("hi", "maxInt"), ("seven", "or")):
            part.contribute(id, kind, row[id])
        whole.union_with(part)
    return spark.createDataFrame([tuple(whole.value(x) for x in ("total", "lo", "hi", "seven"))], "total bigint, lo bigint, hi bigint, seven boolean")


@query(f"WITH {G1}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1) SELECT id, degree FROM d WHERE degree = (SELECT max(degree) FROM d)")
def q28_agg_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superstep 1 aggregates the largest degree, superstep 2 compares with it."""
    from bspgraph.plans.algorithms import with_out_degree

    def compute(c: Context) -> Effects:
        if c.superstep == 1:
            return Effects(halt=F.lit(False), contributions=(Contribution("most", "maxInt", c.value),))
        return Effects(halt=F.lit(True), mut=F.when(c.value == c.aggregators.literal("most"), c.value))

    run = run_program(spark, with_out_degree(tg.g1(spark, sf_dir)), VertexProgram("Most", compute, lambda a: None, lambda r, p: ""))
    return run.vertices.where("mut IS NOT NULL").select("id", F.col("mut").alias("degree"))


@query("""WITH s1 AS (SELECT 'N' || n_nationkey AS id, CAST(n_nationkey AS BIGINT) AS value FROM nation UNION ALL SELECT 'R' || r_regionkey, CAST(r_regionkey + 100 AS BIGINT) FROM region),
  s2 AS (SELECT * FROM s1 WHERE id NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0))
  SELECT coalesce(s2.id, x.id) AS id, s2.value, x.mut FROM s2 FULL JOIN (SELECT 'N' || n_nationkey AS id, CAST(n_regionkey AS BIGINT) AS mut FROM nation WHERE n_nationkey % 6 = 0) x ON s2.id = x.id""")
def q29_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions, removals and value changes of three supersteps folded over a base graph."""
    n, region = _nations(spark, sf_dir), tg.table(spark, sf_dir, "region")
    id = F.concat(F.lit("N"), "n_nationkey")
    base = PropertyGraph.of(n.select(id.alias("id"), F.col("k").alias("value")), spark.createDataFrame([], "src string, dst string, value bigint"))
    ops = _vertex_ops(region, OpType.ADDED, F.concat(F.lit("R"), "r_regionkey"), (F.col("r_regionkey") + 100).cast("bigint"), superstep=1)
    ops = ops.unionByName(_vertex_ops(n.where("k % 4 = 0"), OpType.REMOVED, id, superstep=2)).unionByName(_vertex_ops(n.where("k % 6 = 0"), OpType.VALUE_CHANGED, id, mut=F.col("n_regionkey"), superstep=3))
    edge_ops = _edge_ops(n.where("false"), OpType.ADDED, id, id)
    return replay(base, ops, edge_ops, 3, workspace=Workspace(spark, "replay")).vertices.select("id", "value", "mut")


@query(f"""WITH RECURSIVE {G1}, {paths('S0')}, hops AS (SELECT hop, id, d FROM r UNION ALL SELECT 0, NULL, NULL),
  best AS (SELECT hop, id, d, min(d) OVER (PARTITION BY id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
  better AS (SELECT hop, id FROM best WHERE before IS NULL OR d < before),
  got AS (SELECT b.hop + 1 AS hop, count(DISTINCT e.dst) AS n FROM better b JOIN e ON e.src = b.id GROUP BY 1 UNION ALL SELECT 1, count(DISTINCT dst) FROM e WHERE src = 'S0'),
  steps AS (SELECT 1 AS superstep, (SELECT count(*) FROM v) AS computed, (SELECT n FROM got WHERE hop = 1) AS sent
            UNION ALL SELECT g.hop + 1, g.n, coalesce((SELECT h.n FROM got h WHERE h.hop = g.hop + 1), 0) FROM got g WHERE g.hop < 14)
  SELECT CAST(superstep AS BIGINT) AS superstep, CAST(computed AS BIGINT) AS computed, CAST(sent AS BIGINT) AS sent, CAST((SELECT count(*) FROM v) - computed AS BIGINT) AS inactive FROM steps""")
def q30_superstep_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each superstep of the shortest paths from S0."""
    run = _shortest(spark, tg.g1(spark, sf_dir), "S0", "")
    return spark.createDataFrame([(s.superstep, s.computed, s.sent, s.inactive) for s in run.supersteps], "superstep bigint, computed bigint, sent bigint, inactive bigint")


@query("SELECT CAST(greatest(1, round(count(*) / 100.0)) AS BIGINT) AS ranges, count(*) AS vertices, count(DISTINCT id) AS ids FROM (SELECT 'S' || s_suppkey AS id FROM supplier UNION ALL SELECT 'P' || p_partkey FROM part)")
def q31_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring split for tasks of 100 vertices: the ranges' scans hold every vertex once."""
    v = tg.supply_vertices(spark, sf_dir).select("id")
    n = partition_count(v.count(), 100)
    # One scan: a vertex's row is repeated for each range that holds it, which must be exactly one. Ranges ascend, so only neighbours could overlap.
    at, number = token(F.col("id")), F.col("range")
    near = F.array(*[ring_number(at, n) + F.lit(k) for k in (-1, 0, 1)])
    scanned = v.select("id", F.explode(near).alias("range")).where(in_ring_range(at, number, n))
    return scanned.agg(F.lit(n).cast("bigint").alias("ranges"), F.count("*").alias("vertices"), F.count_distinct("id").alias("ids"))


def _prune_sql(k: int, rounds: int) -> str:
    """``rounds`` rounds of keeping the vertices with at least ``k`` in-edges from kept ones, unrolled."""
    steps = ["a0 AS (SELECT id FROM v)"]
    for r in range(rounds):
        steps.append(f"a{r + 1} AS (SELECT e.dst AS id FROM e JOIN a{r} s ON e.src = s.id JOIN a{r} t ON e.dst = t.id GROUP BY 1 HAVING count(*) >= {k})")
    return f"WITH {G1}, {', '.join(steps)} SELECT id FROM a{rounds}"


@query(_prune_sql(20, 3))
def q32_k_core_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of vertices with fewer than 20 in-edges removing themselves from G1."""
    return run_program(spark, tg.g1(spark, sf_dir), program("Prune", {"k": 20, "rounds": 3}), strict=False).vertices.select("id")


_REQUESTS = """(VALUES ('ok', 'l', 'Parquet', 'd', 'Count', 0.25, 64.0, 10000, 30), ('least', 'l', 'Parquet', 'd', 'Count', 0.05, 32.0, 1000, 10), ('most', 'l', 'Parquet', 'd', 'Count', 0.05, 32.0, 1000, 600),
  ('label', '', 'Parquet', 'd', 'Count', 0.25, 64.0, 10000, 30), ('store', 'l', '', 'd', 'Count', 0.25, 64.0, 10000, 30), ('params', 'l', 'Parquet', NULL, 'Count', 0.25, 64.0, 10000, 30),
  ('program', 'l', 'Parquet', 'd', '', 0.25, 64.0, 10000, 30), ('cpu', 'l', 'Parquet', 'd', 'Count', 0.04, 64.0, 10000, 30), ('mem', 'l', 'Parquet', 'd', 'Count', 0.25, 31.9, 10000, 30),
  ('vertices', 'l', 'Parquet', 'd', 'Count', 0.25, 64.0, 999, 30), ('soon', 'l', 'Parquet', 'd', 'Count', 0.25, 64.0, 10000, 9), ('late', 'l', 'Parquet', 'd', 'Count', 0.25, 64.0, 10000, 601))
  AS r(name, label, store, store_params, algorithm, task_cpu, task_mem, task_vertices, task_timeout)"""


@query(f"""SELECT name, coalesce(label <> '' AND store <> '' AND store_params <> '' AND algorithm <> '' AND task_cpu >= 0.05 AND task_mem >= 32 AND task_vertices >= 1000 AND task_timeout BETWEEN 10 AND 600, false) AS valid
  FROM {_REQUESTS}""")
def q33_jobs_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bspgraph.jobs import validity

    return validity(spark.sql(f"SELECT * FROM {_REQUESTS}")).select("name", "valid")


_STATUS = "CASE o_orderkey % 7 WHEN 1 THEN 'created' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'failed' ELSE 'unknown' END"


@query(f"""SELECT row_number() OVER (ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS position, CAST(o_orderkey AS VARCHAR) AS id, 'job ' || o_custkey AS label, CAST(epoch(o_orderdate) AS BIGINT) AS created, {_STATUS} AS status FROM orders""")
def q34_jobs_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job table made of orders, listed by creation time."""
    from bspgraph.jobs import listed

    jobs = tg.table(spark, sf_dir, "orders")
    return listed(jobs.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("job "), "o_custkey").alias("label"), F.col("o_orderdate").alias("creation_time"), (F.col("o_orderkey") % 7).alias("status")))


@query(f"""WITH RECURSIVE {G2}, {paths('N0')} SELECT 'Count' AS program, 'vertices count=' || (SELECT count(*) FROM v) || '; edges count=' || (SELECT count(*) FROM e) AS display
  UNION ALL SELECT 'ShortestPath', 'path length from ''N0'' to ''N24''=' || coalesce((SELECT min(d) FROM r WHERE id = 'N24'), -1)""")
def q35_job_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display texts of both built-in programs on G2."""
    from bspgraph.plans.algorithms import with_out_degree

    g = tg.g2(spark, sf_dir)
    counted = run_program(spark, with_out_degree(g), program("Count")).display
    return spark.createDataFrame([("Count", counted), ("ShortestPath", _shortest(spark, g, "N0", "N24").display)], "program string, display string")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_STATUS} AS status, o_orderkey % 7 IN (1, 2) AS can_cancel FROM orders")
def q36_job_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs of such a table a cancel call would accept."""
    from bspgraph.jobs import can_cancel, listed
    from bspgraph.model import JobStatus

    rows = tg.table(spark, sf_dir, "orders")
    jobs = listed(rows.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("label"), F.col("o_orderdate").alias("creation_time"), (F.col("o_orderkey") % 7).alias("status")))
    return jobs.select("id", "status", F.col("status").isin([s.name.lower() for s in JobStatus if can_cancel(s)]).alias("can_cancel"))


def queries() -> dict[str, Query]:
    from bspgraph import program_queries, storage_queries  # noqa: F401  each adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)
