"""Registered queries of readers, stores, ranges and the job layer, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph import testgraphs as tg
from bspgraph.model import COORDINATE, PAYLOADS, JobStatus
from bspgraph.operators.partitioning import partition_count, ring_number, ring_table, round_half_away, token
from bspgraph.plans.program import program
from bspgraph.plans.superstep import DealtEdges, SuperstepLoop
from bspgraph.queries import BAD_LINES, G1, G2, paths, query
from bspgraph.sources.dimacs import edge_reader, vertex_reader
from bspgraph.sources.store import ParquetGraphStore, has_store, open_store, register_store
from bspgraph.storage import Workspace


def _folder(spark: SparkSession, what: str) -> str:
    return Workspace(spark, what).root


@query("""SELECT 'v' AS kind, 'P' || p_partkey AS a, '' AS b, CAST(p_size AS BIGINT) AS value FROM part
  UNION ALL SELECT 'a', 'S' || l_suppkey, 'P' || l_partkey, CAST(l_quantity AS BIGINT) FROM lineitem""")
def q37_named_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files of vertex, edge and unfit lines, read back by the readers that the format's name finds."""
    folder = _folder(spark, "dimacs")
    part, line = tg.table(spark, sf_dir, "part"), tg.table(spark, sf_dir, "lineitem")
    v = part.select(F.concat(F.lit("v P"), "p_partkey", F.lit(" "), "p_size", F.lit(" 0")).alias("value"))
    e = line.select(F.concat(F.lit("a S"), "l_suppkey", F.lit(" P"), "l_partkey", F.lit(" "), F.col("l_quantity").cast("bigint")).alias("value"))
    bad = spark.createDataFrame([(x,) for x in BAD_LINES if x], "value string")
    v.unionByName(e).unionByName(bad).write.text(folder)
    vertices = vertex_reader("dimacs")(spark, folder).select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("value.x").cast("bigint").alias("value"))
    return vertices.unionByName(edge_reader("dimacs")(spark, folder).select(F.lit("a").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "value"))


@query("""SELECT 'vertices' AS kind, 'C' || c_custkey AS a, '' AS b, coalesce(o.most, CAST(c_nationkey AS BIGINT)) AS value
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS most FROM orders GROUP BY 1) o ON c_custkey = o_custkey
  UNION ALL SELECT 'vertices', 'C' || o_custkey, '', max(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
  UNION ALL SELECT 'edges', 'C' || o_custkey, 'N' || min(c_nationkey), count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey""")
def q38_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices saved in two overlapping batches, the second one winning, and edges, written in files of 2,000 rows at most."""
    params = {"directory": _folder(spark, "store"), "max_records_per_file": 2000}
    store = open_store(spark, "Parquet", params)
    customer, orders = tg.table(spark, sf_dir, "customer"), tg.table(spark, sf_dir, "orders")
    store.save_vertices(customer.select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("value")))
    store.init()  # changes nothing
    store.save_vertices(orders.select(F.concat(F.lit("C"), "o_custkey").alias("id"), F.col("o_orderkey").cast("bigint").alias("value"), F.col("o_orderkey").alias("seq")))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.min("c_nationkey").alias("n"), F.count("*").alias("value"))
    store.save_edges(placed.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("N"), "n").alias("dst"), "value"))
    store.close()
    again = open_store(spark, "Parquet", params)
    v = again.load_vertices().select(F.lit("vertices").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "value")
    return v.unionByName(again.load_edges().select(F.lit("edges").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "value"))


@query("""WITH o AS (SELECT 'C' || o_custkey AS c, o_orderkey % 3 AS step, o_orderkey AS k FROM orders)
  SELECT 'messages' AS kind, step AS superstep, c AS id, count(*) AS n FROM o GROUP BY 2, 3 UNION ALL SELECT 'halted', step, c, 1 FROM o GROUP BY 2, 3
  UNION ALL SELECT 'vertex_ops', step, c, count(*) FROM o WHERE k % 2 = 0 GROUP BY 2, 3 UNION ALL SELECT 'edge_ops', step, c, count(*) FROM o WHERE k % 2 = 1 GROUP BY 2, 3""")
def q39_store_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, halt votes and operation logs of three supersteps of one job beside another job's; messages are a multiset, votes a set."""
    store = open_store(spark, "Parquet", {"directory": _folder(spark, "steps")})
    orders = tg.table(spark, sf_dir, "orders")
    at = [F.lit("j").alias("job_id"), (F.col("o_orderkey") % 3).cast("int").alias("superstep")]
    c, value, kind = F.concat(F.lit("C"), "o_custkey"), F.col("o_orderkey").alias("value"), F.lit(1).alias("type")
    messages = orders.select(c.alias("to"), *at, value)
    store.save_vertex_messages(messages)
    store.save_vertex_messages(messages.withColumn("job_id", F.lit("other")))
    halted = orders.select(c.alias("id"), *at)
    store.save_halted_vertices(halted)
    store.save_halted_vertices(halted)
    store.save_vertex_operations(orders.where("o_orderkey % 2 = 0").select(c.alias("id"), *at, kind, value))
    store.save_edge_operations(orders.where("o_orderkey % 2 = 1").select(c.alias("src"), F.lit("x").alias("dst"), *at, kind, value))

    def counted(kind: str, load, key: str) -> Iterator[DataFrame]:
        for step in range(3):
            yield load("j", step).groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(step).cast("long").alias("superstep"), "id", "n")

    loads = (("messages", store.load_vertex_messages, "to"), ("halted", store.load_halted_vertices, "id"), ("vertex_ops", store.load_vertex_operations, "id"), ("edge_ops", store.load_edge_operations, "src"))
    return reduce(DataFrame.unionByName, [x for each in loads for x in counted(*each)])


@query("""SELECT 'Orders' AS store, (SELECT count(*) FROM customer) AS vertices, (SELECT count(*) FROM orders) AS edges, true AS known, false AS unknown""")
def q40_store_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one's own behind the same calls, found by its registered name."""

    class Orders(ParquetGraphStore):
        def load_vertices(self, wanted=None) -> DataFrame:
            return tg.table(self.spark, self.root, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_acctbal").alias("value"))

        def load_edges(self, wanted=None) -> DataFrame:
            return tg.table(self.spark, self.root, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"), F.col("o_totalprice").alias("value"))

    if not has_store("Orders"):
        register_store("Orders", Orders)
    store = open_store(spark, "Orders", {"directory": sf_dir})
    v, e = (x.agg(F.count("*").alias(n)) for x, n in ((store.load_vertices(), "vertices"), (store.load_edges(), "edges")))
    return v.crossJoin(e).select(F.lit("Orders").alias("store"), "vertices", "edges", F.lit(has_store("Orders")).alias("known"), F.lit(has_store("none")).alias("unknown"))


@query("""SELECT kind, shown, missing, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT n_nationkey AS k, unnest(['bool', 'int32', 'int64', 'string', 'strings', 'coordinate', 'null']) AS kind FROM nation) t,
  LATERAL (SELECT CASE WHEN k % 5 = 4 OR kind = 'null' THEN NULL WHEN kind = 'bool' THEN CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END WHEN kind IN ('int32', 'int64') THEN CAST(k % 3 AS VARCHAR)
    WHEN kind = 'string' THEN CASE WHEN k % 3 = 0 THEN '' ELSE 's' || (k % 3) END WHEN kind = 'strings' THEN CASE WHEN k % 3 = 0 THEN '[]' ELSE '["s' || (k % 3) || '"]' END ELSE '{"x":' || (k % 3) || ',"y":0}' END AS shown), LATERAL (SELECT shown IS NULL AS missing)
  GROUP BY 1, 2, 3""")
def q41_payload_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payload type through the store: zero, false and empty values come back as such, and NULL as NULL."""
    k, three = F.col("n_nationkey"), F.col("n_nationkey") % 3
    values = {
        "bool": k % 2 == 1, "int32": three, "int64": three, "string": F.when(three == 0, "").otherwise(F.concat(F.lit("s"), three)),
        "strings": F.when(three == 0, F.array().cast(PAYLOADS["strings"])).otherwise(F.array(F.concat(F.lit("s"), three))),
        "coordinate": F.struct(three.cast("int").alias("x"), F.lit(0).alias("y")).cast(COORDINATE),
    }
    out = []
    for kind, value in values.items():
        store = open_store(spark, "Parquet", {"directory": _folder(spark, f"payload-{kind}")})
        store.save_vertices(tg.table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), F.when(k % 5 != 4, value.cast(PAYLOADS[kind])).alias("value")))
        read = store.load_vertices()
        if read.schema["value"].dataType != PAYLOADS[kind]:
            raise TypeError(f"{kind} became {read.schema['value'].dataType}")
        shown = F.to_json("value") if isinstance(PAYLOADS[kind], (T.ArrayType, T.StructType)) else F.col("value").cast("string")
        out.append(read.select(F.lit(kind).alias("kind"), shown.alias("shown")))
    out.append(tg.table(spark, sf_dir, "nation").select(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("shown")))  # no value, so no column to store
    return reduce(DataFrame.unionByName, out).groupBy("kind", "shown", F.col("shown").isNull().alias("missing")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT count(*) AS n FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part)), r AS (SELECT CAST(greatest(1, round(n / 100.0)) AS BIGINT) AS ranges, n FROM v)
  SELECT ranges, CAST(1 AS BIGINT) AS first_id, ranges AS last_id, n AS vertices, least(ranges, 3) AS hosts FROM r""")
def q42_ranges_on_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices joined with their numbered ranges and those with three hosts: each vertex has one range, each range one host."""
    v = tg.supply_vertices(spark, sf_dir).select("id")
    n = partition_count(v.count(), 100)
    tasks = ring_table(spark, n).withColumn("host", F.col("range_id") % 3)
    held = v.groupBy((ring_number(token(F.col("id")), n) + 1).alias("range_id")).agg(F.count("*").alias("n"))
    return tasks.join(held, "range_id", "left").agg(
        F.count("*").alias("ranges"), F.min("range_id").alias("first_id"), F.max("range_id").alias("last_id"), F.sum("n").alias("vertices"), F.count_distinct("host").alias("hosts")
    )


@query("""SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(round((n_nationkey - 12) / 2.0) AS BIGINT) AS half, CAST(greatest(1, round(n_nationkey * 500 / 1000.0)) AS BIGINT) AS tasks,
  CASE n_nationkey WHEN 1 THEN 'created' WHEN 2 THEN 'running' WHEN 3 THEN 'completed' WHEN 4 THEN 'cancelled' WHEN 5 THEN 'failed' ELSE 'unknown' END AS status FROM nation""")
def q43_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding half away from zero, tasks for a number of rows, and names of statuses."""
    from bspgraph.jobs import status_name

    keys = [r[0] for r in tg.table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows
    return spark.createDataFrame([(k, round_half_away((k - 12) / 2), partition_count(k * 500, 1000), status_name(k)) for k in keys], "k bigint, half bigint, tasks bigint, status string")


_JOB_TEXTS = f"""texts AS (SELECT 'count' AS label, 'vertices count=' || (SELECT count(*) FROM v) || '; edges count=' || (SELECT count(*) FROM e) AS display
  UNION ALL SELECT 'path', 'path length from ''N0'' to ''N24''=' || coalesce((SELECT min(d) FROM r WHERE id = 'N24'), -1))"""


@query(f"""WITH RECURSIVE {G2}, {paths('N0')}, {_JOB_TEXTS} SELECT label, 'completed' AS status, display, false AS can_cancel FROM texts
  UNION ALL SELECT 'lost', 'failed', '', false UNION ALL SELECT 'stopped', 'cancelled', '', false UNION ALL SELECT 'unfit', 'INVALID_REQUEST', '', false UNION ALL SELECT 'unknown', 'INVALID_JOB', '', false""")
def q44_job_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs over a stored G2 from their creation to their end, as a second service reads them from the job table."""
    from bspgraph.jobs import JobRequest, JobService, RequestError, can_cancel, status_name

    folder, g = _folder(spark, "jobs"), tg.g2(spark, sf_dir)
    store = open_store(spark, "Parquet", {"directory": f"{folder}/graph"})
    store.save_vertices(g.vertices.select("id", "value"))
    store.save_edges(g.edges.select("src", "dst", "value"))

    def request(label: str, algorithm: str = "Count", place: str = f"{folder}/graph", **params) -> JobRequest:
        return JobRequest(label, "Parquet", {"directory": place}, algorithm, params)

    waiting = JobService(spark, folder, workers=0)
    waiting.cancel(waiting.create(request("stopped")))
    ids = [waiting.create(request("count")), waiting.create(request("path", "ShortestPath", **{"from": "N0", "to": "N24"})), waiting.create(request("lost", place=f"{folder}/none"))]
    working = JobService(spark, folder)  # takes up what waits, first come first served
    for id in ids:
        working.wait(id)
    rows = []
    for call, label in ((lambda: working.create(request("")), "unfit"), (lambda: working.result("none"), "unknown")):
        try:
            call()
        except RequestError as e:
            rows.append((label, e.status, "", False))
    after = JobService(spark, folder, workers=0)
    rows += [(j.label, status_name(j.status), j.display, can_cancel(j.status)) for j in after.list()]
    return spark.createDataFrame(rows, "label string, status string, display string, can_cancel boolean")


@query("""SELECT CAST(1 AS BIGINT) AS step, 'vertices: ' || (SELECT count(*) FROM part) AS line UNION ALL SELECT 2, 'edges: ' || count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 3, 'vertices count=' || (SELECT count(*) FROM part) || '; edges count=' || count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 4, 'count completed'
  UNION ALL SELECT 5, 'vertices count=' || (SELECT count(*) FROM part) || '; edges count=' || count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 6, 'count completed superstep=0'
  UNION ALL SELECT 7, 'INVALID_JOB: it is completed'""")
def q45_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the commands load, start, list and job say about parts and their suppliers."""
    from bspgraph import cli

    folder = _folder(spark, "command-line")
    part, line = tg.table(spark, sf_dir, "part"), tg.table(spark, sf_dir, "lineitem")
    part.select(F.concat(F.lit("v P"), "p_partkey", F.lit(" 1 2")).alias("value")).write.text(f"{folder}/v")
    line.select(F.concat(F.lit("a P"), "l_partkey", F.lit(" S"), "l_suppkey", F.lit(" 1")).alias("value")).write.text(f"{folder}/e")
    said: list[str] = []
    run = lambda *a: cli.main(["--root", folder, *a], spark, said.append)
    run("load", "--directory", f"{folder}/g", "--vertices-file", f"{folder}/v")
    run("load", "--directory", f"{folder}/g", "--edges-file", f"{folder}/e")
    run("start", "count", "--directory", f"{folder}/g")
    id, lines = said[2], [*said[:2], said[3]]
    run("list")
    lines.append(" ".join(said[-1].split("\t")[1::2]))
    run("job", "result", id)
    lines.append(said[-1])
    run("job", "stats", id)
    lines.append(said[-3])
    run("job", "cancel", id)
    lines.append(said[-1])
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(lines)], "step bigint, line string")


@query(f"WITH RECURSIVE {G1}, {paths('S0')} SELECT id, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY id")
def q46_checkpoint_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths on G1 by a loop that stops after two recorded supersteps and another one that takes up its record."""
    g, root = tg.g1(spark, sf_dir), _folder(spark, "record")
    p = program("ShortestPath", {"from": "S0", "to": ""})
    dealt = DealtEdges.of(spark, g)  # once for both loops: no superstep of theirs changes an edge
    try:
        try:
            SuperstepLoop(spark, g, p, root=root, max_supersteps=2, dealt=dealt).run(record=True)
        except RuntimeError:
            pass  # the limit is where it is meant to stop
        again = SuperstepLoop(spark, g, p, root=root, dealt=dealt)
        if not again.resume() or again.superstep != 2:
            raise RuntimeError("no record of the second superstep")
        return again.run(record=True).vertices.where("mut IS NOT NULL").select("id", F.col("mut").alias("distance"))
    finally:
        dealt.unpersist()


@query("""SELECT 'C' || o_custkey AS id, CAST(o_orderkey % 6 AS BIGINT) AS status, o_orderkey % 6 IN (1, 2) AS can_cancel, coalesce(o_orderkey % 6 IN (3, 4, 5), false) AS ended FROM orders""")
def q47_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine's predicates over a table of statuses."""
    from bspgraph.jobs import can_cancel

    status = F.col("o_orderkey") % 6
    live = [int(s) for s in JobStatus if can_cancel(int(s))]
    done = [int(s) for s in JobStatus if not can_cancel(int(s))]
    return tg.table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("id"), status.cast("bigint").alias("status"), status.isin(live).alias("can_cancel"), status.isin(done).alias("ended"))
