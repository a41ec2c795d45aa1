"""Registered queries of the vertex-program surface: effects, handlers, registries, aggregator sets; each with its DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph import testgraphs as tg
from bspgraph.functions.aggregators import AggregatorSet, AggregatorType, aggregator_type, register, to_bool, to_int64
from bspgraph.model import OpType, PropertyGraph
from bspgraph.operators.messages import combine, fold
from bspgraph.operators.mutations import Handlers, apply_mutations
from bspgraph.plans.program import Context, Contribution, EdgeOp, Effects, SendAlong, SendTo, VertexOp, VertexProgram, has_program, program, register_program
from bspgraph.plans.superstep import SuperstepLoop, run_program
from bspgraph.queries import G1, G2, query

_NUMBER = "CAST(substr({}, 2) AS BIGINT)"


def _number(column: str) -> Column:
    return F.substring(column, 2, 20).cast("bigint")


def _customers(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and nations without edges; a customer's value is its nation."""
    customer = tg.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("value"))
    nation = tg.table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit(None).cast("bigint").alias("value"))
    return PropertyGraph.of(customer.unionByName(nation), spark.createDataFrame([], "src string, dst string, value bigint"))


@query("""SELECT 'N' || n_nationkey AS id, m.most, m.n FROM nation LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS most, count(*) AS n FROM customer GROUP BY 1) m ON n_nationkey = c_nationkey""")
def q48_send_to_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without edges send their numbers to their nations; the combiner is an arbitrary fold of (largest, count)."""
    def compute(c: Context) -> Effects:
        if c.superstep == 1:
            own = F.struct(_number("id").alias("most"), F.lit(1).cast("bigint").alias("n"))
            return Effects(halt=F.lit(True), sends=(SendTo(F.concat(F.lit("N"), c.value), own, c.id.startswith("C")),))
        return Effects(halt=F.lit(True), mut=c.msg)

    both = fold(lambda a, b: F.struct(F.greatest(a["most"], b["most"]).alias("most"), (a["n"] + b["n"]).alias("n")))
    kind = "struct<most:bigint,n:bigint>"
    g = _customers(spark, sf_dir)
    g = PropertyGraph(g.vertices.withColumn("mut", F.lit(None).cast(kind)), g.edges)
    run = run_program(spark, g, VertexProgram("Tell", compute, lambda a: None, lambda r, p: "", combiner=both, message_type=kind, mut_type=kind))
    return run.vertices.where(F.col("id").startswith("N")).select("id", "mut.most", "mut.n")


@query(f'WITH {G1} SELECT dst AS "to", bit_xor(w * 1000 + {_NUMBER.format("src")}) AS msg FROM e GROUP BY 1')
def q49_fold_combiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of G1 under a combiner that no built-in one names: exclusive or."""
    edges = tg.supply_edges(spark, sf_dir)
    messages = edges.select(F.col("dst").alias("to"), (F.col("value") * 1000 + _number("src")).alias("msg"))
    return combine(messages, fold(lambda a, b: a.bitwiseXOR(b)))


_EFFECTS = f"""WITH {G2}, k AS (SELECT id, {_NUMBER.format('id')} AS n FROM v),
  gone AS (SELECT id FROM k WHERE n % 5 = 4),
  cut AS (SELECT src, dst FROM e WHERE w % 3 = 0),
  e1 AS (SELECT * FROM e WHERE (src, dst) NOT IN (SELECT src, dst FROM cut) AND src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)),
  v1 AS (SELECT id, CAST(NULL AS BIGINT) AS value, n * 10 AS mut FROM k WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'X' || n, n + 1, CASE WHEN n % 2 = 0 THEN n END FROM k),
  loops AS (SELECT id AS src, id AS dst, n AS w FROM k),
  e2 AS (SELECT src, dst, w, false AS new FROM e1 UNION ALL SELECT l.src, l.dst, l.w, true FROM loops l WHERE (l.src, l.dst) NOT IN (SELECT src, dst FROM e1)),
  doubled AS (SELECT src, dst, w * 2 AS mut FROM e WHERE w % 2 = 0),
  e3 AS (SELECT coalesce(e2.src, d.src) AS src, coalesce(e2.dst, d.dst) AS dst, e2.w, d.mut FROM e2 FULL JOIN doubled d ON e2.src = d.src AND e2.dst = d.dst)"""


@query(_EFFECTS + """ SELECT 'e' AS kind, src AS a, dst AS b, w AS value, mut FROM e3 UNION ALL SELECT 'v', id, '', value, mut FROM v1
  UNION ALL SELECT DISTINCT 'v', src, '', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM e3 WHERE src NOT IN (SELECT id FROM v1)""")
def q50_vertex_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every effect of a vertex in one superstep on G2: removing itself, adding and setting others, and edges added, cut and set along the way."""
    def compute(c: Context) -> Effects:
        n = _number("id")
        other = F.concat(F.lit("X"), n)
        return Effects(
            halt=F.lit(True), mut=n * 10,
            vertex_ops=(VertexOp(OpType.REMOVED, c.id, when=n % 5 == 4), VertexOp(OpType.ADDED, other, value=n + 1), VertexOp(OpType.VALUE_CHANGED, other, mut=n, when=n % 2 == 0)),
            edge_ops=(
                EdgeOp(OpType.REMOVED, c.id, c.dst, when=c.weight % 3 == 0, along_edges=True), EdgeOp(OpType.ADDED, c.id, c.id, value=n),
                EdgeOp(OpType.VALUE_CHANGED, c.id, c.dst, mut=c.weight * 2, when=c.weight % 2 == 0, along_edges=True),
            ),
        )

    loop = SuperstepLoop(spark, tg.g2(spark, sf_dir), VertexProgram("Effects", compute, lambda a: None, lambda r, p: ""))
    loop.step()
    v = loop.state.select(F.lit("v").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), "value", "mut")
    return v.unionByName(loop.graph.edges.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "value", "mut"))


@query("""WITH old AS (SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS value FROM customer), new AS (SELECT o_custkey AS k, sum(o_orderkey) AS s FROM orders GROUP BY 1),
  changed AS (SELECT o_custkey + 1 AS k, sum(o_orderkey) AS s FROM orders GROUP BY 1),
  added AS (SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NULL THEN old.value WHEN old.k IS NULL THEN s ELSE value + s END AS value FROM old FULL JOIN new ON old.k = new.k)
  SELECT 'C' || coalesce(a.k, c.k) AS id, CAST(CASE WHEN a.k IS NULL THEN -7 ELSE a.value END AS BIGINT) AS value, CAST(c.s AS BIGINT) AS mut FROM added a FULL JOIN changed c ON a.k = c.k""")
def q51_conflict_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers of one's own: duplicates add up, a vertex that a value change finds missing begins at -7."""
    old = tg.table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("value"))
    orders = tg.table(spark, sf_dir, "orders")
    g = PropertyGraph.of(old, spark.createDataFrame([], "src string, dst string, value bigint"))
    key = F.col("o_orderkey").cast("bigint")

    def ops(kind: OpType, id, value, mut) -> DataFrame:
        return orders.select(F.concat(F.lit("C"), id).alias("id"), F.lit(int(kind)).alias("type"), value.cast("bigint").alias("value"), mut.cast("bigint").alias("mut"), F.lit("w").alias("writer"), key.alias("seq"))

    log = ops(OpType.ADDED, F.col("o_custkey"), key, F.lit(None)).unionByName(ops(OpType.VALUE_CHANGED, F.col("o_custkey") + 1, F.lit(None), key))
    handlers = Handlers(duplicate_vertex=lambda a, b: a + b, missing_vertex=lambda: F.lit(-7))
    return apply_mutations(g, log, None, handlers).vertices.select("id", "value", "mut")


@query(f"""WITH {G1} SELECT id AS aggregator, CAST(n AS BIGINT) AS value FROM (VALUES ('kept', (SELECT 2 * count(*) FROM v) + (SELECT count(*) FROM v WHERE id LIKE 'S%')),
  ('again', (SELECT count(*) FROM v WHERE id LIKE 'S%'))) AS x(id, n) UNION ALL SELECT 'seen', (SELECT 2 * count(*) FROM v) UNION ALL SELECT 'dropped', NULL""")
def q52_aggregators_of_a_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three supersteps on G1: one aggregator is kept, one dropped for good, one dropped and begun anew; the last step reads what the one before had."""
    def compute(c: Context) -> Effects:
        supplier = c.id.startswith("S")
        every, some = Contribution("kept", "sumInt", F.lit(1)), Contribution("kept", "sumInt", F.lit(1), supplier)
        if c.superstep == 1:
            return Effects(halt=F.lit(False), contributions=(every, Contribution("again", "sumInt", F.lit(1)), Contribution("dropped", "maxInt", F.lit(5))))
        if c.superstep == 2:
            return Effects(halt=F.lit(False), contributions=(every,), remove_aggregators=("dropped",))
        seen = Contribution("seen", "maxInt", c.aggregators.literal("kept"))
        return Effects(halt=F.lit(True), contributions=(some, Contribution("again", "sumInt", F.lit(1), supplier), seen), remove_aggregators=("again",))

    got = run_program(spark, tg.g1(spark, sf_dir), VertexProgram("Aggregate", compute, lambda a: None, lambda r, p: "")).aggregators
    return spark.createDataFrame([(x, got.value(x) if x in got else None) for x in ("kept", "again", "seen", "dropped")], "aggregator string, value bigint")


@query("""WITH p AS (SELECT r_regionkey AS r, count(*) AS n, min(n_nationkey) AS lo, bool_and(n_nationkey < 20) AS few FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
  SELECT 'merged' AS call, CAST(sum(n) AS BIGINT) AS n, CAST(min(lo) AS BIGINT) AS lo, bool_and(few) AS few, CAST(3 AS BIGINT) AS size, '' AS error FROM p
  UNION ALL SELECT 'clone', CAST(sum(n) + 100 AS BIGINT), CAST(min(lo) AS BIGINT), bool_and(few), 3, '' FROM p UNION ALL SELECT 'removed', CAST(sum(n) AS BIGINT), NULL, bool_and(few), 2, '' FROM p UNION ALL SELECT 'cleared', NULL, NULL, NULL, 0, ''
  UNION ALL SELECT call, NULL, NULL, NULL, NULL, error FROM (VALUES ('add twice', 'ValueError'), ('set absent', 'KeyError'), ('remove absent', 'KeyError'), ('other type', 'TypeError'), ('unknown type', 'ValueError'),
    ('bool as int', 'TypeError'), ('int as bool', 'TypeError'), ('too large', 'OverflowError'), ('sum too large', 'OverflowError')) AS x(call, error)""")
def q53_aggregator_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of aggregator sets on the partial values of regions, and the errors that misuse gives."""
    joined = tg.table(spark, sf_dir, "nation").join(tg.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t, k = aggregator_type, F.col("n_nationkey")
    kinds = {"n": "sumInt", "lo": "minInt", "few": "and"}
    parts = joined.groupBy("r_regionkey").agg(t("sumInt").column(F.lit(1)).alias("n"), t("minInt").column(k).alias("lo"), t("and").column(k < 20).alias("few")).collect()  # five rows
    merged = reduce(lambda a, b: a.union_with(b) or a, [AggregatorSet({x: (kind, row[x]) for x, kind in kinds.items()}) for row in parts])
    rows = []

    def show(call: str, held: AggregatorSet) -> None:
        rows.append((call, *(held.value(x) if x in held else None for x in kinds), len(held), ""))

    def fails(call: str, misuse) -> None:
        try:
            misuse()
        except Exception as e:
            rows.append((call, None, None, None, None, type(e).__name__))

    show("merged", merged)
    copy = merged.clone()
    copy.set_value("n", 100)
    show("clone", copy)
    fails("add twice", lambda: merged.add("n", "sumInt"))
    fails("set absent", lambda: merged.set_value("none", 1))
    fails("remove absent", lambda: merged.remove("none"))
    fails("other type", lambda: merged.union_with(AggregatorSet({"n": ("maxInt", 1)})))
    fails("unknown type", lambda: aggregator_type("none"))
    fails("bool as int", lambda: to_int64(True))
    fails("int as bool", lambda: to_bool(1))
    fails("too large", lambda: to_int64(2**63))
    fails("sum too large", lambda: AggregatorSet({"n": ("sumInt", 2**63 - 1)}).set_value("n", 1))
    merged.remove("lo")
    show("removed", merged)
    copy.clear()
    show("cleared", copy)
    return spark.createDataFrame(rows, "call string, n bigint, lo bigint, few boolean, size bigint, error string")


@query(f"WITH {G1} SELECT bit_or({_NUMBER.format('id')}) AS bits, bit_or(CASE WHEN id LIKE 'S%' THEN {_NUMBER.format('id')} END) AS supplier_bits FROM v")
def q54_own_aggregator_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type of one's own in the registry: bitwise or, over two supersteps of G1."""
    try:
        aggregator_type("bitOr")
    except ValueError:
        register(AggregatorType("bitOr", lambda c: F.bit_or(c.cast("bigint")), lambda a, b: a | b, to_int64))

    def compute(c: Context) -> Effects:
        supplier = c.id.startswith("S")
        what = (Contribution("bits", "bitOr", _number("id"), supplier), Contribution("supplier_bits", "bitOr", _number("id"), supplier)) if c.superstep == 1 else (Contribution("bits", "bitOr", _number("id"), ~supplier),)
        return Effects(halt=F.lit(c.superstep == 2), contributions=what)

    got = run_program(spark, tg.g1(spark, sf_dir), VertexProgram("Bits", compute, lambda a: None, lambda r, p: "")).aggregators
    return spark.createDataFrame([(got.value("bits"), got.value("supplier_bits"))], "bits bigint, supplier_bits bigint")


@query(f"WITH {G1} SELECT 'HeavyDegree' AS program, true AS known, false AS unknown, (SELECT count(*) FROM e WHERE w >= 40) AS heavy, 'edges of 40 and more=' || (SELECT count(*) FROM e WHERE w >= 40) AS display")
def q55_program_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of one's own, made by name from its parameters: it sends along heavy edges and counts what arrives."""
    def factory(params) -> VertexProgram:
        def compute(c: Context) -> Effects:
            if c.superstep == 1:
                return Effects(halt=F.lit(True), sends=(SendAlong(F.when(c.weight >= params["least"], 1).otherwise(0)),))
            return Effects(halt=F.lit(True), contributions=(Contribution("heavy", "sumInt", c.msg),))

        return VertexProgram("HeavyDegree", compute, lambda a: a.get("heavy") or 0, lambda r, p: f"edges of {p['least']} and more={r}", combiner=F.sum, params=params)

    if not has_program("HeavyDegree"):
        register_program("HeavyDegree", factory)
    run = run_program(spark, tg.g1(spark, sf_dir), program("HeavyDegree", {"least": 40}))
    return spark.createDataFrame([("HeavyDegree", has_program("HeavyDegree"), has_program("none"), run.result, run.display)], "program string, known boolean, unknown boolean, heavy bigint, display string")


@query(f"WITH {G1} SELECT id, {_NUMBER.format('id')} * 2 + length(id) AS twice FROM v")
def q56_pandas_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way out for logic that expressions can't say: a column made from Arrow-fed batches before ``compute`` reads it."""
    def batches(context: Context):
        def rows(frames):
            for frame in frames:
                number = frame["id"].str.slice(1).astype("int64")
                yield frame.assign(twice=number * 2 + frame["id"].str.len())

        return rows

    p = VertexProgram("Twice", lambda c: Effects(halt=F.lit(True), mut=F.col("twice")), lambda a: None, lambda r, p: "", pandas=("twice bigint", batches))
    return run_program(spark, tg.g1(spark, sf_dir), p).vertices.select("id", F.col("mut").alias("twice"))
