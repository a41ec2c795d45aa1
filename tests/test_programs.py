import math

import pytest
from graphs import edges_of, graph, vertices_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bspgraph.model import OpType
from bspgraph.operators.messages import combine, fold
from bspgraph.plans.algorithms import count_graph, with_out_degree
from bspgraph.plans.program import Context, Contribution, EdgeOp, Effects, SendAlong, SendTo, VertexOp, VertexProgram, program
from bspgraph.plans.superstep import SuperstepLoop, run_program

CASES = {
    "chain": ([("a", "b", 1), ("b", "c", 2)], {("a", "c"): 3, ("c", "a"): -1}),
    "detour": ([("a", "b", 10), ("a", "c", 1), ("c", "b", 2)], {("a", "b"): 3}),
    "zero": ([("a", "b", 0), ("b", "c", 0)], {("a", "c"): 0}),
    "cycle": ([("a", "b", 2), ("b", "a", 3)], {("a", "a"): 5}),
    "no cycle": ([("a", "b", 2)], {("a", "a"): -1}),
    "self-loop": ([("a", "a", 4)], {("a", "a"): 4}),
    "late goal": ([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("a", "f", 9)], {("a", "f"): 5}),
    "unknown source": ([("a", "b", 2)], {("x", "b"): -1}),
}


def shortest(spark, g, source, target, **options):
    return run_program(spark, g, program("ShortestPath", {"from": source, "to": target}), **options)


@pytest.mark.parametrize("name", CASES)
def test_shortest_path_cases(spark, name):
    edges, wanted = CASES[name]
    for (a, b), d in wanted.items():
        run = shortest(spark, graph(spark, edges), a, b)
        assert run.result == {"pathLength": d}
        assert run.display == f"path length from '{a}' to '{b}'={d}"


def test_hot_sources_are_dealt_in_parts(spark):
    """A hub of many edges sends to every target once, however its edges are dealt."""
    edges = [("hub", f"v{k}", k) for k in range(40)] + [(f"v{k}", "hub", 1) for k in range(0, 40, 3)] + [("v1", "end", 2)]
    plain = shortest(spark, graph(spark, edges), "v0", "end")
    for degree in (1, 7, 39):
        run = shortest(spark, graph(spark, edges), "v0", "end", hot_degree=degree)
        assert run.result == plain.result == {"pathLength": 4}
        assert [(s.computed, s.sent) for s in run.supersteps] == [(s.computed, s.sent) for s in plain.supersteps]
        assert sorted(run.vertices.select("id", "mut").collect()) == sorted(plain.vertices.select("id", "mut").collect())

    def compute(c: Context) -> Effects:
        return Effects(halt=F.lit(True), edge_ops=(EdgeOp(OpType.VALUE_CHANGED, c.id, c.dst, mut=c.weight * 2, along_edges=True),))

    loop = SuperstepLoop(spark, graph(spark, edges), VertexProgram("Double", compute, lambda a: None, lambda r, p: ""), hot_degree=7)
    assert sorted((r.src, r.dst, r.mut) for r in loop.run().edges.collect()) == sorted((a, b, 2 * w) for a, b, w in edges)


def test_message_to_missing_vertex_fails(spark):
    g = graph(spark, [("a", "z", 1)], ["a"])
    with pytest.raises(Exception, match="missing vertex z"):
        shortest(spark, g, "a", "z")
    assert shortest(spark, g, "a", "z", strict=False).result["pathLength"] == -1


def test_null_weight_is_an_error(spark):
    with pytest.raises(Exception, match="edge without weight"):
        shortest(spark, graph(spark, [("a", "b", None)]), "a", "b")


def test_negative_cycle_stops_at_the_limit(spark):
    with pytest.raises(RuntimeError, match="not finished after 4"):
        shortest(spark, graph(spark, [("a", "b", -1), ("b", "a", -1)]), "a", "", max_supersteps=4)


def test_superstep_counts(spark):
    run = shortest(spark, graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "b", 1)]), "a", "")
    assert [(s.computed, s.sent) for s in run.supersteps] == [(3, 1), (1, 1), (1, 1), (1, 0)]
    assert run.total.computed == 6 and run.total.inactive == 6
    assert {r["id"]: r["mut"] for r in run.vertices.collect()} == {"a": None, "b": 1, "c": 2}


def bellman_ford(edges, source):
    best, again = {}, True
    while again:
        again = False
        for a, b, w in edges:
            for base in ([0] if a == source else []) + ([best[a]] if a in best else []):
                if base + w < best.get(b, math.inf):
                    best[b], again = base + w, True
    return best


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)), st.integers(0, 9), min_size=1, max_size=14))
def test_equals_bellman_ford(spark, weights):
    edges = [(f"n{a}", f"n{b}", w) for (a, b), w in weights.items()]
    run = shortest(spark, graph(spark, edges), edges[0][0], "")
    assert {r["id"]: r["mut"] for r in run.vertices.collect() if r["mut"] is not None} == bellman_ford(edges, edges[0][0])


def test_count(spark):
    g = graph(spark, [("b", "a", 1), ("b", "b", 1)], ["a"])
    assert tuple(count_graph(g).first()) == (2, 2)
    run = run_program(spark, with_out_degree(g), program("Count"))
    assert run.result == {"vertices": 2, "edges": 2} and run.display == "vertices count=2; edges count=2"


def test_aggregators_are_cumulative_and_seen_one_step_later(spark):
    seen = []

    def compute(c: Context) -> Effects:
        seen.append(c.aggregators.get("n"))
        return Effects(halt=F.lit(c.superstep == 3), contributions=(Contribution("n", "sumInt", F.lit(1)), Contribution("low", "minInt", F.lit(-c.superstep))))

    run = run_program(spark, graph(spark, [("a", "b", 1)]), VertexProgram("t", compute, dict, lambda r, p: ""))
    assert seen == [None, 2, 4] and run.result == {"n": 6, "low": -3}


def test_sends_need_a_combiner(spark):
    p = VertexProgram("t", lambda c: Effects(halt=F.lit(True), sends=(SendAlong(F.lit(1)),)), dict, lambda r, p: "")
    with pytest.raises(ValueError, match="combiner"):
        run_program(spark, graph(spark, [("a", "b", 1)]), p)


def test_send_to_any_vertex(spark):
    def compute(c: Context) -> Effects:
        return Effects(halt=F.lit(True), mut=c.msg, sends=(SendTo(F.lit("a"), F.lit(5), c.id == "c"),) if c.superstep == 1 else ())

    run = run_program(spark, graph(spark, [], ["a", "b", "c"]), VertexProgram("t", compute, dict, lambda r, p: "", combiner=F.sum))
    assert {r["id"]: r["mut"] for r in run.vertices.collect()} == {"a": 5, "b": None, "c": None}


def test_halt_persists_until_a_message(spark):
    """b halts at once and computes again only when a's third-step message arrives."""
    def compute(c: Context) -> Effects:
        sends = (SendAlong(F.lit(1), c.id == "a"),) if c.superstep == 3 else ()
        return Effects(halt=(c.id == "b") | F.lit(c.superstep >= 3), mut=F.lit(c.superstep), sends=sends)

    run = run_program(spark, graph(spark, [("a", "b", 1)]), VertexProgram("t", compute, dict, lambda r, p: "", combiner=F.min))
    assert {r["id"]: r["mut"] for r in run.vertices.collect()} == {"a": 3, "b": 4}
    assert [s.computed for s in run.supersteps] == [2, 1, 1, 1]


def test_mutations_show_one_step_later(spark):
    degrees = {}

    def compute(c: Context) -> Effects:
        if c.superstep == 1:
            return Effects(halt=F.lit(False), edge_ops=(EdgeOp(OpType.ADDED, c.id, F.lit("z"), value=F.lit(7), when=c.id == "a"), EdgeOp(OpType.VALUE_CHANGED, c.id, c.dst, mut=c.weight * 2, along_edges=True)), vertex_ops=(VertexOp(OpType.ADDED, F.lit("z"), value=F.lit(9)),))
        degrees[c.superstep] = True
        return Effects(halt=F.lit(True), contributions=(Contribution("n", "sumInt", F.lit(1)),))

    run = run_program(spark, graph(spark, [("a", "b", 3)]), VertexProgram("t", compute, dict, lambda r, p: "", combiner=F.min))
    assert run.result == {"n": 3}
    assert edges_of(run) == {("a", "b"): (3, 6), ("a", "z"): (7, None)}
    assert vertices_of(run) == {"a": (None, None), "b": (None, None), "z": (9, None)}


def test_pandas_escape_hatch(spark):
    def function(context):
        def rows(batches):
            for b in batches:
                yield b.assign(letters=b["id"].str.len().astype("int64"))

        return rows

    p = VertexProgram("t", lambda c: Effects(halt=F.lit(True), mut=F.col("letters")), dict, lambda r, p: "", pandas=("letters bigint", function))
    run = run_program(spark, graph(spark, [], ["a", "bcd"]), p)
    assert {r["id"]: r["mut"] for r in run.vertices.collect()} == {"a": 1, "bcd": 3}


def test_resume_takes_up_the_last_record(spark, tmp_path):
    edges = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1)]
    g, p = graph(spark, edges), program("ShortestPath", {"from": "a", "to": "e"})
    root = f"file://{tmp_path}/run"
    loop = SuperstepLoop(spark, g, p, root=root, max_supersteps=2)
    with pytest.raises(RuntimeError):
        loop.run(record=True)
    again = SuperstepLoop(spark, g, p, root=root)
    assert again.resume() and again.superstep == 2
    run = again.run(record=True)
    assert run.result == {"pathLength": 4} and [s.superstep for s in run.supersteps] == [1, 2, 3, 4, 5]
    assert not SuperstepLoop(spark, g, p, root=f"file://{tmp_path}/none").resume()


def test_combiner_doesnt_depend_on_partitioning(spark):
    m = spark.createDataFrame([(f"t{k % 5}", k) for k in range(60)], '"to" string, msg bigint'.replace('"', "`"))
    step = fold(lambda a, b: F.greatest(a, b))
    results = [sorted(map(tuple, combine(m.repartition(n), c).collect())) for n in (1, 3, 7) for c in (F.max, step)]
    assert all(r == results[0] for r in results)


def test_prune(spark):
    g = graph(spark, [("a", "b", 1), ("b", "a", 1), ("c", "a", 1), ("d", "c", 1)])
    run = run_program(spark, g, program("Prune", {"k": 1, "rounds": 3}), strict=False)
    assert {r["id"] for r in run.vertices.collect()} == {"a", "b"}


def test_fold_of_a_hot_target_is_bounded(spark):
    """No row holds more of a target's messages than a run, and the result doesn't depend on how they are dealt."""
    m = spark.range(0, 30_000, 1, 5).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 100)).alias("to"), F.col("id").alias("msg"))
    want = {}
    for k in range(30_000):
        to = "hot" if k % 10 < 9 else f"t{k % 100}"
        want[to] = want.get(to, 0) ^ k
    step = fold(lambda a, b: a.bitwiseXOR(b))
    for n in (1, 7):
        assert {r["to"]: r["msg"] for r in combine(m.repartition(n), step).collect()} == want
    runs = m.groupBy("to", F.shiftright(F.monotonically_increasing_id(), 12)).count()
    assert runs.agg(F.max("count")).first()[0] <= 4096


def test_path_length_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)overflow"):
        shortest(spark, graph(spark, [("a", "b", 2**63 - 1), ("b", "c", 1)]), "a", "c")
