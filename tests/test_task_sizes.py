"""What one task holds stays the same when tables grow."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_supply_edges_take_more_tasks_as_line_items_grow(spark, monkeypatch):
    """a fixed number of tasks held ever more pairs each."""
    from bspgraph import testgraphs as tg
    from bspgraph.operators import partitioning

    monkeypatch.setattr(partitioning, "TASK_ROWS", 100)
    rows = tg.table(spark, SF, "lineitem").count()
    for both in (False, True):
        edges = tg.supply_edges(spark, SF, both).select("src", F.spark_partition_id().alias("task"))
        most = edges.groupBy("task").count().agg(F.count("*"), F.max("count")).first()
        assert most[0] >= rows // 110 and most[1] <= 200 * (2 if both else 1)


def test_count_of_edges_holds_no_pairs(spark):
    """edges are distinct, so nothing but line items' own pairs is kept to count them."""
    from bspgraph import queries

    plan = queries.q07_count_graph(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct src" not in plan and plan.count("distinct") <= 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_streamed_past_hashed_senders(spark):
    """F8: a merge join sorted all edges in every superstep, and the tables were read and folded again for the sources."""
    from bspgraph import testgraphs as tg
    from bspgraph.model import with_sources
    from bspgraph.plans.superstep import DealtEdges

    g = tg.g1(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    dealt = DealtEdges.of(spark, g, 1_000_000)
    try:
        out = dealt.out_of(g.declared.select("id"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert with_sources(g.declared, dealt.degrees).count() == g.vertices.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        dealt.unpersist()


def test_more_edges_are_dealt_to_more_tasks(spark, monkeypatch):
    """F8: a fixed number of tasks held ever more edges each."""
    from bspgraph import testgraphs as tg
    from bspgraph.operators import partitioning
    from bspgraph.plans.superstep import DealtEdges

    monkeypatch.setattr(partitioning, "TASK_ROWS", 500)
    g = tg.g1(spark, SF)
    dealt = DealtEdges.of(spark, g, 1_000_000)
    assert dealt.table.rdd.getNumPartitions() == round(g.edge_rows / 500)
    dealt.unpersist()


def test_degrees_find_the_sources_too(spark):
    """the edges were folded once for the implicit sources and once for the degrees."""
    from bspgraph.plans.algorithms import with_out_degree
    from graphs import graph

    g = graph(spark, [("a", "b", 1), ("a", "c", 1), ("x", "a", 1)], ["a", "b"])  # x is implied, c is not
    out = with_out_degree(g)
    assert {r["id"]: r["value"] for r in out.vertices.collect()} == {"a": 2, "b": 0, "x": 1}
    assert "LeftAnti" not in _plan(out.vertices)


def test_runs_share_dealt_edges(spark, monkeypatch):
    """each of the two runs made, dealt and freed the edges of its own."""
    from bspgraph import queries
    from bspgraph.plans import superstep

    made = []
    init = superstep.DealtEdges.__init__
    monkeypatch.setattr(superstep.DealtEdges, "__init__", lambda self, *a: (made.append(self), init(self, *a))[1])
    assert len(queries.q17_shortest_path_pair(spark, SF).collect()) == 2
    assert len(made) == 1 and not made[0].table.is_cached


def test_restored_loop_takes_the_dealt_edges(spark, monkeypatch):
    """the loop that takes up the record dealt all edges once more."""
    from bspgraph import storage_queries
    from bspgraph.plans import superstep

    made = []
    init = superstep.DealtEdges.__init__
    monkeypatch.setattr(superstep.DealtEdges, "__init__", lambda self, *a: (made.append(self), init(self, *a))[1])
    assert storage_queries.q46_checkpoint_restore(spark, SF).count() > 1
    assert len(made) == 1 and not made[0].table.is_cached


def test_recorded_superstep_stores_its_state_once(spark, monkeypatch, tmp_path):
    """every recorded superstep wrote all vertices a second time, for a table of the state's columns alone."""
    from bspgraph.plans import algorithms  # noqa: F401  registers ShortestPath
    from bspgraph.plans.program import program
    from bspgraph.plans.superstep import SuperstepLoop
    from bspgraph.storage import Workspace
    from graphs import graph

    g, p = graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 5)]), program("ShortestPath", {"from": "a", "to": ""})
    saved = []
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: (saved.append(name), save(self, df, name))[1])
    root = f"file://{tmp_path}/run"
    with pytest.raises(RuntimeError):
        SuperstepLoop(spark, g, p, root=root, max_supersteps=2).run(record=True)
    again = SuperstepLoop(spark, g, p, root=root)
    assert again.resume() and again.state.columns == ["id", "value", "mut", "halted"]
    run = again.run(record=True)
    assert saved.count("computed") == len(run.supersteps) and "state" not in saved
    assert {r["id"]: r["mut"] for r in run.vertices.collect()} == {"a": None, "b": 1, "c": 2, "d": 3}


def test_edges_of_a_source_lie_side_by_side(spark):
    """a task kept its edges as they came in, and each superstep looked up another sender for nearly every edge."""
    from bspgraph.plans.superstep import DealtEdges
    from graphs import graph

    edges = graph(spark, [(f"v{k % 37}", f"v{k % 41}", k % 5) for k in range(37 * 41)]).edges
    compressed = spark.conf.get("spark.sql.inMemoryColumnarStorage.compressed")
    for hot_degree in (1_000_000, 20):
        dealt = DealtEdges(edges, 3, hot_degree)
        try:
            assert (dealt.hot is None) == (hot_degree > 1000)
            for part in dealt.table.select("src").rdd.glom().collect():
                got = [r.src for r in part]
                assert sum(a != b for a, b in zip(got, got[1:], strict=False)) == max(0, len(set(got)) - 1)
            assert sorted((r.src, r.dst, r.value) for r in dealt.plain.collect()) == sorted((r.src, r.dst, r.value) for r in edges.collect())
        finally:
            dealt.unpersist()
    assert spark.conf.get("spark.sql.inMemoryColumnarStorage.compressed") == compressed


def test_few_removed_vertices_move_no_edges(spark, monkeypatch):
    """all edges were shuffled by target and stored in every round, the last one included."""
    from bspgraph.operators import mutations
    from bspgraph.plans import algorithms  # noqa: F401  registers Prune
    from bspgraph.plans.program import program
    from bspgraph.plans.superstep import SuperstepLoop
    from bspgraph.storage import Workspace
    from graphs import graph

    edges = [(f"v{k}", f"v{k * j % 40}", 1) for k in range(40) for j in (2, 3, 5, 7)]
    edges = sorted(set(edges))
    saved = []
    save = Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: (saved.append((name, df)), save(self, df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    left = []
    try:
        for bound in (mutations.BROADCAST_ROWS, 0):
            monkeypatch.setattr(mutations, "BROADCAST_ROWS", bound)
            saved.clear()
            run = SuperstepLoop(spark, graph(spark, edges), program("Prune", {"k": 3, "rounds": 3}), strict=False).run()
            left.append((sorted(r.id for r in run.vertices.collect()), sorted((r.src, r.dst) for r in run.edges.collect())))
            stored = [df for name, df in saved if name == "edges"]
            assert len(stored) == 2  # supersteps 2 and 3; the fourth is the last
            if bound:
                plan = stored[0]._jdf.queryExecution().executedPlan().toString()
                assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = {x for e in edges for x in e[:2]}
    pairs = {e[:2] for e in edges}
    for _ in range(3):
        degree = {x: sum(b == x for _, b in pairs) for x in kept}
        kept = {x for x in kept if degree[x] >= 3}
        pairs = {(a, b) for a, b in pairs if a in kept and b in kept}
    assert kept and left == [(sorted(kept), sorted(pairs))] * 2
