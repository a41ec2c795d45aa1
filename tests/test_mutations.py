from graphs import edge_ops, edges_of, graph, vertex_ops, vertices_of
from pyspark.sql import functions as F

from bspgraph.model import PropertyGraph
from bspgraph.operators.mutations import Handlers, apply_mutations, replay
from bspgraph.storage import Workspace

ADD, REMOVE, CHANGE = 1, 2, 3


def test_remove_vertex_takes_all_its_edges(spark):
    g = apply_mutations(graph(spark, [("a", "b", 1), ("b", "c", 1), ("c", "b", 1)]), vertex_ops(spark, [("b", REMOVE, None, None)]), None)
    assert set(vertices_of(g)) == {"a", "c"} and edges_of(g) == {}


def test_add_wins_over_removal_in_one_step(spark):
    g = graph(spark, [("a", "b", 1)], [("a", 1), ("b", 2)])
    out = apply_mutations(g, vertex_ops(spark, [("b", REMOVE, None, None), ("b", ADD, 9, None)]), edge_ops(spark, [("a", "b", REMOVE, None, None), ("a", "b", ADD, 5, None)]))
    assert vertices_of(out) == {"a": (1, None), "b": (9, None)} and edges_of(out) == {("a", "b"): (5, None)}


def test_remove_and_set_value_recreates(spark):
    out = apply_mutations(graph(spark, [("a", "b", 1)], [("a", 1), ("b", 2)]), vertex_ops(spark, [("b", REMOVE, None, None), ("b", CHANGE, None, 4)]), None)
    assert vertices_of(out) == {"a": (1, None), "b": (None, 4)} and edges_of(out) == {}


def test_duplicate_add_keeps_even_null(spark):
    out = apply_mutations(graph(spark, [], [("a", None), ("b", 2)]), vertex_ops(spark, [("a", ADD, 5, None), ("b", ADD, 6, None), ("c", ADD, 1, None, "x", 1), ("c", ADD, 2, None, "w", 9)]), None)
    assert vertices_of(out) == {"a": (None, None), "b": (2, None), "c": (2, None)}


def test_handlers(spark):
    total = lambda a, b: a + b
    h = Handlers(duplicate_vertex=total, missing_vertex=lambda: F.lit(100), duplicate_edge=total, missing_edge=lambda: F.lit(7))
    ops = vertex_ops(spark, [("a", ADD, 5, None, "w", 0), ("a", ADD, 6, None, "w", 1), ("n", CHANGE, None, 1, "w", 0), ("n", CHANGE, None, 2, "w", 1)])
    eops = edge_ops(spark, [("a", "b", ADD, 10, None), ("q", "b", CHANGE, None, 3)])
    out = apply_mutations(graph(spark, [("a", "b", 1)], [("a", 1), ("b", 1)]), ops, eops, h)
    assert vertices_of(out) == {"a": (12, None), "b": (1, None), "n": (100, 3), "q": (None, None)}
    assert edges_of(out) == {("a", "b"): (11, None), ("q", "b"): (7, 3)}


def test_removing_what_is_absent_changes_nothing(spark):
    g = graph(spark, [("a", "b", 1)])
    out = apply_mutations(g, vertex_ops(spark, [("x", REMOVE, None, None)]), edge_ops(spark, [("b", "a", REMOVE, None, None)]))
    assert set(vertices_of(out)) == {"a", "b"} and set(edges_of(out)) == {("a", "b")}


def test_replay_equals_forward_state(spark):
    g = graph(spark, [("a", "b", 1)])
    v = vertex_ops(spark, [("c", ADD, 1, None, "w", 0, 1), ("a", REMOVE, None, None, "w", 0, 2), ("a", CHANGE, None, 8, "w", 0, 3), ("d", ADD, 2, None, "w", 0, 5)])
    e = edge_ops(spark, [("c", "a", ADD, 1, None, "w", 0, 1), ("z", "c", ADD, 3, None, "w", 0, 3)])
    forward, store = g, Workspace(spark, "f")
    for s in (1, 2, 3, 5):  # the fourth superstep has no operations
        forward = apply_mutations(forward, v.where(F.col("superstep") == s), e.where(F.col("superstep") == s))
        forward = PropertyGraph(store.save(forward.vertices, "v")[0], store.save(forward.edges, "e")[0])
    again = replay(g, v, e, 5, workspace=Workspace(spark, "t"))
    assert vertices_of(again) == vertices_of(forward) == {"a": (None, 8), "b": (None, None), "c": (1, None), "d": (2, None), "z": (None, None)}
    assert edges_of(again) == edges_of(forward) == {("z", "c"): (3, None)}
