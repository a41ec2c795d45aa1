"""Small graphs for the engine's tests."""

from bspgraph.model import PropertyGraph


def graph(spark, edges, vertices=()):
    ids = dict.fromkeys([v if isinstance(v, tuple) else (v, None) for v in vertices] or [(x, None) for a, b, _ in edges for x in (a, b)])
    v = spark.createDataFrame([tuple(x) for x in ids], "id string, value bigint")
    e = spark.createDataFrame([tuple(x) for x in edges], "src string, dst string, value bigint")
    return PropertyGraph.of(v, e)


def vertex_ops(spark, rows):
    """(id, type, value, mut[, writer, seq, superstep])"""
    full = [(*r, *("w", 0, 1)[len(r) - 4 :]) for r in rows]
    return spark.createDataFrame(full, "id string, type int, value bigint, mut bigint, writer string, seq bigint, superstep int")


def edge_ops(spark, rows):
    full = [(*r, *("w", 0, 1)[len(r) - 5 :]) for r in rows]
    return spark.createDataFrame(full, "src string, dst string, type int, value bigint, mut bigint, writer string, seq bigint, superstep int")


def vertices_of(g):
    return {r["id"]: (r["value"], r["mut"]) for r in g.vertices.collect()}


def edges_of(g):
    return {(r["src"], r["dst"]): (r["value"], r["mut"]) for r in g.edges.collect()}
