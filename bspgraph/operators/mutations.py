"""Graph mutation in six ordered phases, and replay of an operation log.

Edge removals, vertex removals, vertex additions, edge additions, vertex value changes, edge value changes. Existence is told by
marker columns, never by NULL values. Several operations of one kind on one key in one superstep are folded by the duplicate
handler in the order of (writer, seq), so results don't depend on scheduling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bspgraph.model import OpType, PropertyGraph
from bspgraph.storage import Workspace


#: most removed ids that are broadcast, once counted
BROADCAST_ROWS = 500_000


def keep_first(old: Column, new: Column) -> Column:
    return old


@dataclass(frozen=True)
class Handlers:
    """What happens on conflicts. Duplicate handlers take (old, new); missing handlers give an initial value, None for NULL."""

    duplicate_vertex: Callable[[Column, Column], Column] = keep_first
    missing_vertex: Callable[[], Column] | None = None
    duplicate_edge: Callable[[Column, Column], Column] = keep_first
    missing_edge: Callable[[], Column] | None = None


def folded(ops: DataFrame, keys: list[str], field: str, handler: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, new): one value per key."""
    order = F.struct("writer", "seq")
    if handler is keep_first:
        return ops.groupBy(*keys).agg(F.min_by(F.struct(F.col(field).alias("v")), order).alias("_v")).select(*keys, F.col("_v.v").alias("new"))
    every = F.array_sort(F.collect_list(F.struct("writer", "seq", F.col(field).alias("v"))))
    ops = ops.groupBy(*keys).agg(every.alias("_all")).withColumn("_all", F.transform("_all", lambda x: x["v"]))
    return ops.select(*keys, F.aggregate(F.slice("_all", 2, F.size("_all")), F.col("_all")[0], handler).alias("new"))


def _kind(ops: DataFrame, kind: OpType) -> DataFrame:
    return ops.where(F.col("type") == int(kind))


def _merged(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with existence markers ``_old`` and ``_new``."""
    return table.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), keys, "full_outer")


def _added(table: DataFrame, new: DataFrame, keys: list[str], handler) -> DataFrame:
    value = F.when(F.col("_old").isNull(), F.col("new")).when(F.col("_new").isNull(), F.col("value")).otherwise(handler(F.col("value"), F.col("new")))
    return _merged(table, new, keys).select(*keys, value.alias("value"), "mut")


def _changed(table: DataFrame, new: DataFrame, keys: list[str], missing) -> DataFrame:
    kind = table.schema["value"].dataType
    initial = (missing() if missing else F.lit(None)).cast(kind)
    value = F.when(F.col("_old").isNull(), initial).otherwise(F.col("value"))
    return _merged(table, new, keys).select(*keys, value.alias("value"), F.when(F.col("_new").isNull(), F.col("mut")).otherwise(F.col("new")).alias("mut"))


def few_removals(vertex_ops: DataFrame | None) -> bool:
    """Whether the log removes at most ``BROADCAST_ROWS`` ids."""
    return vertex_ops is not None and _kind(vertex_ops, OpType.REMOVED).count() <= BROADCAST_ROWS


def _with_sources(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    from bspgraph.model import with_sources

    return with_sources(vertices, edges)


def remove_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def remove_vertices(graph: PropertyGraph, removed: DataFrame, few: bool = False) -> PropertyGraph:
    """Vertices gone, with all their edges in either direction. With ``few``, for ids counted to be no more than ``BROADCAST_ROWS``, no edge moves."""
    ids = removed.select("id").distinct()
    ids = F.broadcast(ids) if few else ids
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return PropertyGraph(graph.vertices.join(ids, "id", "left_anti"), edges.select(*graph.edges.columns))


def apply_mutations(graph: PropertyGraph, vertex_ops: DataFrame | None, edge_ops: DataFrame | None, handlers: Handlers = Handlers(), few_removed: bool = False) -> PropertyGraph:
    """The graph after one superstep's operations. A kind of log that is None costs nothing. ``few_removed``: see ``remove_vertices``."""
    v, e = graph.vertices.select("id", "value", "mut"), graph.edges.select("src", "dst", "value", "mut")
    key, pair = ["id"], ["src", "dst"]
    if edge_ops is not None:
        e = remove_edges(e, _kind(edge_ops, OpType.REMOVED))
    if vertex_ops is not None:
        g = remove_vertices(PropertyGraph(v, e), _kind(vertex_ops, OpType.REMOVED), few_removed)
        v, e = g.vertices, g.edges
        v = _added(v, folded(_kind(vertex_ops, OpType.ADDED), key, "value", handlers.duplicate_vertex), key, handlers.duplicate_vertex)
    if edge_ops is not None:
        added = folded(_kind(edge_ops, OpType.ADDED), pair, "value", handlers.duplicate_edge)
        e = _added(e, added, pair, handlers.duplicate_edge)
        v = _with_sources(v, added)
    if vertex_ops is not None:
        v = _changed(v, folded(_kind(vertex_ops, OpType.VALUE_CHANGED), key, "mut", handlers.duplicate_vertex), key, handlers.missing_vertex)
    if edge_ops is not None:
        changed = folded(_kind(edge_ops, OpType.VALUE_CHANGED), pair, "mut", handlers.duplicate_edge)
        e = _changed(e, changed, pair, handlers.missing_edge)
        v = _with_sources(v, changed)
    return PropertyGraph(v, e)


def replay(graph: PropertyGraph, vertex_ops: DataFrame, edge_ops: DataFrame, last: int, handlers: Handlers = Handlers(), workspace: Workspace | None = None, first: int = 1, every: int = 1) -> PropertyGraph:
    """The graph after the logs' supersteps ``first`` to ``last``; stored after every ``every`` steps, as a plan grows severalfold with each."""
    old: list[str] = []
    for step in range(first, last + 1):
        at = F.col("superstep") == step
        graph = apply_mutations(graph, vertex_ops.where(at), edge_ops.where(at), handlers)
        if workspace is not None and (step - first) % every == every - 1:
            (v, p), (e, q) = workspace.save(graph.vertices, "vertices"), workspace.save(graph.edges, "edges")
            for path in old:
                workspace.drop(path)
            graph, old = PropertyGraph(v, e), [p, q]
    return graph
