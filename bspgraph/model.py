"""The property graph: vertices (id, value, mut) and directed edges (src, dst, value, mut) as DataFrames.

``value`` is loaded and immutable, ``mut`` is a job's own value, NULL until first set. Edges are distinct per (src, dst) and
self-loops are allowed. The vertex set is the vertex table plus every edge source; targets create nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COORDINATE = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
PAYLOADS: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType(),
    "strings": T.ArrayType(T.StringType()), "coordinate": COORDINATE, "null": T.NullType(),
}


class OpType(IntEnum):
    ADDED = 1
    REMOVED = 2
    VALUE_CHANGED = 3


class JobStatus(IntEnum):
    CREATED = 1
    RUNNING = 2
    COMPLETED = 3
    CANCELLED = 4
    FAILED = 5


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_S, _I = T.StringType(), T.IntegerType()


def vertex_schema(value: T.DataType) -> T.StructType:
    return _struct(("id", _S), ("value", value))


def edge_schema(value: T.DataType) -> T.StructType:
    return _struct(("src", _S), ("dst", _S), ("value", value))


def message_schema(value: T.DataType) -> T.StructType:
    return _struct(("to", _S), ("job_id", _S), ("superstep", _I), ("unique_id", _S), ("value", value))


def vertex_op_schema(value: T.DataType, mut: T.DataType) -> T.StructType:
    return _struct(("id", _S), ("job_id", _S), ("superstep", _I), ("type", _I), ("value", value), ("mut", mut), ("writer", _S), ("seq", T.LongType()))


def edge_op_schema(value: T.DataType, mut: T.DataType) -> T.StructType:
    return _struct(("src", _S), ("dst", _S), ("job_id", _S), ("superstep", _I), ("type", _I), ("value", value), ("mut", mut), ("writer", _S), ("seq", T.LongType()))


HALTED_SCHEMA = _struct(("id", _S), ("job_id", _S), ("superstep", _I))


def upsert(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins per key. An aggregate with partial results, so a key with many writes is folded before it moves."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    #: the vertices without implicit sources, where the others are all edge sources: who holds the edges needn't make them again
    declared: DataFrame | None = None
    #: no fewer than the edges, where that is known; sets numbers of tasks
    edge_rows: int = 0

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, mut: T.DataType | None = None, edge_mut: T.DataType | None = None, edge_rows: int = 0) -> PropertyGraph:
        """Base graph of loaded tables: implicit sources added, mutable values NULL."""
        declared = vertices.select("id", "value").withColumn("mut", F.lit(None).cast(mut or T.LongType()))
        v = with_sources(declared, edges)
        e = edges.select("src", "dst", "value").withColumn("mut", F.lit(None).cast(edge_mut or T.LongType()))
        return PropertyGraph(v, e, declared, edge_rows)

    def ids(self) -> DataFrame:
        return self.vertices.select("id")

    def neighbours(self) -> DataFrame:
        """(id, targets): ascending out-neighbours of each vertex that has some."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("targets"))

    def has_vertices(self, ids: DataFrame) -> DataFrame:
        """The rows of ``ids`` whose id is a vertex."""
        return ids.join(self.vertices.select("id"), "id", "left_semi")

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (src, dst) that are edges."""
        return pairs.join(self.edges.select("src", "dst"), ["src", "dst"], "left_semi")


def with_sources(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``vertices`` plus a NULL-valued vertex for each edge source that has none."""
    implicit = edges.select(F.col("src").alias("id")).distinct().join(vertices.select("id"), "id", "left_anti")
    missing = [F.lit(None).cast(vertices.schema[c].dataType).alias(c) for c in vertices.columns if c != "id"]
    return vertices.unionByName(implicit.select("id", *missing))
