"""Graph stores: the pluggable surface and its Parquet implementation.

A store directory holds one table per entity. Vertices and edges are appended as batches with a sequence number and read last write
wins, so a save is an upsert; messages and operations are multisets, halt votes a set. Everything is read by (job, superstep), which
are partition directories, so a read touches only its own files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph.model import upsert
from bspgraph.operators.partitioning import LOWEST, TokenRange, partition_count, ring_ranges, scan_range
from bspgraph.storage import path_exists


class GraphStore(Protocol):
    def connect(self) -> None: ...
    def close(self) -> None: ...
    def init(self) -> None: ...
    def vertex_ranges(self, vertices_per_range: int) -> list[TokenRange]: ...
    def save_vertices(self, vertices: DataFrame) -> None: ...
    def load_vertices(self, wanted: TokenRange | None = None) -> DataFrame: ...
    def save_edges(self, edges: DataFrame) -> None: ...
    def load_edges(self, wanted: TokenRange | None = None) -> DataFrame: ...
    def save_vertex_messages(self, messages: DataFrame) -> None: ...
    def load_vertex_messages(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame: ...
    def save_vertex_operations(self, ops: DataFrame) -> None: ...
    def load_vertex_operations(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame: ...
    def save_halted_vertices(self, halted: DataFrame) -> None: ...
    def load_halted_vertices(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame: ...
    def save_edge_operations(self, ops: DataFrame) -> None: ...
    def load_edge_operations(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame: ...


class ParquetGraphStore:
    """Parameters: ``directory``, and optionally the table names ``vertices`` and ``edges`` and ``max_records_per_file``."""

    def __init__(self, spark: SparkSession, params: Mapping[str, Any]):
        self.spark, self.root = spark, str(params["directory"]).rstrip("/")
        self.names = {"vertices": params.get("vertices", "vertices"), "edges": params.get("edges", "edges")}
        self.per_file = int(params.get("max_records_per_file", 0))

    def connect(self) -> None:
        """Nothing to open: sessions belong to Spark."""

    def close(self) -> None:
        """Nothing to close."""

    def init(self) -> None:
        """Tables come into being with their first write; repeating this changes nothing."""

    def _path(self, name: str) -> str:
        return f"{self.root}/{self.names.get(name, name)}"

    def _append(self, df: DataFrame, name: str, by: tuple[str, ...]) -> None:
        write = df.write.mode("append").partitionBy(*by)
        if self.per_file:
            write = write.option("maxRecordsPerFile", self.per_file)
        write.parquet(self._path(name))

    def _next(self, name: str) -> int:
        if not path_exists(self.spark, self._path(name)):
            return 0
        return (self.spark.read.parquet(self._path(name)).agg(F.max("batch")).first()[0] or 0) + 1

    def _save(self, df: DataFrame, name: str, keys: list[str]) -> None:
        """One batch; ``seq`` orders repeated keys within it where the caller has such a column."""
        order = [F.col("seq")] if "seq" in df.columns else [F.lit(0)]
        folded = upsert(df, keys, order).drop("seq")
        self._append(folded.withColumn("batch", F.lit(self._next(name))), name, ("batch",))

    def _load(self, name: str, keys: list[str], wanted: TokenRange | None) -> DataFrame:
        df = self.spark.read.parquet(self._path(name))
        if wanted is not None:
            df = scan_range(df, keys[0], wanted)
        if df.select(F.count_distinct("batch")).first()[0] > 1:
            df = upsert(df, keys, [F.col("batch")])
        return df.drop("batch")

    def row_count(self, name: str) -> int:
        keys = ["id"] if name == "vertices" else ["src", "dst"]
        return self._load(name, keys, None).count()

    def vertex_ranges(self, vertices_per_range: int) -> list[TokenRange]:
        return ring_ranges(partition_count(self.row_count("vertices"), vertices_per_range))

    def save_vertices(self, vertices: DataFrame) -> None:
        self._save(vertices, "vertices", ["id"])

    def load_vertices(self, wanted: TokenRange | None = None) -> DataFrame:
        return self._load("vertices", ["id"], wanted).select("id", "value")

    def save_edges(self, edges: DataFrame) -> None:
        self._save(edges, "edges", ["src", "dst"])

    def load_edges(self, wanted: TokenRange | None = None) -> DataFrame:
        return self._load("edges", ["src", "dst"], wanted).select("src", "dst", "value")

    def _load_step(self, name: str, key: str, job: str, superstep: int, wanted: TokenRange | None) -> DataFrame:
        df = self.spark.read.parquet(self._path(name)).where((F.col("job_id") == job) & (F.col("superstep") == superstep))
        return df if wanted is None else scan_range(df, key, wanted)

    def save_vertex_messages(self, messages: DataFrame) -> None:
        """Rows (to, job_id, superstep, value); each gets an id of its own, as equal messages are different messages."""
        self._append(messages.withColumn("unique_id", F.uuid()), "messages", ("job_id", "superstep"))

    def load_vertex_messages(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame:
        return self._load_step("messages", "to", job, superstep, wanted)

    def save_vertex_operations(self, ops: DataFrame) -> None:
        self._append(ops.withColumn("unique_id", F.uuid()), "vertex_ops", ("job_id", "superstep"))

    def load_vertex_operations(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame:
        return self._load_step("vertex_ops", "id", job, superstep, wanted)

    def save_halted_vertices(self, halted: DataFrame) -> None:
        self._append(halted.distinct(), "halted", ("job_id", "superstep"))

    def load_halted_vertices(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame:
        return self._load_step("halted", "id", job, superstep, wanted).select("id").distinct()

    def save_edge_operations(self, ops: DataFrame) -> None:
        self._append(ops.withColumn("unique_id", F.uuid()), "edge_ops", ("job_id", "superstep"))

    def load_edge_operations(self, job: str, superstep: int, wanted: TokenRange | None = None) -> DataFrame:
        return self._load_step("edge_ops", "src", job, superstep, wanted)


_stores: dict[str, Callable[[SparkSession, Mapping[str, Any]], GraphStore]] = {"Parquet": ParquetGraphStore}


def register_store(name: str, factory: Callable[[SparkSession, Mapping[str, Any]], GraphStore]) -> None:
    if name in _stores:
        raise ValueError(f"store {name!r} is registered already")
    _stores[name] = factory


def has_store(name: str) -> bool:
    return name in _stores


def open_store(spark: SparkSession, name: str, params: Mapping[str, Any]) -> GraphStore:
    if name not in _stores:
        raise ValueError(f"unknown store {name!r}")
    store = _stores[name](spark, params)
    store.connect()
    store.init()
    return store


FULL_RING = TokenRange(LOWEST, LOWEST)
