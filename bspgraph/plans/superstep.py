"""The bulk-synchronous loop.

State is three tables: vertices (id, value, mut, halted), edges (src, dst, value, mut) and the combined messages (to, msg). One
superstep delivers messages, computes the active vertices and stores the new state in one job whose ``Observation`` carries the
statistics and aggregator partials; a second job stores the messages, combined before and after their shuffle. Writes become
visible one superstep later. The loop ends when every vertex has halted and no message is pending.

Stored tables are ordinary Parquet in the shared folder: plans stay as short as one superstep, a lost executor costs only its own
tasks, and a run can be resumed from any superstep it has recorded. Edges are dealt by source once and cached; a superstep
joins them with the senders alone and never shuffles them again. A source of more than ``hot_degree`` edges is dealt in as many
parts as that takes, and its vertex is repeated once for each part when it sends.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bspgraph.functions.aggregators import AggregatorSet, aggregator_type
from bspgraph.model import PropertyGraph, with_sources
from bspgraph.operators.messages import combine, deliver, is_active
from bspgraph.operators.mutations import apply_mutations, few_removals
from bspgraph.operators.partitioning import task_count
from bspgraph.plans.program import ALWAYS, Context, Effects, SendAlong, SendTo, VertexProgram
from bspgraph.storage import Workspace, path_exists


#: out-edges of a source that one task may hold
HOT_DEGREE = 1_000_000


@dataclass
class Stats:
    """Counts of one superstep, or their sum. ``sent`` counts combined messages: distinct targets."""

    superstep: int = 0
    computed: int = 0
    sent: int = 0
    halted: int = 0
    inactive: int = 0
    compute_ns: int = 0
    total_ns: int = 0

    def add(self, other: Stats) -> None:
        for name in ("computed", "sent", "halted", "inactive", "compute_ns", "total_ns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.superstep = max(self.superstep, other.superstep)


@dataclass
class Run:
    """What a finished loop leaves: the last graph with its halt flags, all statistics and the aggregators."""

    vertices: DataFrame
    edges: DataFrame
    aggregators: AggregatorSet
    supersteps: list[Stats]
    result: Any
    display: str
    total: Stats = field(default_factory=Stats)


class Cancelled(Exception):
    """The run was cancelled between supersteps."""


def _holds(when: Column | None) -> Column:
    return F.lit(True) if when is ALWAYS else F.coalesce(when, F.lit(False))


def _kept(dealt: DataFrame) -> DataFrame:
    """``dealt`` cached with the edges of a source side by side, so that a pass over them looks up the same sender again and again.

    Sorting by a 64-bit hash is a radix sort, and may spill. Blocks are compressed as a whole; no columns are encoded before that.
    """
    conf, key = dealt.sparkSession.conf, "spark.sql.inMemoryColumnarStorage.compressed"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return dealt.sortWithinPartitions(F.xxhash64("src")).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        conf.set(key, before)


class DealtEdges:
    """Cached edges, dealt by source; the few sources of more than ``hot_degree`` edges are dealt in parts."""

    def __init__(self, edges: DataFrame, partitions: int, hot_degree: int):
        self.table = _kept(edges.repartition(partitions, "src"))
        #: (src, n), cached: one pass tells hot sources and the sources themselves
        self.degrees = self.table.groupBy("src").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        #: (hot, parts): at most number of edges / ``hot_degree`` rows
        self.hot = self.degrees.where(F.col("n") > hot_degree).select(F.col("src").alias("hot"), F.ceil(F.col("n") / hot_degree).alias("parts")).persist()
        if self.hot.isEmpty():
            self.hot.unpersist()
            self.hot = None
        else:
            whole, part = self.table, F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)))
            self.table = _kept(whole.join(F.broadcast(self.hot), F.col("src") == F.col("hot"), "left").select(*edges.columns, part.alias("_part")).repartition(partitions, "src", "_part"))
            self.table.count()
            whole.unpersist()
        self.plain = self.table.select(*edges.columns)

    @staticmethod
    def of(spark: SparkSession, graph: PropertyGraph, hot_degree: int = HOT_DEGREE) -> DealtEdges:
        return DealtEdges(graph.edges, task_count(spark, graph.edge_rows), hot_degree)

    def out_of(self, senders: DataFrame) -> DataFrame:
        """``senders`` with ``dst``, ``weight`` and ``edge_mut`` of each out-edge. A task hashes its senders and streams its edges past them, so that no superstep sorts these."""
        columns = [F.col("src").alias("id"), "dst", F.col("value").alias("weight"), F.col("mut").alias("edge_mut")]
        if self.hot is None:
            return senders.hint("shuffle_hash").join(self.table.select(*columns), "id")
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("_part")
        spread = senders.join(F.broadcast(self.hot), F.col("id") == F.col("hot"), "left").select(*senders.columns, spread).hint("shuffle_hash")
        return spread.join(self.table.select(*columns, "_part"), ["id", "_part"]).drop("_part")

    def unpersist(self) -> None:
        self.table.unpersist()
        self.degrees.unpersist()
        if self.hot is not None:
            self.hot.unpersist()


def _messages(computed: DataFrame, edges: Callable[[], DealtEdges], effects: Effects, kind: str) -> DataFrame | None:
    """Uncombined (to, msg) of all sends."""
    out = []
    for k, send in enumerate(effects.sends):
        senders = computed.where(F.col("active") & F.col(f"send{k}"))
        if isinstance(send, SendAlong):
            out.append(edges().out_of(senders).select(F.col("dst").alias("to"), send.message.cast(kind).alias("msg")))
        else:
            out.append(senders.select(send.to.alias("to"), send.message.cast(kind).alias("msg")))
    return reduce(DataFrame.unionByName, out) if out else None


def _operations(computed: DataFrame, edges: Callable[[], DealtEdges], effects: Effects, graph: PropertyGraph):
    """Operation logs of this superstep, or None for a kind that the program doesn't use."""
    vkind, vmut = graph.vertices.schema["value"].dataType, graph.vertices.schema["mut"].dataType
    ekind, emut = graph.edges.schema["value"].dataType, graph.edges.schema["mut"].dataType
    null = lambda x, kind: (F.lit(None) if x is None else x).cast(kind)
    vertex_ops, edge_ops = [], []
    active = computed.where("active")
    for k, op in enumerate(effects.vertex_ops):
        vertex_ops.append(active.where(_holds(op.when)).select(op.id.alias("id"), F.lit(int(op.type)).alias("type"), null(op.value, vkind).alias("value"), null(op.mut, vmut).alias("mut"), F.col("id").alias("writer"), F.lit(k).cast("long").alias("seq")))
    for k, op in enumerate(effects.edge_ops):
        rows = edges().out_of(active) if op.along_edges else active
        rows = rows.where(_holds(op.when))
        edge_ops.append(rows.select(op.src.alias("src"), op.dst.alias("dst"), F.lit(int(op.type)).alias("type"), null(op.value, ekind).alias("value"), null(op.mut, emut).alias("mut"), F.col("id").alias("writer"), F.lit(k).cast("long").alias("seq")))
    both = lambda rows: reduce(DataFrame.unionByName, rows) if rows else None
    return both(vertex_ops), both(edge_ops)


def _own_columns(stored: DataFrame) -> DataFrame:
    """The state that a superstep stored, from the table of all it computed or from one of the state alone."""
    if "new_mut" not in stored.columns:
        return stored
    return stored.select("id", "value", F.col("new_mut").alias("mut"), F.col("new_halted").alias("halted"))


def _uses_edges(effects: Effects) -> bool:
    return bool(effects.vertex_ops or effects.edge_ops or any(isinstance(s, SendAlong) for s in effects.sends))


class SuperstepLoop:
    def __init__(
        self, spark: SparkSession, graph: PropertyGraph, program: VertexProgram, max_supersteps: int = 500, strict: bool = True,
        root: str | None = None, cancelled: Callable[[], bool] = lambda: False, on_stats: Callable[[Stats], None] = lambda s: None, hot_degree: int = HOT_DEGREE,
        dealt: DealtEdges | None = None,
    ):
        """``dealt``: the graph's edges, dealt before; the caller frees them."""
        self.spark, self.program, self.max_supersteps, self.strict = spark, program, max_supersteps, strict
        self.cancelled, self.on_stats, self.hot_degree = cancelled, on_stats, hot_degree
        self.work = Workspace(spark, program.name.lower(), root)
        self.graph, self.superstep, self.aggregators = graph, 0, AggregatorSet()
        self.stats: list[Stats] = []
        self.state: DataFrame | None = None
        self.messages: DataFrame | None = None
        self._paths: dict[str, str | None] = {"state": None, "messages": None, "edges": None}
        self._pending = 0
        self._garbage: list[str | None] = []
        self._cached = self._lent = dealt
        self._recording = False

    # -- recording -------------------------------------------------------------------------------------------------------------
    def _record(self) -> None:
        """A one-row manifest beside the tables: all that ``resume`` needs."""
        held = {"superstep": self.superstep, "aggregators": self.aggregators.to_dict(), "stats": [asdict(s) for s in self.stats], "paths": self._paths, "pending": self._pending, "n": self.work.n}
        self.spark.range(1, numPartitions=1).select(F.lit(json.dumps(held)).alias("manifest")).write.mode("overwrite").text(f"{self.work.root}/manifest-{self.superstep:05d}")
        old = f"{self.work.root}/manifest-{self.superstep - 1:05d}"
        if self.superstep > 1:
            self.work.drop(old)

    def resume(self) -> bool:
        """Take up the last recorded superstep of this run's folder; False where there is none."""
        found = [k for k in range(1, self.max_supersteps + 1) if path_exists(self.spark, f"{self.work.root}/manifest-{k:05d}/_SUCCESS")]
        if not found:
            return False
        held = json.loads(self.spark.read.text(f"{self.work.root}/manifest-{found[-1]:05d}").first()[0])
        self.superstep, self._paths, self._pending, self.work.n = held["superstep"], held["paths"], held["pending"], held["n"]
        self.aggregators = AggregatorSet.from_dict(held["aggregators"])
        self.stats = [Stats(**s) for s in held["stats"]]
        self.state = _own_columns(self.spark.read.parquet(self._paths["state"]))
        self.messages = self.spark.read.parquet(self._paths["messages"]) if self._paths["messages"] else None
        if self._paths["edges"]:
            self.graph = PropertyGraph(self.graph.vertices, self.spark.read.parquet(self._paths["edges"]), edge_rows=self.graph.edge_rows)
            self._undeal()
        return True

    # -- one superstep ---------------------------------------------------------------------------------------------------------
    def _edges(self) -> DealtEdges:
        if self._cached is None:
            self._cached = DealtEdges.of(self.spark, self.graph, self.hot_degree)
        return self._cached

    def _undeal(self) -> None:
        """Free the dealt edges, unless they are the caller's."""
        if self._cached is not None and self._cached is not self._lent:
            self._cached.unpersist()
        self._cached = None

    def _delivered(self, effects: Effects) -> DataFrame:
        kind = self.program.message_type
        state = self.state
        if state is None:
            vertices = self.graph.vertices
            if self.graph.declared is not None and _uses_edges(effects):
                vertices = with_sources(self.graph.declared, self._edges().degrees)  # not from the tables once more
            state = vertices.select("id", "value", "mut").withColumn("halted", F.lit(False))
        if self.messages is None:
            return state.withColumn("msg", F.lit(None).cast(kind))
        return deliver(state, self.messages, self.strict)

    def step(self) -> Stats:
        began = time.time_ns()
        self.superstep += 1
        program = self.program
        if program.name and self.cancelled():
            raise Cancelled(program.name)
        context = Context(self.superstep, self.aggregators.frozen(), program.params)
        effects = program.compute(context)
        rows = self._delivered(effects).withColumn("active", is_active(F.col("halted"), F.col("msg")))
        if program.pandas:
            ddl, function = program.pandas
            rows = rows.mapInPandas(function(context), f"{_ddl(rows)}, {ddl}")
        if effects.sends and program.combiner is None:
            raise ValueError(f"program {program.name!r} sends messages and needs a combiner")
        sends = [F.col("active") & _holds(s.when) for s in effects.sends]
        # Effects read the state as it was: the new mutable value gets its place only in the stored columns.
        new = F.when(F.col("active"), effects.mut).otherwise(F.col("mut")) if effects.mut is not None else F.col("mut")
        computed = rows.withColumn("new_mut", new.cast(program.mut_type)).withColumn("new_halted", F.when(F.col("active"), effects.halt).otherwise(F.col("halted")))
        for k, when in enumerate(sends):
            computed = computed.withColumn(f"send{k}", when)
        seen = Observation()
        partials = [
            aggregator_type(c.kind).column(F.when(F.col("active") & _holds(c.when), c.value)).alias(f"agg{k}") for k, c in enumerate(effects.contributions)
        ]
        computed = computed.observe(
            seen, F.count_if("active").alias("computed"), F.count_if(F.col("active") & F.col("new_halted")).alias("halted"), F.count_if(~F.col("active")).alias("inactive"),
            F.count_if(~F.col("new_halted")).alias("awake"), *partials,
        )
        stored, path = self.work.save(computed, "computed")
        computing = time.time_ns() - began
        got = seen.get
        for id in effects.remove_aggregators:
            if id in self.aggregators:
                self.aggregators.remove(id)
        for k, c in enumerate(effects.contributions):
            self.aggregators.contribute(c.id, c.kind, got[f"agg{k}"])
        stats = Stats(self.superstep, got["computed"] or 0, 0, got["halted"] or 0, got["inactive"] or 0, computing)
        awake = got["awake"] or 0
        messages, message_path = None, None
        sent = _messages(stored, self._edges, effects, program.message_type) if effects.sends else None
        if sent is not None:
            counted = Observation()
            messages, message_path = self.work.save(combine(sent, program.combiner).observe(counted, F.count("*").alias("n")), "messages")
            stats.sent = counted.get["n"] or 0
            if not stats.sent:
                self.work.drop(message_path)
                messages = message_path = None
        state = _own_columns(stored)
        edges_path = self._paths["edges"]
        state_path = path
        if effects.vertex_ops or effects.edge_ops:
            vertex_ops, edge_ops = _operations(stored, self._edges, effects, self.graph)
            before = PropertyGraph(state.select("id", "value", "mut"), self._edges().plain)
            after = apply_mutations(before, vertex_ops, edge_ops, program.handlers, few_removals(vertex_ops))
            # Vertices that the mutations made are awake; the others keep their vote.
            state = after.vertices.join(state.select("id", "halted"), "id", "left").withColumn("halted", F.coalesce("halted", F.lit(False)))
            seen = Observation()
            state, state_path = self.work.save(state.observe(seen, F.count_if(~F.col("halted")).alias("awake")), "state")
            awake = seen.get["awake"] or 0
            if awake + stats.sent or self._recording:
                counted = Observation()
                edges, new_edges = self.work.save(after.edges.observe(counted, F.count("*").alias("n")), "edges")
                rows = counted.get["n"] or 0
                self._garbage += [path, edges_path]
                edges_path = new_edges
            else:
                # The last superstep: nobody may ask for its edges, so they stay a plan over the tables before, which are kept.
                edges, rows = after.edges, self.graph.edge_rows
            self._undeal()
            self.graph = PropertyGraph(self.graph.vertices, edges, edge_rows=rows)
        self._garbage += [self._paths["state"], self._paths["messages"]]
        self._paths = {"state": state_path, "messages": message_path, "edges": edges_path}
        # Reading only the state's columns: later plans start from the stored files.
        self.state, self.messages = state, messages
        self._pending = awake + stats.sent
        stats.total_ns = time.time_ns() - began
        self.stats.append(stats)
        self.on_stats(stats)
        return stats

    def finished(self) -> bool:
        return self.superstep > 0 and self._pending == 0

    def run(self, record: bool = False) -> Run:
        self._recording = record
        try:
            while not self.finished():
                if self.superstep >= self.max_supersteps:
                    raise RuntimeError(f"{self.program.name}: not finished after {self.max_supersteps} supersteps")
                self.step()
                if record:
                    self._record()
                # Only now, as a recorded superstep must find its tables until the next one is recorded.
                while self._garbage:
                    self.work.drop(self._garbage.pop())
        finally:
            self._undeal()
        total = Stats()
        for s in self.stats:
            total.add(s)
        values = self.aggregators.frozen()
        result = self.program.result(values)
        return Run(self.state, self.graph.edges, self.aggregators, self.stats, result, self.program.display(result, self.program.params), total)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def run_program(spark: SparkSession, graph: PropertyGraph, program: VertexProgram, **options) -> Run:
    return SuperstepLoop(spark, graph, program, **options).run()
