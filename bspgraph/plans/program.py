"""Vertex programs: what one vertex does in one superstep, written as Column expressions.

``compute`` gets a context of columns (id, value, mut, msg) and the superstep's literals and returns its effects; every effect is an
expression over the active vertices, so a whole superstep is one Catalyst plan. ``PandasProgram`` is the way out for logic that
expressions can't say: it computes the same effects from Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from bspgraph.functions.aggregators import ImmutableAggregators
from bspgraph.operators.messages import Combiner
from bspgraph.operators.mutations import Handlers

ALWAYS = None


@dataclass(frozen=True)
class Context:
    """Columns of the vertex at work and what the superstep knows."""

    superstep: int
    aggregators: ImmutableAggregators
    params: Mapping[str, Any]
    id: Column = field(default_factory=lambda: F.col("id"))
    value: Column = field(default_factory=lambda: F.col("value"))
    mut: Column = field(default_factory=lambda: F.col("mut"))
    msg: Column = field(default_factory=lambda: F.col("msg"))
    #: of the edge, in expressions of ``Effects.along_edges``
    dst: Column = field(default_factory=lambda: F.col("dst"))
    weight: Column = field(default_factory=lambda: F.col("weight"))
    edge_mut: Column = field(default_factory=lambda: F.col("edge_mut"))


@dataclass(frozen=True)
class SendAlong:
    """A message to the target of every out-edge of the vertices for which ``when`` holds."""

    message: Column
    when: Column | None = ALWAYS


@dataclass(frozen=True)
class SendTo:
    """A message to any vertex id."""

    to: Column
    message: Column
    when: Column | None = ALWAYS


@dataclass(frozen=True)
class Contribution:
    """A value folded into the aggregator ``id``; NULL contributes nothing."""

    id: str
    kind: str
    value: Column
    when: Column | None = ALWAYS


@dataclass(frozen=True)
class VertexOp:
    """An operation on any vertex: type, id and, as the type needs, the new value or mutable value."""

    type: int
    id: Column
    value: Column | None = None
    mut: Column | None = None
    when: Column | None = ALWAYS


@dataclass(frozen=True)
class EdgeOp:
    """An operation on the edge (src, dst). With ``along_edges`` it is issued once per out-edge and may use the edge's columns."""

    type: int
    src: Column
    dst: Column
    value: Column | None = None
    mut: Column | None = None
    when: Column | None = ALWAYS
    along_edges: bool = False


@dataclass(frozen=True)
class Effects:
    halt: Column
    #: the vertex's own new mutable value; None leaves it
    mut: Column | None = None
    sends: tuple[SendAlong | SendTo, ...] = ()
    contributions: tuple[Contribution, ...] = ()
    vertex_ops: tuple[VertexOp, ...] = ()
    edge_ops: tuple[EdgeOp, ...] = ()
    #: aggregators to forget before this superstep's contributions
    remove_aggregators: tuple[str, ...] = ()


@dataclass(frozen=True)
class VertexProgram:
    name: str
    compute: Callable[[Context], Effects]
    result: Callable[[Mapping[str, Any]], Any]
    display: Callable[[Any, Mapping[str, Any]], str]
    combiner: Combiner | None = None
    message_type: str = "bigint"
    mut_type: str = "bigint"
    edge_mut_type: str = "bigint"
    handlers: Handlers = Handlers()
    params: Mapping[str, Any] = field(default_factory=dict)
    #: DDL of extra columns and a function over Arrow-fed pandas batches that adds them before ``compute`` reads them
    pandas: tuple[str, Callable] | None = None


_programs: dict[str, Callable[[Mapping[str, Any]], VertexProgram]] = {}


def register_program(name: str, factory: Callable[[Mapping[str, Any]], VertexProgram]) -> None:
    if name in _programs:
        raise ValueError(f"program {name!r} is registered already")
    _programs[name] = factory


def program(name: str, params: Mapping[str, Any] | None = None) -> VertexProgram:
    """The program ``name`` with its parameters; an unknown name is an error."""
    if name not in _programs:
        raise ValueError(f"unknown program {name!r}")
    return _programs[name](params or {})


def has_program(name: str) -> bool:
    return name in _programs
