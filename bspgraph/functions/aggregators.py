"""Global aggregators: folded over the vertices of a superstep, cumulative over a job, shown to the next superstep.

A type names a Spark aggregate (evaluated in the superstep's own job) and a merge of two partial values on the driver, where only
one value per aggregator ever arrives. The first contribution initialises: there is no identity that could hide a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AggregatorType:
    name: str
    column: Callable[[Column], Column]
    merge: Callable[[Any, Any], Any]
    coerce: Callable[[Any], Any]


def to_int64(value: Any) -> int:
    """Any integral value in the 64-bit range; all else is an error."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{value!r} is no integer")
    if not -(2**63) <= value < 2**63:
        raise OverflowError(f"{value} exceeds 64 bits")
    return value


def to_bool(value: Any) -> bool:
    if not isinstance(value, bool):
        raise TypeError(f"{value!r} is no boolean")
    return value


_types: dict[str, AggregatorType] = {}


def register(kind: AggregatorType) -> None:
    if kind.name in _types:
        raise ValueError(f"aggregator type {kind.name!r} is registered already")
    _types[kind.name] = kind


def aggregator_type(name: str) -> AggregatorType:
    if name not in _types:
        raise ValueError(f"unknown aggregator type {name!r}")
    return _types[name]


register(AggregatorType("and", F.bool_and, lambda a, b: a and b, to_bool))
register(AggregatorType("or", F.bool_or, lambda a, b: a or b, to_bool))
register(AggregatorType("minInt", lambda c: F.min(c.cast("bigint")), min, to_int64))
register(AggregatorType("maxInt", lambda c: F.max(c.cast("bigint")), max, to_int64))
register(AggregatorType("sumInt", lambda c: F.sum(c.cast("bigint")), lambda a, b: to_int64(a + b), to_int64))


class AggregatorSet:
    """Values by aggregator id, each with its type."""

    def __init__(self, held: Mapping[str, tuple[str, Any]] | None = None):
        self._held: dict[str, tuple[str, Any]] = dict(held or {})

    def add(self, id: str, kind: str, value: Any = None) -> None:
        if id in self._held:
            raise ValueError(f"aggregator {id!r} is there already")
        self._held[id] = (kind, None if value is None else aggregator_type(kind).coerce(value))

    def remove(self, id: str) -> None:
        if id not in self._held:
            raise KeyError(f"no aggregator {id!r}")
        del self._held[id]

    def clear(self) -> None:
        self._held.clear()

    def set_value(self, id: str, value: Any) -> None:
        """Fold ``value`` in; the aggregator must exist."""
        if id not in self._held:
            raise KeyError(f"no aggregator {id!r}")
        kind, old = self._held[id]
        t = aggregator_type(kind)
        value = t.coerce(value)
        self._held[id] = (kind, value if old is None else t.merge(old, value))

    def contribute(self, id: str, kind: str, value: Any) -> None:
        """Fold ``value`` in, adding the aggregator on first use; a later call's type is ignored. None contributes nothing."""
        if value is None:
            return
        if id not in self._held:
            self.add(id, kind)
        self.set_value(id, value)

    def union_with(self, other: AggregatorSet) -> None:
        for id, (kind, value) in other._held.items():
            if id not in self._held:
                self._held[id] = (kind, value)
                continue
            if self._held[id][0] != kind:
                raise TypeError(f"aggregator {id!r} is {self._held[id][0]} here and {kind} there")
            if value is not None:
                self.set_value(id, value)

    def value(self, id: str) -> Any:
        if id not in self._held:
            raise KeyError(f"no aggregator {id!r}")
        return self._held[id][1]

    def clone(self) -> AggregatorSet:
        return AggregatorSet(self._held)

    def frozen(self) -> ImmutableAggregators:
        return ImmutableAggregators({k: v for k, (_, v) in self._held.items()})

    def to_dict(self) -> dict[str, list]:
        return {k: [t, v] for k, (t, v) in self._held.items()}

    @staticmethod
    def from_dict(held: Mapping[str, list]) -> AggregatorSet:
        return AggregatorSet({k: (t, v) for k, (t, v) in held.items()})

    def __contains__(self, id: str) -> bool:
        return id in self._held

    def __len__(self) -> int:
        return len(self._held)

    def __iter__(self) -> Iterator[str]:
        return iter(self._held)


class ImmutableAggregators(Mapping):
    """The previous superstep's values; an absent id reads as None through ``get``, and ``literal`` puts one into a plan."""

    def __init__(self, values: Mapping[str, Any]):
        self._values = dict(values)

    def __getitem__(self, id: str) -> Any:
        return self._values[id]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def literal(self, id: str, kind: str = "bigint") -> Column:
        return F.lit(self._values.get(id)).cast(kind)
