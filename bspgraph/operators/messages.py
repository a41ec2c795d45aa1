"""One superstep's message algebra: send along edges, combine, deliver, and who takes part."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Combiner = Callable[[Column], Column]
#: Messages of one partition that a ``Fold`` takes together; a power of two.
RUN = 4096


@dataclass(frozen=True)
class Fold:
    """A combiner from any associative and commutative binary step; prefer built-in aggregates, which combine before the shuffle."""

    step: Callable[[Column, Column], Column]

    def __call__(self, message: Column) -> Column:
        held = F.collect_list(message)
        return F.aggregate(F.slice(held, 2, F.size(held)), held[0], self.step)


def fold(step: Callable[[Column, Column], Column]) -> Fold:
    return Fold(step)


COMBINERS: dict[str, Combiner] = {"min": F.min, "max": F.max, "sum": F.sum, "and": F.bool_and, "or": F.bool_or}


def send_along_edges(senders: DataFrame, edges: DataFrame, message: Column) -> DataFrame:
    """(to, msg) for every out-edge of every sender; columns are the sender's and ``dst``, ``weight``, ``edge_mut``."""
    out = edges.select(F.col("src").alias("id"), "dst", F.col("value").alias("weight"), F.col("mut").alias("edge_mut") if "mut" in edges.columns else F.lit(None).alias("edge_mut"))
    return senders.join(out, "id").select(F.col("dst").alias("to"), message.alias("msg"))


def combine(messages: DataFrame, combiner: Combiner) -> DataFrame:
    """One message per target. Catalyst splits the aggregate into a sender-side and a receiver-side part.

    A ``Fold`` has no such parts: its messages are folded in runs of ``RUN`` at most first, so that no row holds all those of a hot target.
    """
    if isinstance(combiner, Fold):
        run = F.call_function("shiftright", F.monotonically_increasing_id(), F.lit(RUN.bit_length() - 1))
        messages = messages.withColumn("_run", run).groupBy("to", "_run").agg(combiner(F.col("msg")).alias("msg"))
    return messages.groupBy("to").agg(combiner(F.col("msg")).alias("msg"))


def deliver(vertices: DataFrame, inbox: DataFrame, strict: bool = True) -> DataFrame:
    """Vertices with their message or NULL. With ``strict`` a message to an id that is no vertex fails the plan."""
    left = vertices.withColumn("_there", F.lit(True))
    if not strict:
        return left.join(inbox, left["id"] == inbox["to"], "left").drop("to", "_there")
    both = left.join(inbox, left["id"] == inbox["to"], "full_outer")
    lost = F.raise_error(F.concat(F.lit("message to missing vertex "), F.col("to")))
    return both.withColumn("id", F.when(F.col("_there").isNull(), lost).otherwise(F.col("id"))).drop("to", "_there")


def missing_targets(vertices: DataFrame, messages: DataFrame) -> DataFrame:
    """Distinct message targets that aren't vertices."""
    return messages.select(F.col("to").alias("id")).distinct().join(vertices.select("id"), "id", "left_anti")


def is_active(halted: Column, message: Column) -> Column:
    """A vertex is skipped only when it has voted to halt and nothing arrived since."""
    return ~halted | message.isNotNull()
