"""Shortest-path challenge text: ``v id x y`` vertex lines and ``a from to weight`` edge lines.

Only a line's first character is tested, then it must hold exactly four tokens between single spaces. Numbers are signed base-10;
values out of range drop the line, as does everything else that doesn't fit. A trailing carriage return is not part of a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGER = "^[+-]?[0-9]+$"


def _tokens(lines: DataFrame, mark: str) -> DataFrame:
    line = F.regexp_replace("value", "\r$", "")
    cut = lines.where(F.substring("value", 1, 1) == mark).select(F.split(line, " ", -1).alias("t"))
    return cut.where(F.size("t") == 4)


def _number(token: Column, kind: str) -> Column:
    return F.when(token.rlike(INTEGER), token.try_cast(kind))


def parse_vertices(lines: DataFrame) -> DataFrame:
    """(id, value struct<x, y>) of the vertex lines among ``lines`` (value)."""
    x, y = _number(F.col("t")[2], "int"), _number(F.col("t")[3], "int")
    return _tokens(lines, "v").select(F.col("t")[1].alias("id"), x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL").select("id", F.struct("x", "y").alias("value"))


def parse_edges(lines: DataFrame) -> DataFrame:
    """(src, dst, value bigint) of the edge lines among ``lines`` (value)."""
    weight = _number(F.col("t")[3], "bigint")
    return _tokens(lines, "a").select(F.col("t")[1].alias("src"), F.col("t")[2].alias("dst"), weight.alias("value")).where("value IS NOT NULL")


VERTEX_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"dimacs": parse_vertices}
EDGE_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"dimacs": parse_edges}


def vertex_reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A reader of vertex files by format name; an unknown name is an error."""
    if name not in VERTEX_PARSERS:
        raise ValueError(f"unknown vertex parser {name!r}")
    return lambda spark, path: VERTEX_PARSERS[name](spark.read.text(path))


def edge_reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in EDGE_PARSERS:
        raise ValueError(f"unknown edge parser {name!r}")
    return lambda spark, path: EDGE_PARSERS[name](spark.read.text(path))
