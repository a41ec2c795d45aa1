"""Vertex ranges: how many partitions a graph needs, and token-range predicates over a hash ring of signed 64-bit tokens."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: rows of a table that one task holds in a hash map, so that its memory doesn't grow with the table
TASK_ROWS = 2**20
#: ranges that one expression compares a token with
TREE_RANGES = 256


def round_half_away(x: float) -> int:
    return math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1)


def partition_count(rows: int, task_vertices: int) -> int:
    return max(1, round_half_away(rows / task_vertices))


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows that are hashed or aggregated: the session's number, or more where a task would get over ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), partition_count(rows, TASK_ROWS))


def token(column: Column) -> Column:
    return F.xxhash64(column)


def _countable(n: int) -> None:
    if not 1 <= n < 2**31:
        raise ValueError(f"{n} ranges; 64-bit arithmetic takes 1 to 2^31 - 1")


@dataclass(frozen=True)
class TokenRange:
    """(start, end] on the ring. start == end is the full ring, start > end wraps, and start == LOWEST takes the lowest token in."""

    start: int
    end: int

    def parts(self) -> list[tuple[int, int]]:
        if self.start == self.end:
            return [(LOWEST, HIGHEST)]
        if self.start > self.end:
            return [(self.start, HIGHEST), (LOWEST, self.end)]
        return [(self.start, self.end)]

    def predicate(self, column: Column) -> Column:
        at = token(column)
        one = lambda a, b: ((at >= a) if a == LOWEST else (at > a)) & (at <= b)
        return reduce(lambda p, q: p | q, [one(a, b) for a, b in self.parts()])


def ring_ranges(n: int) -> list[TokenRange]:
    """``n`` disjoint ranges that cover the ring evenly."""
    if n == 1:
        return [TokenRange(LOWEST, LOWEST)]
    cuts = [LOWEST + (2**64) * k // n for k in range(n)] + [HIGHEST]
    return [TokenRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def ring_number(at: Column, n: int) -> Column:
    """The number, from 0, of the one of ``ring_ranges(n)`` that holds the token ``at``: the same few operations however many ranges there are."""
    _countable(n)
    # The token counted from LOWEST is high * 2^32 + low; times n over 2^64 is top / 2^32 and what is left of it.
    high = F.shiftright(at, 32) + F.lit(2**31)
    low = at.bitwiseAND(F.lit(2**32 - 1)) * F.lit(n)
    top = high * F.lit(n) + F.shiftright(low, 32)
    whole = (top.bitwiseAND(F.lit(2**32 - 1)) == 0) & (low.bitwiseAND(F.lit(2**32 - 1)) == 0)
    # A range holds its end, not its start: a token that is a cut belongs to the range before, but for the lowest one.
    return F.greatest(F.shiftright(top, 32) - F.when(whole, F.lit(1)).otherwise(F.lit(0)), F.lit(0)).cast("bigint")


def ring_cut(number: Column, n: int) -> Column:
    """Start of range ``number`` of ``ring_ranges(n)``, and end of the one before; HIGHEST for ``number`` n. As long division by 32-bit digits."""
    _countable(n)
    div = lambda a: F.call_function("div", a, F.lit(n).cast("bigint"))
    first = F.greatest(F.least(number.cast("bigint"), F.lit(n - 1)), F.lit(0)) * F.lit(2**32)  # within bounds, so that nothing overflows
    second = (first % F.lit(n)) * F.lit(2**32)
    cut = (div(first) - F.lit(2**31)) * F.lit(2**32) + div(second)
    return F.when(number < n, cut).otherwise(F.lit(HIGHEST))


def in_ring_range(at: Column, number: Column, n: int) -> Column:
    """Whether range ``number`` of ``ring_ranges(n)`` holds the token ``at``, by the range's own bounds; no number outside 0 to n - 1 holds any."""
    start, end = ring_cut(number, n), ring_cut(number + 1, n)
    return number.between(0, n - 1) & ((number == 0) | (at > start)) & (at <= end)


def split_range(whole: TokenRange, rows: int, share: float, per_split: int) -> list[TokenRange]:
    """``whole`` cut by a row budget, assuming an even spread; one split or fewer keeps it."""
    n = round_half_away(rows * share / per_split)
    if n <= 1:
        return [whole]
    out = []
    for a, b in whole.parts():
        cuts = [a + (b - a) * k // n for k in range(n)] + [b]
        out += [TokenRange(x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
    return out


def scan_range(df: DataFrame, key: str, wanted: TokenRange) -> DataFrame:
    """Rows of ``df`` in a range, one filter over the key."""
    return df.where(wanted.predicate(F.col(key)))


def dealt(df: DataFrame, key: str, rows: int, task_vertices: int) -> DataFrame:
    """``df`` hash-partitioned by ``key`` into as many tasks as its rows need."""
    return df.repartition(partition_count(rows, task_vertices), key)


def range_table(spark: SparkSession, ranges: list[TokenRange]) -> DataFrame:
    """(range_id, start, end); ids start at 1."""
    return spark.createDataFrame([(k + 1, r.start, r.end) for k, r in enumerate(ranges)], "range_id bigint, start bigint, end bigint")


def ring_table(spark: SparkSession, n: int) -> DataFrame:
    """``range_table`` of ``ring_ranges(n)``, made by tasks and not by the driver."""
    number = F.col("id")
    end = F.lit(LOWEST) if n == 1 else ring_cut(number + 1, n)  # start == end is the full ring
    return spark.range(n).select((number + 1).alias("range_id"), ring_cut(number, n).alias("start"), end.alias("end"))


def located(df: DataFrame, key: str, ranges: list[TokenRange]) -> DataFrame:
    """``df`` with the ``range_id`` of each row's token among disjoint ``ranges``, NULL outside them.

    A tree of comparisons for up to ``TREE_RANGES`` of them; a plan can't hold more, so they become a table, met by the token's leading bits.
    """
    parts = sorted((a, b, k + 1) for k, r in enumerate(ranges) for a, b in r.parts())
    if len(parts) > TREE_RANGES:
        return _joined(df, key, parts)
    at = token(F.col(key))

    def search(low: int, high: int) -> Column:
        if high - low == 1:
            start, end, id = parts[low]
            return F.when((at >= start if start == LOWEST else at > start) & (at <= end), F.lit(id).cast("bigint"))
        middle = (low + high) // 2
        return F.when(at <= parts[middle - 1][1], search(low, middle)).otherwise(search(middle, high))

    return df.withColumn("range_id", search(0, len(parts)) if parts else F.lit(None).cast("bigint"))


def _joined(df: DataFrame, key: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """Each part is repeated for the slices of the ring that it touches: fewer than twice as many slices as parts, so fewer than three rows a part."""
    shift = 64 - max(1, min(31, (len(parts) - 1).bit_length()))
    table = df.sparkSession.createDataFrame(parts, "_start bigint, _end bigint, range_id bigint")
    table = table.withColumn("_slice", F.explode(F.sequence(F.shiftright("_start", shift), F.shiftright("_end", shift))))
    at = F.col("_token")
    held = ((at > F.col("_start")) | (F.col("_start") == LOWEST)) & (at <= F.col("_end"))
    rows = df.withColumn("_token", token(F.col(key))).withColumn("_at", F.shiftright("_token", shift))
    return rows.join(table, (F.col("_at") == F.col("_slice")) & held, "left").select(*df.columns, "range_id")
