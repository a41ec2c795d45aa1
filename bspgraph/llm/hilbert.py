"""Operator 5: shards cut from a Hilbert-curve order of several metadata dimensions, in DataFrame functions only.

Each dimension is quantised to ``bits`` bits at its quantiles, so hot values spread no wider than they must. The cell
of a row gives its index on the Hilbert curve; rows are range-partitioned and sorted by (index, crc of the text, id), numbered
globally by broadcast partition offsets and cut into runs whose row counts are at most one apart. Texts never move: only ids, sizes and
codes do, and the sort key ends in the id, so no key can be hot.

Cases: null metadata sorts before all values; null and empty texts have size 1 and crc 0; repeated rows take a slot each; fewer
rows than shards leave some shards empty; an empty table gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bspgraph.llm.shared import Scratch


def _trailing_ones(i: int) -> int:
    n = 0
    while i & 1:
        n, i = n + 1, i >> 1
    return n


def curve_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """By rank along a cell of ``dims`` dimensions: inverse of the Gray code, entry corner, direction."""
    gray = [i ^ (i >> 1) for i in range(1 << dims)]
    inverse = [gray.index(g) for g in range(1 << dims)]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(1 << dims)]
    direction = [0 if w == 0 else _trailing_ones(w - 1 if w % 2 == 0 else w) % dims for w in range(1 << dims)]
    return inverse, entry, direction


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of a cell given by one non-negative code below ``2**bits`` per dimension."""
    d = len(codes)
    mask = (1 << d) - 1
    inverse, entry, direction = ([F.lit(x) for x in t] for t in curve_tables(d))
    inverse, entry, direction = F.array(*inverse), F.array(*entry), F.array(*direction)

    def rotate(x: Column, by: Column) -> Column:
        """x rotated right by ``by`` (0 to d) in d bits."""
        return F.call_function("shiftright", x, by).bitwiseOR(F.call_function("shiftleft", x, F.lit(d) - by)).bitwiseAND(F.lit(mask))

    cell = F.array(*codes)

    def level(state: Column, bit: Column) -> Column:
        corner = F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.lit(0), lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", F.get(cell, k), bit).bitwiseAND(F.lit(1)), k)))
        turn = state["turn"] + 1
        rank = F.get(inverse, rotate(corner.bitwiseXOR(state["corner"]), turn))
        left = F.lit(d) - turn
        return F.struct(
            state["corner"].bitwiseXOR(rotate(F.get(entry, rank), left)).alias("corner"),
            ((state["turn"] + F.get(direction, rank) + 1) % d).alias("turn"),
            (state["h"] * (1 << d) + rank).alias("h"),
        )

    start = F.struct(F.lit(0).alias("corner"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, level, lambda s: s["h"])


def rows_before(sizes: DataFrame) -> DataFrame:
    """(p, before) of (p, n), which has one row a partition: the rows in partitions of smaller number."""
    return sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))


def value_bounds(scratch: Scratch, df: DataFrame, name: str, bits: int) -> list:
    """The values at which the row counts, cumulated in value order, pass each ``2**bits``-th of all rows: fewer than ``2**bits``."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ordered = scratch.save(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("p", F.spark_partition_id()), f"values-{name}")
    total = ordered.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return []
    offsets = F.broadcast(scratch.save(rows_before(ordered.groupBy("p").agg(F.sum("n").alias("n"))), f"offsets-{name}"))
    upto = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ordered.select("p", "v", "n", upto.alias("upto")).join(offsets, "p").withColumn("upto", F.col("upto") + F.col("before"))
    least, most = (F.expr(f"({x} << {bits}) div {total}") for x in ("(upto - n)", "upto"))
    return sorted(r.v for r in placed.where((most > least) & (least + 1 < 1 << bits)).select("v").collect())


def quantile_bin(value: Column, bounds: list) -> Column:
    """How many of the bounds the value has reached; 0 for null."""
    return F.coalesce(reduce(lambda a, b: a + b, [(value >= b).cast("int") for b in bounds]), F.lit(0)) if bounds else F.lit(0)


def hilbert_shards(
    spark: SparkSession, docs: DataFrame, shards: int = 8, bits: int = 4, id_column: str = "doc_id", text_column: str = "text", dimensions: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """(id, size, text_crc32, curve, rank, shard, slot): the string columns of ``dimensions`` and the size place a row."""
    scratch = Scratch(spark, "hilbert")
    text = F.coalesce(F.col(text_column), F.lit(""))
    strings = [c for c in dimensions if c in docs.columns]
    base = docs.select(F.col(id_column).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), *[F.col(c).cast("string").alias(f"d{k}") for k, c in enumerate(strings)])
    base = scratch.save(base, "metadata")
    codes = [quantile_bin(F.col(c), value_bounds(scratch, base, c, bits)) for c in [*(f"d{k}" for k in range(len(strings))), "size"]]
    placed = base.select("id", "size", "crc", hilbert_index(codes, bits).alias("curve"))
    ordered = placed.repartitionByRange("curve", "crc", F.col("id").asc_nulls_first()).sortWithinPartitions("curve", "crc", F.col("id").asc_nulls_first())
    rows = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    scratch.drop(base)
    # Rows before each partition: a table of as many rows as there are partitions.
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    offsets = scratch.save(rows_before(rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"))), "offsets")
    total = rows.count()
    rows = rows.join(F.broadcast(offsets), part == offsets["p"])
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), "curve", rank.alias("rank"))
    out = out.withColumn("shard", F.expr(f"int(rank * {shards} div {max(total, 1)})"))
    # The first rank of shard s is the ceiling of s * total / shards.
    return out.withColumn("slot", F.expr(f"rank - (bigint(shard) * {total} + {shards - 1}) div {shards}"))


def _oracle(bits: int = 4, shards: int = 8) -> str:
    """The query op5 in DuckDB SQL; checksums byte by byte with the table of the polynomial, the curve level by level."""
    inverse, entry, direction = ([*t] for t in curve_tables(3))
    rotate = lambda x, by: f"((({x}) >> ({by})) | (({x}) << (3 - ({by})))) & 7"
    steps = ["p0 AS (SELECT c AS i, CAST(c AS BIGINT) AS c FROM range(256) x(c))"]
    for k in range(8):
        steps.append(f"p{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM p{k})")
    steps.append("crc_table AS (SELECT list(c ORDER BY i) AS t FROM p8)")
    steps.append("""d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang AS d0, source AS d1, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS d2,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents)""")
    steps.append("crcs AS (SELECT r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM d, crc_table)")
    for k in range(3):
        steps.append(f"n{k} AS (SELECT d{k} AS v, count(*) AS n FROM d WHERE d{k} IS NOT NULL GROUP BY 1)")
        steps.append(f"u{k} AS (SELECT v, n, CAST(sum(n) OVER (ORDER BY v) AS BIGINT) AS upto, CAST(sum(n) OVER () AS BIGINT) AS total FROM n{k})")
        steps.append(f"b{k} AS (SELECT v FROM u{k} WHERE ((upto << {bits}) // total) > (((upto - n) << {bits}) // total) AND ((upto - n) << {bits}) // total + 1 < {1 << bits})")
    cell = ", ".join(f"(SELECT count(*) FROM b{k} WHERE d.d{k} >= b{k}.v) AS c{k}" for k in range(3))
    steps.append(f"h{bits} AS (SELECT r, {cell}, CAST(0 AS BIGINT) AS corner, CAST(0 AS BIGINT) AS turn, CAST(0 AS BIGINT) AS h FROM d)")
    for bit in reversed(range(bits)):
        corner = " | ".join(f"(((c{k} >> {bit}) & 1) << {k})" for k in range(3))
        rank = f"({inverse})[({rotate(f'xor({corner}, corner)', 'turn + 1')}) + 1]"
        steps.append(f"g{bit} AS (SELECT *, {rank} AS rank FROM h{bit + 1})")
        steps.append(f"h{bit} AS (SELECT r, c0, c1, c2, xor(corner, {rotate(f'({entry})[rank + 1]', '2 - turn')}) AS corner, (turn + ({direction})[rank + 1] + 1) % 3 AS turn, h * 8 + rank AS h FROM g{bit})")
    steps.append("o AS (SELECT d.doc_id, d.d2 AS size, crc, h, row_number() OVER (ORDER BY h, crc, d.doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS total FROM d JOIN crcs ON d.r = crcs.r JOIN h0 ON d.r = h0.r)")
    return f"""WITH {", ".join(steps)}
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(rank * {shards} // total AS INTEGER) AS shard,
  CAST(rank - ((rank * {shards} // total) * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(h AS BIGINT) AS curve FROM o"""


ORACLE = _oracle()
