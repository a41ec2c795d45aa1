"""A Bloom filter of fixed size as a table: it spares rows that surely have no partner from being shuffled to a join.

The table has at most ``BITS / 32768`` rows of 4 KiB whatever the data, which is the proven bound that lets it be broadcast. When
more keys come than the bits can tell apart it lets more rows pass, never fewer, and the join that follows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25


def bloom(keys: DataFrame, key: Column) -> DataFrame:
    """(bucket, bits) of the keys' hashes."""
    at = (F.pmod(key, F.lit(BITS)) + 1).alias("p")
    return keys.select(at).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))


def with_maybe(df: DataFrame, table: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``_maybe``: false where the key is surely not in the filter."""
    rows = df.withColumn("_p", F.pmod(key, F.lit(BITS)) + 1)
    joined = rows.join(F.broadcast(table), F.bitmap_bucket_number("_p") == table["bucket"], "left")
    bit = F.bitmap_bit_position("_p")
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_p", "bucket", "bits")
