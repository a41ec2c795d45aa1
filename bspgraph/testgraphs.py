"""Graphs derived from the driver's tables; parallel edges are folded first, as the model has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph.model import PropertyGraph
from bspgraph.operators.partitioning import task_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_edges(spark: SparkSession, sf_dir: str, both: bool = True) -> DataFrame:
    """Supplier to part, and back with ``both``, weighted by the least quantity."""
    line = table(spark, sf_dir, "lineitem")
    # Dealt before they are folded, over as many tasks as the rows need: pairs hardly repeat, so a map-side part would only hold them all.
    line = line.repartition(task_count(spark, line.count()), "l_suppkey", "l_partkey")
    pair = line.groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").cast("bigint").alias("value"))
    s, p = F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("P"), "l_partkey")
    if not both:
        return pair.select(s.alias("src"), p.alias("dst"), "value")
    ways = F.array(F.struct(s.alias("src"), p.alias("dst"), "value"), F.struct(p.alias("src"), s.alias("dst"), "value"))
    return pair.select(F.inline(ways))


def supply_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.lit(None).cast("bigint").alias("value"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.lit(None).cast("bigint").alias("value"))
    return s.unionByName(p)


def g1(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of(supply_vertices(spark, sf_dir), supply_edges(spark, sf_dir), edge_rows=2 * table(spark, sf_dir, "lineitem").count())


def g3(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph.of(supply_vertices(spark, sf_dir), supply_edges(spark, sf_dir, both=False), edge_rows=table(spark, sf_dir, "lineitem").count())


def g2(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customer nation to supplier nation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("dst"))
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = joined.groupBy("src", "dst").agg(F.min("l_quantity").cast("bigint").alias("value"))
    vertices = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.lit(None).cast("bigint").alias("value"))
    return PropertyGraph.of(vertices, edges)
