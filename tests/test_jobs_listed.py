"""The job list over a whole table of orders."""

import os

import pytest
from pyspark.sql import functions as F

from bspgraph.jobs import listed

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_orders_are_listed_without_one_task_for_all(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    jobs = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("").alias("label"), F.col("o_orderdate").alias("creation_time"), (F.col("o_orderkey") % 7).alias("status"))
    out = listed(jobs)
    want = sorted((r.creation_time, r.id) for r in jobs.collect())
    assert [(r.position, r.id) for r in out.orderBy("position").collect()] == [(k + 1, i) for k, (_, i) in enumerate(want)]
    assert len(want) > 400
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_no_jobs(spark):
    assert listed(spark.createDataFrame([], "id string, label string, creation_time timestamp, status int")).count() == 0
