"""Connected components of an edge table.

Up to ``ONE_TASK_ROWS`` counted edges are settled by one task's union-find; more are settled by alternating large-star and
small-star rounds, all of them distributed. Both give the same rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.shared import Scratch

ONE_TASK_ROWS = 300_000


def _union_find(batches):
    up: dict = {}

    def find(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    kind = pa.binary()
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], ["node", "root"])


def _stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One large-star and one small-star round over (a, b) with a < b.

    The lowest neighbours are tables of their own, so that the join with a node's many neighbours can be split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    large = scratch.save(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct(), "large")
    low = scratch.save(large.groupBy("b").agg(F.min("a").alias("m")), "low")
    joined = large.join(low, "b")
    small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").unionByName(joined.select(F.col("m").alias("a"), "b"))
    out = scratch.save(small.distinct(), "stars")
    for x in (least, large, low):
        scratch.drop(x)
    return out


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the smallest node of its component and has a row itself.

    Self-links and repeated edges are allowed; an empty table gives an empty result. The rounds end when the edge set stays
    the same, which takes about the logarithm of the longest chain.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    if now.count() <= one_task_rows:
        kind = now.schema["a"].dataType
        return now.coalesce(1).mapInArrow(_union_find, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    now = scratch.save(now.distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        new = _stars(now, scratch)
        got = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = new
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
