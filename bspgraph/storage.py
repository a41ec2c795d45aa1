"""Tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset a temporary one is set in local mode (tests), and elsewhere it's an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="bspgraph-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return root.rstrip("/")


def write_table(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Store ``df`` and read it back: the plan starts anew from files that outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Workspace:
    """A run's own folder; ``save`` stores a table under a fresh name, ``drop`` deletes one that is superseded."""

    def __init__(self, spark: SparkSession, what: str, root: str | None = None):
        self.spark, self.root, self.n = spark, root or f"{shared_root(spark)}/bspgraph-runs/{what}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n:05d}-{name}"
        return write_table(self.spark, df, path), path

    def drop(self, path: str | None) -> None:
        if path:
            remove_path(self.spark, path)
