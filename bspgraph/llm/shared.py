"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset a temporary one is set in local mode (tests), and elsewhere it's an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="bspgraph-")
            context.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/bspgraph/{what}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    path = path or fresh_path(spark, what)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, most: int = 1 << 20) -> None:
    """Send texts to Python some megabytes at a time for the rest of the session: a batch counted in rows alone has no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def files_for(total: int, each: int, least: int = 1) -> int:
    return min(max(least, -(-total // each)), 2**31 - 1)


def few_files(df: DataFrame, total: int, each: int, least: int | None = None) -> DataFrame:
    """``df``, made from ``total`` bytes, in no more partitions than one for ``each`` bytes, as each one written is a file.

    Nothing is shuffled, and large inputs, whose partitions hold more, stay as they are. ``least`` is by default two a core.
    """
    return df.coalesce(files_for(total, each, 2 * df.sparkSession.sparkContext.defaultParallelism if least is None else least))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them: no scan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class Scratch:
    """Named intermediate tables of one operator; each can be dropped once its readers are done."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, fresh_path(spark, what), 0

    def save(self, df: DataFrame, what: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}-{what}"
        out = materialize(self.spark, df, what, path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            remove(self.spark, path)


def open_filesystem(root: str):
    """(pyarrow filesystem, path in it) of a shared folder; usable on executors."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root)
