"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode one of our own if none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Cuts lineage by writing tables as Parquet; they survive the loss of executors.

    The tables go when the session's JVM ends, or earlier through `drop`.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}
        path, files = self._resolve(self.base)
        files.deleteOnExit(path)

    def _resolve(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame) -> DataFrame:
        """Write `df` and return the written table.

        Spark knows its size, so later joins are broadcast only below
        spark.sql.autoBroadcastJoinThreshold.
        """
        self._count += 1
        name = f"{self.base}/{self._count:03d}"
        df.write.parquet(name)
        kept = self.spark.read.schema(df.schema).parquet(name)
        self._paths[id(kept)] = name
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        name = self._paths.pop(id(kept), None)
        if name:
            path, files = self._resolve(name)
            files.delete(path, True)
