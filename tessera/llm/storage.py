"""Shared folders for intermediate tables.

Driver and executors share only the folder that the session names in
``spark.checkpoint.dir``; a folder of our own is used just where that setting
is missing and everything runs on one machine (tests). Tables that a call needs
only while it runs are deleted before it returns; those behind a returned
DataFrame stay until the folder is cleared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, set to a local one if unset and
    driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tessera-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that no other call gets."""
    return f"{shared_root(spark)}/tessera-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what lies above."""
    return Scratch(df.sparkSession).stored(df, tag)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


class Scratch:
    """Tables that one call writes and reads again, and then deletes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(fresh_folder(self.spark, tag))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self, keep: int = 0) -> None:
        """Delete all tables but the last `keep`."""
        for path in self.paths[: len(self.paths) - keep]:
            system, target = _file_system(self.spark, path)
            system.delete(target, True)
        del self.paths[: len(self.paths) - keep]
