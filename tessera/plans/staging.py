"""Intermediate tables that end lineage, in the session's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def _root(spark) -> str:
    """The session's shared folder; one of our own is right only where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or f"file://{tempfile.gettempdir()}/tessera-checkpoints"


def staged(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of `df` under spark.checkpoint.dir; a folder of our
    own is set only where that setting is missing."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_root(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(spark, path: str) -> None:
    """Deletes a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def workspace(spark, tag: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{_root(spark).rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"
