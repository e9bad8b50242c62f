"""Session defaults for every entry point of the package."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # no stack capture per Column call: wide factor frames build thousands of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "quantloom", **conf) -> SparkSession:
    """Return the active session, or build one.

    On a cluster the submit command gives master, partitions and checkpoint folder; only what is
    unset falls back to the defaults above.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_spark(cores: int | str = 8, **conf) -> SparkSession:
    """Local session for tests and the bench."""
    base = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "12g"),
        "spark.driver.host": "127.0.0.1",
        # small inputs: let post-shuffle partitions stay as many as the cores
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    }
    return get_spark(f"local[{cores}]", **{**base, **conf})


def checkpoint(df, eager: bool = True):
    """Cut the lineage of an iterative job through the reliable checkpoint folder of the session.

    The cluster names the folder in ``spark.checkpoint.dir``; a private one is set only when the
    session has none (tests, local runs).
    """
    shared_folder(df.sparkSession, "checkpoint")
    return df.checkpoint(eager)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder for tables that outlive a stage, below the checkpoint folder of the session."""
    import uuid

    sc = spark.sparkContext
    root = sc._jsc.sc().getCheckpointDir()
    if root.isEmpty():
        checkpoint_root = spark.conf.get("spark.checkpoint.dir", None)
        if checkpoint_root is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            checkpoint_root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(checkpoint_root)
        root = sc._jsc.sc().getCheckpointDir()
    return f"{root.get()}/{tag}-{uuid.uuid4().hex}"


def materialise(df, tag: str = "stage", by=()):
    """Write a table to the shared folder and read it back: what builds it runs once, however often it is used, and its lineage is cut.

    ``by`` names columns of few values; a reader that asks for some of them opens only their files.
    """
    path = shared_folder(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
