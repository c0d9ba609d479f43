"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds this package; workers on the same machine import it from there. On a cluster it is shipped with --py-files.
ROOT = str(Path(__file__).resolve().parents[2])


def importable(df: DataFrame) -> DataFrame:
    """The same table, whose Python workers can import this package."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one gets its own; a cluster must name one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayfold-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialises in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def by_trajectory(df: DataFrame, key: str = "traj_id") -> DataFrame:
    """Dealt out by trajectory to at least one partition per core.

    What follows is heavy for its bytes (geometry, folds), so small partitions shouldn't be put together.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
