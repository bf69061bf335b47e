"""Cutting lineage of iterative jobs through shared storage, and size checks.

A cut is a Parquet table in the folder named by ``spark.checkpoint.dir``, so a
lost executor never forces the earlier rounds to run again, and the planner
gets true sizes for the next round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's scratch folder, below ``spark.checkpoint.dir`` or else the warehouse.

    A cluster has to name the former, so that every executor reaches it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not configured:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = spark.conf.get("spark.sql.warehouse.dir")
    return f"{configured.rstrip('/')}/pulseweave-scratch/{sc.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to its scratch folder; for the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to shared storage, at ``path`` if given, and read it back."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of this application's scratch folder that nothing reads any more."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError(f"{path} is not in this application's scratch folder")
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` in bytes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only where the estimated size is below the limit.

    Beyond the limit the frame is returned as it is, and the join shuffles.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads a scan that has fewer partitions than there are cores.

    A small or badly split file would keep all but a few cores idle in jobs that
    spend their time on expressions. Large tables have partitions enough and
    are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, *keys) if parts < cores else df
