"""Reading and writing document collections in any Spark format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_collection(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_collection(
    df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options: str
) -> None:
    writer = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def explode_event_clusters(events: DataFrame, since_ms: int) -> DataFrame:
    """Events from a time on, one row per cluster id."""
    return events.where(F.col("start_time_ms") >= since_ms).select(
        "event_id", "start_time_ms", "end_time_ms", F.explode("cluster_ids").alias("cluster_id")
    )


# Fixed value: how far before a slice of posts its clusters are exported too.
SLICE_LOOKBACK_MS = 7 * 24 * 3600 * 1000


def export_time_slice(
    posts: DataFrame, clusters: DataFrame, lo: int, hi: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts worked on in [lo, hi], clusters of the week before, and the posts reset to new."""
    sliced = posts.where((F.col("state") != "new") & F.col("timestamp_ms").between(lo, hi))
    earlier = clusters.where(
        (F.col("start_time_ms") >= lo - SLICE_LOOKBACK_MS) & (F.col("start_time_ms") < lo)
    )
    return sliced, earlier, sliced.withColumn("state", F.lit("new"))


def active_feeds_delta(feeds: DataFrame, running: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feeds to start, and ids of running feeds to stop."""
    active = feeds.where(F.col("active"))
    added = active.join(running.select("feed_id"), "feed_id", "left_anti")
    removed = running.select("feed_id").join(active.select("feed_id"), "feed_id", "left_anti")
    return added, removed


def change_feed(changes: DataFrame, matches: Column, created_only: bool = False) -> DataFrame:
    """Change records (``type`` create or update) that meet a condition; works on streams."""
    kinds = ["create"] if created_only else ["create", "update"]
    return changes.where(F.col("type").isin(kinds) & matches)
