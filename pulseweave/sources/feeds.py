"""Syndication feeds and image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType(
    [
        T.StructField("guid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("pubDate", T.StringType()),
        T.StructField("dc:date.taken", T.StringType()),
    ]
)


def rss_source(spark: SparkSession, path: str, extract_type: str, schema: T.StructType = ITEM) -> DataFrame:
    """Items of the feeds in ``path``, tagged with the feed's extract type."""
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return items.withColumnRenamed("pubDate", "pubdate").withColumns(
        {"extractType": F.lit(extract_type), "processed": F.lit(False)}
    )


def binary_image_source(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,gif}") -> DataFrame:
    """Image files of a folder with their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def write_image_features(vectors: DataFrame, path: str) -> None:
    """Vectors as JSON lines ``{image, features}``."""
    vectors.select(F.col("path").alias("image"), F.col("vector").alias("features")).write.mode(
        "append"
    ).json(path)
