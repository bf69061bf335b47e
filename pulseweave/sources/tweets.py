"""Tweets as posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseweave.functions.text import PROFILE_PREFIX, flat_spaces
from pulseweave.schemas import TWEET

# Tracked words of the live stream.
TRACK = ("police", "riot", "shooting", "protest", "march", "crowd", "gathering")


def tweet_lines(spark: SparkSession, path: str, glob: str = "*.json", schema=TWEET) -> DataFrame:
    """All lines of a folder as tweets; a line that is no JSON has only ``_broken``, its text."""
    lines = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]) if "_broken" not in schema.names else schema
    return spark.read.schema(lines).option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", glob).json(path)


def read_tweet_json_lines(
    spark: SparkSession, path: str, lang: str, glob: str = "*.json", schema=TWEET
) -> DataFrame:
    """Tweets of one language from a folder of JSON lines; broken lines are left out."""
    return tweet_lines(spark, path, glob, schema).where(F.col("_broken").isNull() & (F.col("lang") == lang)).drop("_broken")


def line_counts(lines: DataFrame) -> DataFrame:
    """Lines per language, and how many were broken (``lang`` null, ``broken`` true)."""
    return lines.groupBy("lang", F.col("_broken").isNotNull().alias("broken")).agg(F.count("*").alias("n_lines"))


def parse_tweets(raw: DataFrame, column: str = "value") -> DataFrame:
    return raw.select(F.from_json(column, TWEET).alias("t")).select("t.*")


def tweet_ingest(tweets: DataFrame, post_type: str = "twitter") -> DataFrame:
    """Tweet rows in the shape posts are handed to ingest in."""
    tags = F.transform("entities.hashtags", lambda h: h["text"])
    return tweets.select(
        F.col("id_str").alias("post_id"),
        F.lit(post_type).alias("post_type"),
        F.col("user.id_str").alias("author_id"),
        F.col("user.screen_name").alias("screen_name"),
        F.col("user.profile_image_url").alias("author_image_url"),
        "lang",
        "text",
        F.coalesce(tags, F.array().cast("array<string>")).alias("hashtags"),
        F.coalesce(
            "entities.urls", F.array().cast(TWEET["entities"].dataType["urls"].dataType)
        ).alias("image_urls"),
        F.col("created_at").alias("timestamp_ms"),
        F.concat(
            F.lit(PROFILE_PREFIX), F.col("user.screen_name"), F.lit("/status/"), F.col("id_str")
        ).alias("post_url"),
        "quoted_status",
        F.col("quoted_status_id_str").alias("quote_post_id"),
        F.col("retweeted_status.id_str").alias("broadcast_post_id"),
        F.col("in_reply_to_status_id_str").alias("reply_to_post_id"),
    )


def mentions_any(text: Column, track: Sequence[str] = TRACK) -> Column:
    """The text holds one of the tracked words as a whole word, tags included."""
    plain = F.regexp_replace(flat_spaces(F.lower(text)), r"[^\p{L}\p{N}_ ]", " ")
    return F.arrays_overlap(F.split(plain, " "), F.array(*[F.lit(w) for w in track]))


def keyword_track(posts: DataFrame, track: Sequence[str] = TRACK, text: str = "text") -> DataFrame:
    return posts.where(mentions_any(F.col(text), track))
