"""From raw posts and feed items to the post table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.operators.ordering import with_row_index

REQUIRED = ("post_id", "post_type", "post_url", "timestamp_ms")
POST_KEY = ("post_id", "featurizer")


def missing_fields(required: Sequence[str] = REQUIRED) -> Column:
    """Names of the required fields a row lacks."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def validate_posts(
    df: DataFrame, required: Sequence[str] = REQUIRED
) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with a ``reasons`` column."""
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    valid = df.where(complete)
    rejected = df.where(~complete).withColumn("reasons", missing_fields(required))
    return valid, rejected


# The formats post times arrive in, after the weekday is cut.
TIME_FORMATS = ("MMM d HH:mm:ss Z yyyy", "d MMM yyyy HH:mm:ss Z")


def time_to_ms(value: Column) -> Column:
    """Epoch millis of a time given as millis or as date text; null if neither."""
    text = F.trim(value.cast("string"))
    spelled = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},? ", ""), r" (GMT|UTC|Z)$", " +0000")
    parsed = F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(spelled, F.lit(f)) for f in TIME_FORMATS]
    )
    as_number = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    return F.coalesce(as_number, F.unix_millis(parsed))


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))


def normalize_posts(df: DataFrame) -> DataFrame:
    """New state, time as epoch millis, empty text and arrays instead of nulls."""
    return df.withColumns(
        {
            "state": F.lit("new"),
            "timestamp_ms": time_to_ms(F.col("timestamp_ms")),
            "text": F.coalesce(F.col("text"), F.lit("")),
            "image_urls": _or_empty(df, "image_urls"),
            "hashtags": _or_empty(df, "hashtags"),
        }
    )


def merge_quoted_status(df: DataFrame) -> DataFrame:
    """Fold a quoted post's tags, text and media into the post, then drop it.

    The quoted text is appended only where the quoted post has a tag list.
    """
    tags = F.col("quoted_status.entities.hashtags")
    media = F.col("quoted_status.entities.media")
    quoted_text = F.col("quoted_status.text")
    return df.withColumns(
        {
            "hashtags": F.when(
                tags.isNotNull(),
                F.concat(_or_empty(df, "hashtags"), F.transform(tags, lambda h: h["text"])),
            ).otherwise(F.col("hashtags")),
            "text": F.when(
                tags.isNotNull() & (F.coalesce(F.length(quoted_text), F.lit(0)) > 0),
                F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(" "), quoted_text),
            ).otherwise(F.col("text")),
            "image_urls": F.when(
                F.size(media) > 0,
                F.concat(
                    _or_empty(df, "image_urls"),
                    F.transform(media, lambda m: F.struct(m["expanded_url"].alias("expanded_url"))),
                ),
            ).otherwise(F.col("image_urls")),
        }
    ).drop("quoted_status")


def fan_out_featurizers(df: DataFrame) -> DataFrame:
    """One row per kind of content the post has: text, image, hashtag."""
    kinds = F.array_compact(
        F.array(
            F.when(F.length("text") > 0, F.lit("text")),
            F.when(F.size("image_urls") > 0, F.lit("image")),
            F.when(F.size("hashtags") > 0, F.lit("hashtag")),
        )
    )
    return df.drop("featurizer").withColumn("featurizer", F.explode(kinds))


def dedupe_posts(df: DataFrame, arrival: str, key: Sequence[str] = POST_KEY) -> DataFrame:
    """The first arrival per key; ties of arrival are told apart by content.

    The ranked filter keeps one row per key on the map side already.
    """
    rest = [
        F.col(f"`{c}`") for c in df.columns if c not in key and c != arrival and _orderable(df, c)
    ]
    w = Window.partitionBy(*key).orderBy(arrival, *rest)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _orderable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def govern_traffic(
    df: DataFrame, rate: float | None, order: Sequence[str], on: bool = True, drop_all: bool = False
) -> DataFrame:
    """Let one of every ``ceil(1/rate) + 1`` arrivals through."""
    if rate is not None and (rate == 0 or rate > 1):
        raise ValueError("rate must be above 0 and at most 1")
    if drop_all:
        return df.limit(0)
    if not on or rate is None:
        return df
    cycle = math.ceil(1 / rate) + 1
    indexed = with_row_index(df, order, "_arrival")
    return indexed.where(F.col("_arrival") % cycle == cycle - 1).drop("_arrival")


def feed_item_dedupe(
    items: DataFrame, existing: DataFrame, order: str, key: Sequence[str] = ("guid", "extractType")
) -> DataFrame:
    """New feed items only, the first per key, without the capture date."""
    fresh = items.join(existing.select(*key), list(key), "left_anti")
    return dedupe_posts(fresh, order, key).drop("dc:date.taken")


def feed_to_posts(items: DataFrame, post_type: str = "rss") -> DataFrame:
    """Unprocessed feed items as English text posts."""
    return items.where(~F.coalesce(F.col("processed"), F.lit(False))).select(
        F.col("guid").alias("post_id"),
        F.lit(post_type).alias("post_type"),
        F.col("link").alias("post_url"),
        F.coalesce(F.col("description"), F.lit("")).alias("text"),
        time_to_ms(F.col("pubdate")).alias("timestamp_ms"),
        F.lit("en").alias("lang"),
        F.lit("text").alias("featurizer"),
        F.lit("new").alias("state"),
    )


def mark_processed(items: DataFrame) -> DataFrame:
    return items.withColumn("processed", F.lit(True))


def capture_image_refs(posts: DataFrame, pages: DataFrame, image_url: str) -> DataFrame:
    """Image posts with their links joined, and the image of the first link that has one.

    ``pages`` gives ``url`` and the image column of fetched pages.
    """
    urls = F.transform("image_urls", lambda u: u["expanded_url"])
    refs = (
        posts.where(F.col("featurizer") == "image")
        .withColumn("urls", F.array_join(urls, ","))
        .where(F.col("urls") != "")
    )
    found = (
        refs.select("post_id", F.posexplode(urls).alias("pos", "url"))
        .join(pages.where(F.col(image_url).isNotNull()).select("url", image_url), "url")
        .groupBy("post_id")
        .agg(F.min_by(image_url, "pos").alias("primary_image_url"))
    )
    return refs.select("post_id", "urls").join(found, "post_id", "left")


def ingest(df: DataFrame) -> DataFrame:
    """Stateless part of ingest, the same for tables and streams."""
    valid, _ = validate_posts(df)
    posts = normalize_posts(valid)
    if "quoted_status" in posts.columns:
        posts = merge_quoted_status(posts)
    return fan_out_featurizers(posts)


__all__ = [
    "capture_image_refs", "dedupe_posts", "fan_out_featurizers", "feed_item_dedupe",
    "feed_to_posts", "govern_traffic", "ingest", "mark_processed", "merge_quoted_status",
    "missing_fields", "normalize_posts", "time_to_ms", "validate_posts",
]
