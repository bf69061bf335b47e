"""Tag clusters per window and how unusual their volume is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions.gamma import gamma_cdf
from pulseweave.lineage import broadcast_if_small

WINDOW = ("start_time_ms", "end_time_ms")
MIN_POSTS = 10
PRIOR_MS = 7 * 24 * 3600 * 1000
LIKELIHOOD_THRESHOLD = 0.7

# Prior weight of a term nothing is known about.
ALPHA_0, BETA_0 = 1e-5, 1.0


def cluster_id(data_type: Column, end_ms: Column, key: Column) -> Column:
    return F.concat_ws(":", data_type, end_ms.cast("string"), key)


def tag_rows(windowed: DataFrame) -> DataFrame:
    """One row per post and tag, tags in lower case; repeated tags are kept."""
    return windowed.where(F.col("hashtags").isNotNull()).select(
        *WINDOW, "post_id", F.explode("hashtags").alias("tag")
    ).select(*WINDOW, "post_id", F.lower("tag").alias("term"))


def hashtag_groups(windowed: DataFrame) -> DataFrame:
    """Posts per window and tag, next to the posts seen in the window.

    Counting is combined on the map side, so a tag that holds a third of all
    posts is no larger in the shuffle than any other.
    """
    groups = tag_rows(windowed).groupBy(*WINDOW, "term").agg(F.count("*").alias("size"))
    totals = (
        windowed.where(F.col("hashtags").isNotNull())
        .groupBy("end_time_ms")
        .agg(F.count("*").alias("total_posts"))
    )
    return groups.join(totals, "end_time_ms").select(*WINDOW, "term", "size", "total_posts")


def hashtag_priors(published: DataFrame, span_ms: int, prior_ms: int = PRIOR_MS) -> DataFrame:
    """Adds the Gamma prior of each term from its earlier published clusters.

    Earlier means ending between ``start - prior_ms`` and ``start``. Windows all
    have the same span, so the bounds are fixed offsets of the end time and one
    range window per term does it; a term has one row per window there.
    """
    width = span_ms - 1
    w = (
        Window.partitionBy("term")
        .orderBy("end_time_ms")
        .rangeBetween(-(width + prior_ms), -width)
    )
    return published.withColumn(
        "prior_alpha", F.lit(ALPHA_0) + F.coalesce(F.sum("size").over(w), F.lit(0))
    ).withColumn("prior_beta", F.lit(BETA_0) + F.coalesce(F.sum("total_posts").over(w), F.lit(0)))


def hashtag_likelihood(rows: DataFrame) -> DataFrame:
    """Probability of seeing at most this share of posts, given the prior."""
    share = F.col("size") / F.col("total_posts")
    return rows.withColumn(
        "likelihood", gamma_cdf(F.col("prior_beta"), F.col("prior_alpha"), share)
    )


def hashtag_clusters(
    windowed: DataFrame,
    span_ms: int,
    min_posts: int = MIN_POSTS,
    threshold: float = LIKELIHOOD_THRESHOLD,
    prior_ms: int = PRIOR_MS,
) -> DataFrame:
    """Published tag clusters with their anomaly score."""
    published = hashtag_groups(windowed).where(F.col("size") >= min_posts)
    scored = hashtag_likelihood(hashtag_priors(published, span_ms, prior_ms))
    return scored.withColumn(
        "is_unlikely", F.when(F.col("likelihood") > threshold, 1).otherwise(0)
    ).select(
        cluster_id(F.lit("hashtag"), F.col("end_time_ms"), F.col("term")).alias("cluster_id"),
        F.lit("hashtag").alias("data_type"),
        *WINDOW,
        "term",
        "size",
        "total_posts",
        "prior_alpha",
        "prior_beta",
        "likelihood",
        "is_unlikely",
    )


def hashtag_members(windowed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Member rows (cluster_id, post_id) of published clusters, repeats kept."""
    ids = clusters.select("end_time_ms", "term", "cluster_id", "data_type")
    return (
        tag_rows(windowed)
        .join(broadcast_if_small(ids), ["end_time_ms", "term"])
        .select("cluster_id", "data_type", "end_time_ms", "post_id")
    )
