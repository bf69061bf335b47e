"""Queries behind the event, cluster and network views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions.hashing import sample_key
from pulseweave.lineage import broadcast_if_small
from pulseweave.operators.query import latest_by_key


def overlaps(start: str, end: str, lo: int, hi: int) -> Column:
    s, e = F.col(start), F.col(end)
    return e.between(lo, hi) | s.between(lo, hi) | ((s <= lo) & (e >= hi))


def events_in_range(events: DataFrame, lo: int, hi: int) -> DataFrame:
    return events.where(overlaps("start_time_ms", "end_time_ms", lo, hi)).orderBy("start_time_ms")


def events_with_network_flag(events: DataFrame, networks: DataFrame) -> DataFrame:
    known = networks.select("event_id", F.lit(1).alias("_has")).distinct()
    return events.join(known, "event_id", "left").withColumn(
        "has_user_network", F.coalesce("_has", F.lit(0))
    ).drop("_has")


def event_timeline(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events per start time in time order, and the extents of that curve."""
    counts = events.groupBy("start_time_ms").agg(F.count("*").alias("n_events"))
    extent = counts.agg(
        F.min("start_time_ms").alias("min_date"),
        F.max("start_time_ms").alias("max_date"),
        F.lit(0).alias("min_count"),
        F.max("n_events").alias("max_count"),
    )
    return counts.orderBy("start_time_ms"), extent


def link_timeline(monitors: DataFrame, links: DataFrame) -> DataFrame:
    """Links per linker window in time order, from the first window that has any."""
    windows = monitors.where(F.col("featurizer") == "linker").select("end_time_ms")
    counts = links.groupBy("end_time_ms").agg(F.count("*").alias("n"))
    curve = windows.join(counts, "end_time_ms", "left").select(
        "end_time_ms", F.coalesce("n", F.lit(0)).alias("n_links")
    )
    first = curve.where(F.col("n_links") > 0).agg(F.min("end_time_ms")).scalar()
    return (
        curve.withColumn("_first", first)
        .where(F.col("end_time_ms") >= F.col("_first"))
        .drop("_first")
        .orderBy("end_time_ms")
    )


def sampled_event_members(
    event_clusters: DataFrame, members: DataFrame, n: int | None = None, seed: str = ""
) -> DataFrame:
    """Distinct posts per event; with ``n`` at most that many repeatable random ones."""
    rows = (
        event_clusters.select("event_id", "cluster_id")
        .join(members.select("cluster_id", "post_id"), "cluster_id")
        .select("event_id", "post_id")
        .distinct()
    )
    if n is None:
        return rows
    w = Window.partitionBy("event_id").orderBy(sample_key(F.col("post_id"), seed), "post_id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def search_events(
    events: DataFrame, hashtags: DataFrame, sampled_posts: DataFrame, pattern: str
) -> DataFrame:
    """Events whose tags, texts or author names match, ignoring case.

    ``sampled_posts`` holds (event_id, text, screen_name).
    """
    rx = f"(?i){pattern}"
    by_tag = hashtags.where(F.col("term").rlike(rx)).select("event_id")
    by_post = sampled_posts.where(F.col("text").rlike(rx) | F.col("screen_name").rlike(rx)).select(
        "event_id"
    )
    return events.join(by_tag.unionByName(by_post).distinct(), "event_id", "left_semi")


def _given(name: str) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False))


def post_type_mix(posts: DataFrame) -> DataFrame:
    """Posts per kind; a broadcast that is also a quote counts as broadcast."""
    kind = (
        F.when(_given("broadcast_post_id"), "retweet")
        .when(_given("quote_post_id"), "quote")
        .when(_given("reply_to_post_id"), "reply")
        .otherwise("direct")
    )
    return posts.groupBy(kind.alias("label")).agg(F.count("*").alias("n_posts"))


def distinct_refs(posts: DataFrame) -> DataFrame:
    ref = F.when(_given("broadcast_post_id"), F.col("broadcast_post_id")).otherwise(
        F.when(_given("quote_post_id"), F.col("quote_post_id"))
    )
    return posts.select(ref.alias("ref")).where("ref is not null").distinct().agg(
        F.count("*").alias("referred_to")
    )


def top_broadcasts(posts: DataFrame, n: int = 10) -> DataFrame:
    return (
        posts.where(_given("broadcast_post_id"))
        .groupBy(F.col("broadcast_post_id").alias("label"))
        .agg(F.count("*").alias("n_posts"))
        .orderBy(F.col("n_posts").desc(), "label")
        .limit(n)
    )


def posts_by_author(sampled: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts of the sampled set by author name, upper and lower case alike."""
    return posts.join(sampled.select("post_id").distinct(), "post_id", "left_semi").orderBy(
        F.lower("screen_name"), "post_id"
    )


def author_timeline(posts: DataFrame, screen_name: str) -> DataFrame:
    return (
        posts.where((F.col("screen_name") == screen_name) & (F.col("featurizer") == "text"))
        .select("post_id", "text", "screen_name", "timestamp_ms")
        .orderBy(F.col("timestamp_ms").desc(), "post_id")
    )


def unique_member_posts(members: DataFrame) -> DataFrame:
    return members.where(F.col("post_id").isNotNull()).select("post_id").distinct()


def unique_image_urls(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("primary_image_url").isNotNull()).select("primary_image_url").distinct()


def monitor_cluster_counts(
    monitors: DataFrame, clusters: DataFrame, n: int = 10, featurizer: str | None = None
) -> DataFrame:
    """The latest monitors with their cluster counts, the page's and the grand total."""
    if featurizer is not None:
        monitors = monitors.where(F.col("featurizer") == featurizer)
    page = monitors.orderBy(F.col("start_time_ms").desc(), "monitor_id").limit(n)
    counts = clusters.groupBy("monitor_id").agg(F.count("*").alias("n"))
    rows = page.join(counts, "monitor_id", "left").select(
        "monitor_id", "start_time_ms", F.coalesce("n", F.lit(0)).alias("n_clusters")
    )
    return rows.withColumn("page_total", F.sum("n_clusters").over(Window.partitionBy())).withColumn(
        "grand_total", clusters.agg(F.count("*")).scalar()
    )


def cluster_post_details(members: DataFrame, posts: DataFrame) -> DataFrame:
    """Each member post of a cluster with the one field its kind is shown by."""
    shown = (
        F.when(F.col("data_type") == "image", F.col("primary_image_url"))
        .when(F.col("data_type") == "text", F.col("text"))
        .when(F.col("data_type") == "hashtag", F.array_join("hashtags", ","))
    )
    kind = posts.withColumnRenamed("featurizer", "data_type")
    return members.join(kind, ["post_id", "data_type"]).select(
        "cluster_id", "post_id", shown.alias("detail"), "post_url"
    )


def links_between(links: DataFrame, lo: int, hi: int) -> DataFrame:
    return links.where(F.col("end_time_ms").between(lo, hi))


def top_pairs_label(pairs: Column, n: int = 2) -> Column:
    """First terms of an array of (term, weight) pairs in one line."""
    return F.array_join(F.transform(F.slice(pairs, 1, n), lambda p: p["term"]), ", ")


def ops_counts(events: DataFrame, posts: DataFrame, job_sets: DataFrame) -> DataFrame:
    """Totals of events, posts, running windows and featurized posts."""
    post_totals = posts.agg(
        F.count("*").alias("n_posts"), F.count_if(F.col("state") == "featurized").alias("n_featurized")
    )
    return post_totals.select(
        events.agg(F.count("*")).scalar().alias("n_events"),
        "n_posts",
        job_sets.agg(F.count_if(F.col("state") == "running")).scalar().alias("n_running"),
        "n_featurized",
    )


def annotate_events(events: DataFrame, annotations: DataFrame) -> DataFrame:
    """Events with the latest annotation of each campaign; a name given there wins."""
    latest = latest_by_key(
        annotations, ["campaign", "event_id"], [F.col("modified").desc(), F.col("name").asc()]
    )
    notes = latest.select("event_id", "campaign", F.col("name").alias("_name"), "relevant")
    return (
        events.join(notes, "event_id", "left")
        .withColumn("name", F.coalesce("_name", "name"))
        .drop("_name")
    )


def geocoded_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("geocoded"))


def pending_networks(events: DataFrame, networks: DataFrame) -> DataFrame:
    done = networks.where(F.col("status") == 1).select("event_id")
    return events.join(broadcast_if_small(done), "event_id", "left_anti")
