"""From posts to exported events in one chain of DataFrames, all windows at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.operators import events as ev
from pulseweave.operators import clustering, enrich, graph, hashtags, links, windows
from pulseweave.operators.vectorjobs import MEDIUM_SIZE


@dataclass(frozen=True)
class Settings:
    span_ms: int = windows.DEFAULT_SPAN_MS
    origin_ms: int = 0
    min_window_posts: int = windows.MIN_POSTS
    min_cluster_posts: int = hashtags.MIN_POSTS
    likelihood_threshold: float = hashtags.LIKELIHOOD_THRESHOLD
    min_overlap: float = links.MIN_OVERLAP
    min_clusters: int = ev.MIN_CLUSTERS
    campaign_threshold: float = ev.CAMPAIGN_THRESHOLD
    min_match_score: float = ev.MIN_MATCH_SCORE
    geo_threshold: float = ev.GEO_THRESHOLD
    prune: bool = True
    seed: str = ""


@dataclass(frozen=True)
class Detection:
    """The tables a run leaves behind."""

    clusters: DataFrame
    members: DataFrame
    links: DataFrame
    partition: DataFrame
    events: DataFrame
    hashtags: DataFrame
    keywords: DataFrame
    urls: DataFrame
    images: DataFrame
    campaigns: DataFrame
    locations: DataFrame
    exports: DataFrame


def gated_windows(posts: DataFrame, s: Settings) -> DataFrame:
    """Windowed posts of the windows that hold enough of them."""
    windowed = windows.tumbling_windows(posts, s.span_ms, s.origin_ms)
    open_windows = windows.window_min_posts_gate(windowed, s.min_window_posts).select("end_time_ms")
    return windowed.join(open_windows, "end_time_ms", "left_semi")


def vector_cluster_tables(
    vectors: DataFrame, data_type: str, threshold: float, vector: str = "vector"
) -> tuple[DataFrame, DataFrame]:
    """Published clusters and their members from windowed post vectors.

    ``vectors`` holds post_id, lang, timestamp_ms, start_time_ms, end_time_ms and the
    vector. Clusters of fewer than four posts are not published.
    """
    window = ["start_time_ms", "end_time_ms", "lang"]
    found = clustering.leader_clusters(vectors, window, "post_id", "timestamp_ms", vector, threshold)
    name = F.concat_ws(":", F.lit(data_type), "end_time_ms", F.coalesce("lang", F.lit("")), F.col("leader").cast("string"))
    rows = found.select(
        name.alias("cluster_id"), F.lit(data_type).alias("data_type"), "start_time_ms", "end_time_ms", "post_id"
    )
    clusters = rows.groupBy("cluster_id", "data_type", "start_time_ms", "end_time_ms").agg(F.count("*").alias("size"))
    clusters = materialize(clusters.where(F.col("size") >= MEDIUM_SIZE), "vector-clusters")
    members = rows.join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return clusters, members.select("cluster_id", "data_type", "end_time_ms", "post_id")


def place_entities(picked: DataFrame, places: DataFrame) -> DataFrame:
    """Places named in the events' posts, each post looked at once: (event_id, cluster_id, post_id, label)."""
    names = places.select(F.col("place").alias("label"), F.lit("LOCATION").alias("tag"))
    posts = picked.select("post_id", "text").dropDuplicates(["post_id"])
    found = enrich.extract_entities(posts, "post_id", "text", names, "LOCATION")
    return found.join(picked.select("event_id", "cluster_id", "post_id"), "post_id")


def detect_events(
    posts: DataFrame,
    s: Settings = Settings(),
    vector_clusters: DataFrame | None = None,
    vector_members: DataFrame | None = None,
    places: DataFrame | None = None,
    communities: Callable[[DataFrame], DataFrame] | None = None,
) -> Detection:
    """Runs the whole chain on a post table.

    Clusters of text and image vectors, made by ``vector_cluster_tables``, join in
    through ``vector_clusters`` and ``vector_members``. ``places`` is a gazetteer
    (place, city, state, country, latitude, longitude). ``communities`` may replace
    Louvain by another rule from edges to (g, node, community). Only events of
    ``min_clusters`` clusters are stored; exports are made of all.
    """
    windowed = gated_windows(posts, s)
    tag_posts = windowed.where(F.col("featurizer") == "hashtag")
    clusters = hashtags.hashtag_clusters(
        tag_posts, s.span_ms, s.min_cluster_posts, s.likelihood_threshold
    )
    clusters = materialize(clusters, "clusters")
    members = hashtags.hashtag_members(tag_posts, clusters)
    if vector_clusters is not None and vector_members is not None:
        clusters = clusters.unionByName(vector_clusters, allowMissingColumns=True)
        members = members.unionByName(vector_members)
    # Read several times below; written once as a table.
    members = materialize(members, "members")
    found = materialize(links.cluster_links(members, s.min_overlap), "links")
    likely, kept = links.prune_unlikely(clusters, found) if s.prune else (clusters, found)
    edges = kept.select(F.col("end_time_ms").alias("g"), "source", "target", "weight")
    # A linked cluster that lost all its links stays, as a community of its own.
    ends = [found.select(F.col("end_time_ms").alias("g"), F.col(e).alias("node")) for e in ("source", "target")]
    nodes = ends[0].union(ends[1]).distinct()
    nodes = nodes.join(likely.select(F.col("cluster_id").alias("node")), "node", "left_semi")
    partition = graph.louvain_communities(edges, nodes=nodes) if communities is None else communities(edges)

    ec = materialize(ev.event_clusters(partition, clusters), "event-clusters")
    rolled = ev.event_rollup(ec)
    tags = ev.event_hashtags(ec)
    sampled = materialize(ev.sampled_event_posts(ec, members, posts, seed=s.seed), "sampled-posts")
    words = materialize(ev.word_counts(ev.event_words(sampled)), "event-words")
    keywords = ev.event_keywords(words)
    campaigns = ev.event_campaigns(ec, sampled)
    stored = ev.event_size_gate(rolled, s.min_clusters)
    matched = ev.match_prior_events(stored, ev.event_tag_weights(ec), min_score=s.min_match_score)
    if places is not None:
        locations = ev.event_locations(place_entities(sampled, places), places, s.geo_threshold)
    else:
        locations = rolled.sparkSession.createDataFrame(
            [], "event_id string, label string, lat double, lng double, weight double"
        )
    urls, images = ev.event_urls(words), ev.event_images(ec, members, posts)
    exports = ev.export_events(rolled, tags, keywords, campaigns, locations, s.campaign_threshold, urls, images)
    return Detection(
        clusters, members, found, partition, matched, tags, keywords, urls, images, campaigns, locations, exports,
    )
