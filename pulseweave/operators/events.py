"""Rolling communities of clusters up into events, matching and exporting them.

An event is kept in normal form: one row of totals, and rows per hashtag,
keyword, url, image, campaign, location and cluster. Only lists with a fixed
upper length (top terms) are ever gathered in an array.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions.clock import iso_from_ms
from pulseweave.functions.hashing import sample_key
from pulseweave.functions.text import STOPWORDS_EN, display_tokens, remove_punctuation, url_of, word_kind
from pulseweave.lineage import broadcast_if_small

MIN_CLUSTERS = 3
TOP_TERMS = 100
MIN_WORD_COUNT = 5
GEO_THRESHOLD = 5.0
MIN_MATCH_SCORE = 0.6
CAMPAIGN_THRESHOLD = 0.7

# How much each part of a place name weighs.
CITY_WEIGHT, STATE_WEIGHT, COUNTRY_WEIGHT = 1.0, 0.1, 0.05


def event_id(g: Column, community: Column) -> Column:
    return F.concat_ws("|", g.cast("string"), community.cast("string"))


def event_clusters(partition: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clusters of each event: (event_id, cluster_id, …cluster columns)."""
    part = partition.select(
        event_id(F.col("g"), F.col("community")).alias("event_id"), F.col("node").alias("cluster_id")
    )
    return part.join(clusters, "cluster_id")


def event_rollup(ec: DataFrame) -> DataFrame:
    return ec.groupBy("event_id").agg(
        F.lit("default").alias("name"),
        F.count("*").alias("n_clusters"),
        F.sum("size").alias("topic_message_count"),
        F.min("start_time_ms").alias("start_time_ms"),
        F.max("end_time_ms").alias("end_time_ms"),
        F.lit(1.0).alias("importance_score"),
    )


def event_size_gate(events: DataFrame, min_clusters: int = MIN_CLUSTERS) -> DataFrame:
    return events.where(F.col("n_clusters") >= min_clusters)


def top_terms(terms: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The heaviest terms per event, ranked."""
    w = Window.partitionBy("event_id").orderBy(F.col("weight").desc(), "term")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def event_tag_weights(ec: DataFrame) -> DataFrame:
    """All tags of each event with their weight: what matching compares."""
    tags = ec.where(F.col("data_type") == "hashtag").groupBy("event_id", "term")
    return tags.agg(F.max("size").alias("weight"))


def event_hashtags(ec: DataFrame, n: int = TOP_TERMS) -> DataFrame:
    """The heaviest tags of each event, as views and messages list them."""
    return top_terms(event_tag_weights(ec), n)


def sample_cluster_posts(members: DataFrame, n: int, seed: str = "", key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """At most ``n`` repeatable random member rows per cluster.

    The ranked filter is applied per map task first, so a huge cluster sends on
    ``n`` rows per task and not its members.
    """
    w = Window.partitionBy(*key).orderBy(sample_key(F.col("post_id"), seed), "post_id")
    return members.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def _chosen(members: DataFrame, n: int | None, seed: str) -> DataFrame:
    """All distinct member rows, or those of a sample per cluster."""
    rows = members.select("cluster_id", "post_id")
    return (rows if n is None else sample_cluster_posts(rows, n, seed)).distinct()


def sampled_event_posts(
    ec: DataFrame, members: DataFrame, posts: DataFrame, n: int | None = None, seed: str = ""
) -> DataFrame:
    """Posts of text and tag clusters, of the cluster's own kind; all of them unless ``n`` asks for a sample."""
    wanted = ec.where(F.col("data_type") != "image").select("event_id", "cluster_id", "data_type")
    picked = _chosen(members, n, seed).join(wanted, "cluster_id")
    return picked.join(
        posts.withColumnRenamed("featurizer", "data_type"), ["post_id", "data_type"]
    )


def event_words(sampled: DataFrame, stopwords: Iterable[str] = STOPWORDS_EN) -> DataFrame:
    """Display tokens of the events' posts without stop words, with their kind.

    A post is tokenized once, however many clusters it is in; its words go to its clusters
    as one row and become rows there.
    """
    keys = ["post_id", "data_type"]
    texts = sampled.select(*keys, "text", "lang").dropDuplicates(keys)
    posts = texts.select(*keys, display_tokens(F.col("text"), F.col("lang")).alias("words"))
    places = sampled.select("event_id", "cluster_id", *keys).join(posts, keys)
    words = places.select("event_id", "cluster_id", "post_id", F.explode("words").alias("word"))
    return words.where(~F.col("word").isin(list(stopwords))).withColumn("kind", word_kind(F.col("word")))


def word_counts(words: DataFrame) -> DataFrame:
    """How often (``n``) each cluster of an event has a word: what keywords and urls need of ``event_words``."""
    return words.groupBy("event_id", "cluster_id", "word", "kind").agg(F.count("*").alias("n"))


def event_keywords(words: DataFrame, min_count: int = MIN_WORD_COUNT, n: int = TOP_TERMS) -> DataFrame:
    """Words (or their ``word_counts``) counted per cluster, rare ones dropped, then added up per event."""
    seen = F.sum("n") if "n" in words.columns else F.count("*")
    per_cluster = (
        words.where(F.col("kind") == "word")
        .groupBy("event_id", "cluster_id", "word")
        .agg(seen.alias("n"))
        .where(F.col("n") >= min_count)
    )
    merged = per_cluster.groupBy("event_id", remove_punctuation(F.col("word")).alias("term")).agg(
        F.sum("n").alias("weight")
    )
    return top_terms(merged, n)


def event_urls(words: DataFrame) -> DataFrame:
    return words.where(F.col("kind") == "url").select("event_id", url_of(F.col("word")).alias("url")).distinct()


def event_images(ec: DataFrame, members: DataFrame, posts: DataFrame, n: int | None = None, seed: str = "") -> DataFrame:
    """Distinct pictures of the events' posts, the first one of each post."""
    picked = (
        _chosen(members, n, seed)
        .join(ec.select("event_id", "cluster_id"), "cluster_id")
        .select("event_id", "post_id")
        .distinct()
    )
    pictures = (
        posts.where(F.col("primary_image_url").isNotNull())
        .groupBy("post_id")
        .agg(F.min_by("primary_image_url", "featurizer").alias("image_url"))
    )
    return picked.join(pictures, "post_id").select("event_id", "image_url").distinct()


def event_campaigns(ec: DataFrame, sampled: DataFrame, n: int | None = None) -> DataFrame:
    """Share of the posts that carry each campaign; ``n`` is the size of the sample, if it is one."""
    size = F.col("size") if n is None else F.least("size", F.lit(n))
    totals = (
        ec.where(F.col("data_type") != "image")
        .groupBy("event_id")
        .agg(F.sum(size).alias("total"))
    )
    counts = (
        sampled.select("event_id", F.explode("campaigns").alias("campaign"))
        .groupBy("event_id", "campaign")
        .agg(F.count("*").alias("mentions"))
    )
    return counts.join(totals, "event_id").select(
        "event_id", "campaign", (F.col("mentions") / F.col("total")).alias("share")
    )


def place_label(city: Column, state: Column, country: Column) -> Column:
    """Name of a place from the parts it has."""
    return F.concat(
        F.coalesce(F.concat(city, F.lit(" ")), F.lit("")),
        F.coalesce(F.concat(state, F.lit(" ")), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), country, F.lit(" ")), F.lit("")),
    )


def place_weight(city: Column, state: Column, country: Column) -> Column:
    def part(col: Column, weight: float) -> Column:
        return F.when(col.isNotNull(), weight).otherwise(0.0)

    return part(city, CITY_WEIGHT) + part(state, STATE_WEIGHT) + part(country, COUNTRY_WEIGHT)


def event_locations(
    entities: DataFrame, places: DataFrame, threshold: float = GEO_THRESHOLD
) -> DataFrame:
    """Weighted places per event.

    ``entities`` holds (event_id, post_id, label) of location entities, and
    ``places`` one geocoded row per label: place, city, state, country,
    latitude, longitude. Weights are added up over all clusters first and
    compared with the threshold afterwards.
    """
    name = F.lower(F.trim("label"))
    found = entities.withColumn("place", name).join(broadcast_if_small(places), "place")
    parts = (F.col("city"), F.col("state"), F.col("country"))
    return (
        found.withColumn("name", place_label(*parts))
        .withColumn("w", place_weight(*parts))
        .groupBy("event_id", "name")
        .agg(
            F.sum("w").alias("weight"),
            F.min_by("latitude", F.struct("post_id", "place")).alias("lat"),
            F.min_by("longitude", F.struct("post_id", "place")).alias("lng"),
        )
        .where(F.col("weight") >= threshold)
        .select("event_id", F.col("name").alias("label"), "lat", "lng", "weight", F.lit("point").alias("geo_type"))
    )


def match_scores(events: DataFrame, hashtags: DataFrame, prior: DataFrame, prior_hashtags: DataFrame) -> DataFrame:
    """Score of each event against each event of the window just before that shares a tag."""
    sums = hashtags.groupBy("event_id").agg(F.sum("weight").alias("_sum"))
    prior_sums = prior_hashtags.groupBy("event_id").agg(F.sum("weight").alias("_sum"))
    now = (
        events.select("event_id", (F.col("start_time_ms") - 1).alias("meets"))
        .join(hashtags.select("event_id", "term", "weight"), "event_id")
        .join(sums, "event_id")
        .select("event_id", "meets", "term", (F.col("weight") / F.col("_sum")).alias("w"))
    )
    before = (
        prior.select("event_id", F.col("end_time_ms").alias("meets"))
        .join(prior_hashtags.select("event_id", "term", "weight"), "event_id")
        .join(prior_sums, "event_id")
        .select(
            F.col("event_id").alias("prior_id"), "meets", "term",
            (F.col("weight") / F.col("_sum")).alias("pw"),
        )
    )
    return (
        now.join(before, ["meets", "term"])
        .groupBy("event_id", "prior_id")
        .agg(F.round(F.sum(F.col("w") * F.col("pw")), 9).alias("score"))
    )


def best_match(scores: DataFrame, min_score: float = MIN_MATCH_SCORE) -> DataFrame:
    """The best prior event of each event, if it is good enough."""
    return (
        scores.where(F.col("score") >= min_score)
        .groupBy("event_id")
        .agg(
            F.min_by("prior_id", F.struct(-F.col("score"), F.col("prior_id"))).alias("sibling_id"),
            F.max("score").alias("score"),
        )
    )


def match_prior_events(
    events: DataFrame, hashtags: DataFrame, prior: DataFrame | None = None,
    prior_hashtags: DataFrame | None = None, min_score: float = MIN_MATCH_SCORE,
) -> DataFrame:
    """Events with the ``sibling_id`` of their match among the window before."""
    scores = match_scores(
        events, hashtags, prior if prior is not None else events,
        prior_hashtags if prior_hashtags is not None else hashtags,
    )
    return events.join(best_match(scores, min_score).select("event_id", "sibling_id"), "event_id", "left")


def _ranked_terms(terms: DataFrame, name: str) -> DataFrame:
    """At most the fixed number of top terms per event, as one ordered array."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return terms.groupBy("event_id").agg(F.transform(listed, lambda t: t["term"]).alias(name))


def _first_links(rows: DataFrame | None, column: str, name: str, n: int) -> DataFrame | None:
    """The first ``n`` links of each event by name, as one array."""
    if rows is None:
        return None
    w = Window.partitionBy("event_id").orderBy(column)
    first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return first.groupBy("event_id").agg(F.array_sort(F.collect_list(column)).alias(name))


def export_events(
    events: DataFrame,
    hashtags: DataFrame,
    keywords: DataFrame,
    campaigns: DataFrame,
    locations: DataFrame,
    threshold: float = CAMPAIGN_THRESHOLD,
    urls: DataFrame | None = None,
    images: DataFrame | None = None,
    n_links: int = TOP_TERMS,
) -> DataFrame:
    """One export record per event and dominant campaign.

    A message lists at most ``n_links`` urls and photos; the tables ``urls``
    (event_id, url) and ``images`` (event_id, image_url) have them all.
    """
    place = locations.groupBy("event_id").agg(
        F.min_by(F.struct("lat", "lng"), F.struct(-F.col("weight"), F.col("label"))).alias("top_place")
    )
    no_terms = F.array().cast("array<string>")
    rows = (
        campaigns.where(F.col("share") > threshold)
        .join(events, "event_id")
        .join(_ranked_terms(hashtags, "tags"), "event_id", "left")
        .join(_ranked_terms(keywords, "words"), "event_id", "left")
        .join(place, "event_id", "left")
        .withColumn("tags", F.coalesce("tags", no_terms))
        .withColumn("words", F.coalesce("words", no_terms))
    )
    for links, name in ((_first_links(urls, "url", "urls", n_links), "urls"), (_first_links(images, "image_url", "photos", n_links), "photos")):
        rows = rows.withColumn(name, no_terms) if links is None else rows.join(links, "event_id", "left")
    first_tag, first_word = F.get("tags", F.lit(0)), F.get("words", F.lit(0))
    return rows.select(
        F.col("event_id").alias("uid"),
        F.coalesce(first_tag, first_word, F.lit("None")).alias("label"),
        F.lit(True).alias("relevant"),
        iso_from_ms(F.col("start_time_ms")).alias("startDate"),
        iso_from_ms(F.col("end_time_ms")).alias("endDate"),
        F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.slice("words", 1, 1)).alias("hashtags"),
        F.col("words").alias("keywords"),
        F.coalesce("urls", no_terms).alias("urls"),
        F.coalesce("photos", no_terms).alias("photos"),
        F.col("share").alias("importanceScore"),
        F.col("topic_message_count").alias("topicMessageCount"),
        F.col("campaign").alias("campaignId"),
        no_terms.alias("newsEventIds"),
        F.when(
            F.col("top_place").isNotNull(),
            F.struct(
                F.lit("Point").alias("type"),
                F.array("top_place.lng", "top_place.lat").alias("coordinates"),
            ),
        ).alias("location"),
    )
