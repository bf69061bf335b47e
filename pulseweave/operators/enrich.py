"""Entities, places and translations from tables, with pluggable providers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions.text import WORD_RUN
from pulseweave.lineage import broadcast_if_small, materialize

#: First words of names that are looked up inside a text's row; with more, every place is tried.
MOST_STARTS = 10_000

Enricher = Callable[[DataFrame], DataFrame]

_ENRICHERS: dict[str, Enricher] = {}


def register_enricher(name: str, enricher: Enricher) -> Enricher:
    """Make a ``DataFrame -> DataFrame`` plug-in available by name."""
    _ENRICHERS[name] = enricher
    return enricher


def enricher(name: str) -> Enricher:
    if name not in _ENRICHERS:
        raise KeyError(f"no enricher named {name!r}")
    return _ENRICHERS[name]


def word_grams(words: str, starts: dict[int, list[str] | None]) -> Column:
    """Runs of words of the column ``words`` that may be names, each once.

    ``starts`` holds the lengths that names have, and for each the words that such a name
    can start with (None: any word), so only these places and lengths are joined.
    """

    def of_length(n: int, first: list[str] | None) -> Column:
        if n == 1:
            return F.col(words)
        places = F.sequence(F.lit(1), F.size(words) - F.lit(n - 1))
        if first is not None:
            places = F.filter(places, lambda i: F.get(words, i - 1).isin(first))
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " ")))

    runs = [of_length(n, first) for n, first in sorted(starts.items())]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(none, *[F.coalesce(r, none) for r in runs]))


def name_starts(names: DataFrame, most: int = MOST_STARTS) -> dict[int, list[str] | None]:
    """Lengths of the names in words, and their first words where these are at most ``most``."""
    words = F.regexp_extract_all("label", F.lit(WORD_RUN), 1)
    first = names.select(F.size(words).alias("n"), F.get(words, F.lit(0)).alias("first")).distinct()
    counts = first.groupBy("n").agg(F.count("*").alias("firsts"), F.sort_array(F.collect_set("first")).alias("list"))
    return {r["n"]: r["list"] for r in counts.select("n", F.when(F.col("firsts") <= most, F.col("list")).alias("list")).collect() if r["n"]}


def extract_entities(
    docs: DataFrame, doc_id: str, text: str, gazetteer: DataFrame, tag: str | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Entities (doc_id, label, tag) named in the gazetteer, unique per document.

    ``gazetteer`` holds lower-case ``label`` and ``tag`` (PERSON, ORGANIZATION,
    LOCATION or DATE). Names of up to ``longest`` words are found, all of them
    unless it is given.
    """
    names = gazetteer.select("label", "tag")
    if tag is not None:
        names = names.where(F.col("tag") == tag)
    starts = {n: first for n, first in name_starts(names).items() if longest is None or n <= longest}
    words = docs.select(doc_id, F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), 1).alias("words"))
    grams = words.select(doc_id, F.explode_outer(word_grams("words", starts)).alias("label"))
    return grams.join(broadcast_if_small(names.distinct()), "label").select(doc_id, "label", "tag")


def normal_place(place: Column) -> Column:
    return F.lower(F.trim(place.cast("string")))


def geocode_cached(
    places: DataFrame, cache: DataFrame, provider: DataFrame | Enricher, place: str = "place"
) -> tuple[DataFrame, DataFrame]:
    """Top result per distinct place, and the rows to add to the cache.

    ``provider`` gives candidate rows with ``place`` and ``rank``: a table, or
    an enricher that is handed the missing places only.
    """
    asked = places.select(normal_place(F.col(place)).alias("place")).where("place != ''").distinct()
    hits = asked.join(cache, "place")
    misses = asked.join(cache.select("place"), "place", "left_anti")
    found = provider(misses) if callable(provider) else misses.join(provider, "place")
    w = Window.partitionBy("place").orderBy("rank")
    top = found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "rank")
    top = materialize(top, "geocoded")  # both results hang on it; the provider is asked once
    return (
        hits.withColumn("from_cache", F.lit(True)).unionByName(
            top.withColumn("from_cache", F.lit(False)), allowMissingColumns=True
        ),
        top,
    )


def translate_cached(
    phrases: DataFrame, cache: DataFrame, provider: DataFrame | Enricher
) -> tuple[DataFrame, DataFrame]:
    """Translation per distinct (phrase, type), and the rows to add to the cache.

    ``type`` is ``d`` for whole documents and ``t`` for single terms.
    """
    keys = ["phrase", "type"]
    asked = phrases.select(*keys).where(F.col("phrase") != "").distinct()
    hits = asked.join(cache.select(*keys, "result"), keys)
    misses = asked.join(cache.select(*keys), keys, "left_anti")
    found = provider(misses) if callable(provider) else misses.join(provider, keys)
    fresh = materialize(found.select(*keys, "result"), "translated")  # the provider is asked once
    return hits.unionByName(fresh), fresh


def eventize(
    docs: DataFrame, entities: DataFrame, places: DataFrame, doc_id: str, text: str, date: str
) -> DataFrame:
    """Documents as parsed events: entity lists, message, and the first place geocoded.

    Entity lists are unique labels of one document, so their length is bounded
    by the document.
    """

    def labels(tag: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("tag") == tag, F.col("label"))))

    grouped = entities.groupBy(doc_id).agg(
        labels("PERSON").alias("people"),
        labels("ORGANIZATION").alias("organizations"),
        labels("LOCATION").alias("locations"),
        labels("DATE").alias("dates"),
    )
    none = F.array().cast("array<string>")
    base = (
        docs.select(doc_id, F.col(text).alias("message"), F.col(date).alias("_date"))
        .join(grouped, doc_id, "left")
        .select(
            doc_id,
            "message",
            *[F.coalesce(c, none).alias(c) for c in ("people", "organizations", "locations")],
            F.when(F.size("dates") > 0, F.col("dates"))
            .otherwise(F.array(F.col("_date").cast("string")))
            .alias("dates"),
        )
        .withColumn("place", normal_place(F.get("locations", F.lit(0))))
    )
    geo = places.select("place", F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    return (
        base.join(broadcast_if_small(geo), "place", "left")
        .withColumn("geocoded", F.col("lat").isNotNull())
        .drop("place")
    )


def map_points(locations: DataFrame) -> DataFrame:
    """Map markers of each event: heaviest first, one per label, the first focused."""
    rows = locations.where((F.col("geo_type") == "point") & (F.coalesce(F.length("label"), F.lit(0)) > 0))
    by_label = Window.partitionBy("event_id", "label").orderBy(F.col("weight").desc(), "lat", "lng")
    unique = rows.withColumn("_r", F.row_number().over(by_label)).where("_r = 1").drop("_r")
    best = unique.groupBy("event_id").agg(
        F.min_by("label", F.struct(-F.col("weight"), F.col("label"))).alias("_first")
    )
    return unique.join(best, "event_id").select(
        "event_id",
        F.replace(F.col("label"), F.lit("-"), F.lit("")).alias("key"),
        "lat",
        "lng",
        F.col("label").alias("message"),
        "weight",
        (F.col("label") == F.col("_first")).alias("focus"),
    )
