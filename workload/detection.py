"""Events: roll-up, matching, export, and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.operators import enrich as en
from pulseweave.operators import events as ev
from workload import views as v
from workload.registry import case

EVENT_COLS = ["event_id", "name", "n_clusters", "topic_message_count", "start_time_ms", "end_time_ms", "importance_score"]


@case("event_rollup", v.sql(f"SELECT {', '.join(EVENT_COLS)} FROM doc_events", "doc_events"))
def event_rollup(spark, sf):
    return v.doc_events(spark, sf).select(*EVENT_COLS)


@case(
    "event_size_gate",
    v.sql("SELECT event_id, n_clusters FROM doc_events WHERE n_clusters >= 3", "doc_events"),
)
def event_size_gate(spark, sf):
    return ev.event_size_gate(v.doc_events(spark, sf)).select("event_id", "n_clusters")


v.cte(
    "doc_tags",
    """
    SELECT event_id, term, weight, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, term) AS rank FROM (
        SELECT event_id, term, max(size) AS weight FROM doc_ec GROUP BY event_id, term))
    WHERE rank <= 100""",
    "doc_ec",
)


@case("event_hashtags", v.sql("SELECT event_id, term, weight, rank FROM doc_tags", "doc_tags"))
def event_hashtags(spark, sf):
    return ev.event_hashtags(v.doc_ec(spark, sf)).select("event_id", "term", "weight", "rank")


v.cte(
    "doc_sample",
    """
    SELECT cluster_id, post_id FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5(CAST(post_id AS VARCHAR)), post_id) AS r
      FROM doc_members) WHERE r <= 30""",
    "doc_members",
)
v.cte(
    "doc_sampled",
    """
    SELECT DISTINCT e.event_id, e.cluster_id, p.post_id, p.text, p.lang, p.campaigns
    FROM doc_members s JOIN doc_ec e ON e.cluster_id = s.cluster_id JOIN text_posts p ON p.post_id = s.post_id""",
    "doc_members",
    "doc_ec",
    "text_posts",
)
v.cte(
    "doc_words",
    f"""
    SELECT event_id, cluster_id, post_id, w AS word FROM (
      SELECT event_id, cluster_id, post_id, unnest(list_filter(string_split(trim(replace(
        regexp_replace(lower(text), '{v.SPACE_SQL}', ' ', 'g'), '#', ' #')), ' '), lambda x: x <> '')) AS w
      FROM doc_sampled WHERE lang = 'en')
    WHERE NOT list_contains({v.STOP_SQL}, w)""",
    "doc_sampled",
)


@case("sample_cluster_posts", v.sql("SELECT cluster_id, post_id FROM doc_sample", "doc_sample"))
def sample_cluster_posts(spark, sf):
    return ev.sample_cluster_posts(v.doc_members(spark, sf), 30).select("cluster_id", "post_id")


def sampled(spark, sf, doc=None):
    doc = doc or v.doc_graph(spark, sf)
    return ev.sampled_event_posts(doc.ec, doc.members, v.text_posts(spark, sf))


v.cte(
    "doc_keywords",
    r"""
    SELECT event_id, term, weight, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, term) AS rank FROM (
        SELECT event_id, regexp_replace(word, '[!-/:-@\[-`{-~]', '', 'g') AS term,
          CAST(sum(n) AS BIGINT) AS weight FROM (
            SELECT event_id, cluster_id, word, count(*) AS n FROM doc_words
            WHERE NOT (word LIKE '#%' OR word LIKE '@%' OR word LIKE 'http%' OR word LIKE 'www%')
            GROUP BY ALL HAVING count(*) >= 5)
        GROUP BY ALL))
    WHERE rank <= 100""",
    "doc_words",
)


@case("event_keywords", v.sql("SELECT event_id, term, weight, rank FROM doc_keywords", "doc_keywords"))
def event_keywords(spark, sf):
    return ev.event_keywords(ev.event_words(sampled(spark, sf))).select("event_id", "term", "weight", "rank")


@case(
    "event_urls",
    v.sql(
        """SELECT DISTINCT event_id, CASE WHEN word LIKE 'www%' THEN 'http://' || word ELSE word END AS url
        FROM doc_words WHERE word LIKE 'http%' OR word LIKE 'www%'""",
        "doc_words",
    ),
)
def event_urls(spark, sf):
    return ev.event_urls(ev.event_words(sampled(spark, sf)))


@case(
    "event_images",
    v.sql(
        """SELECT DISTINCT e.event_id, p.primary_image_url AS image_url
        FROM doc_members m JOIN doc_ec e ON e.cluster_id = m.cluster_id
        JOIN text_posts p ON p.post_id = m.post_id""",
        "doc_members",
        "doc_ec",
        "text_posts",
    ),
)
def event_images(spark, sf):
    doc = v.doc_graph(spark, sf)
    return ev.event_images(doc.ec, doc.members, v.text_posts(spark, sf))


v.cte(
    "doc_campaigns",
    """
    SELECT c.event_id, c.campaign, c.n / t.total AS share FROM (
      SELECT event_id, campaign, count(*) AS n FROM (
        SELECT event_id, unnest(campaigns) AS campaign FROM doc_sampled) GROUP BY ALL) c
    JOIN (SELECT event_id, sum(size) AS total FROM doc_ec GROUP BY event_id) t
      ON t.event_id = c.event_id""",
    "doc_sampled",
    "doc_ec",
)


@case(
    "event_campaigns",
    v.sql("SELECT event_id, campaign, round(share, 9) AS share FROM doc_campaigns", "doc_campaigns"),
)
def event_campaigns(spark, sf):
    doc = v.doc_graph(spark, sf)
    return ev.event_campaigns(doc.ec, sampled(spark, sf, doc)).withColumn("share", F.round("share", 9))


v.cte(
    "doc_locations",
    """
    SELECT event_id, city || '  ' || country || ' ' AS label, latitude AS lat, longitude AS lng,
      round(count(*) * 1.05, 6) AS weight
    FROM (SELECT DISTINCT event_id, cluster_id, post_id, text FROM doc_sampled) d
    JOIN gazetteer g ON list_contains(regexp_extract_all(lower(d.text),
      '[\\p{L}\\p{M}\\p{N}_]+(?:[''’.][\\p{L}\\p{M}\\p{N}_]+)*'), g.place)
    GROUP BY ALL HAVING count(*) * 1.05 >= 2""",
    "doc_sampled",
    "gazetteer",
)


def place_names(spark, sf):
    return v.gazetteer(spark, sf).select(F.col("place").alias("label"), F.lit("LOCATION").alias("tag"))


def doc_locations(spark, sf, picked=None):
    picked = picked if picked is not None else materialize(sampled(spark, sf), "sampled-posts")
    # Posts are looked at once, however many clusters they were sampled for.
    posts = picked.select("post_id", "text").distinct()
    found = en.extract_entities(posts, "post_id", "text", place_names(spark, sf), "LOCATION")
    ents = found.join(picked.select("event_id", "cluster_id", "post_id"), "post_id")
    places = v.gazetteer(spark, sf).withColumn("state", F.lit(None).cast("string"))
    return ev.event_locations(ents, places, threshold=2.0)


@case(
    "event_locations",
    v.sql("SELECT event_id, label, lat, lng, weight FROM doc_locations", "doc_locations"),
)
def event_locations(spark, sf):
    return doc_locations(spark, sf).select(
        "event_id", "label", "lat", "lng", F.round("weight", 6).alias("weight")
    )


v.cte(
    "doc_matches",
    """
    SELECT event_id, prior_id, score FROM (
      SELECT event_id, prior_id, score,
        row_number() OVER (PARTITION BY event_id ORDER BY score DESC, prior_id) AS r FROM (
        SELECT a.event_id, b.event_id AS prior_id, round(sum(ta.weight * tb.weight / (sa.s * sb.s)), 9) AS score
        FROM doc_events a JOIN doc_events b ON b.end_time_ms = a.start_time_ms - 1
        JOIN doc_tags ta ON ta.event_id = a.event_id JOIN doc_tags tb ON tb.event_id = b.event_id AND tb.term = ta.term
        JOIN (SELECT event_id, sum(weight) AS s FROM doc_tags GROUP BY event_id) sa ON sa.event_id = a.event_id
        JOIN (SELECT event_id, sum(weight) AS s FROM doc_tags GROUP BY event_id) sb ON sb.event_id = b.event_id
        GROUP BY a.event_id, b.event_id) WHERE score >= 0.2)
    WHERE r = 1""",
    "doc_events",
    "doc_tags",
)


@case(
    "match_prior_events",
    v.sql(
        """SELECT e.event_id, m.prior_id AS sibling_id FROM doc_events e
        LEFT JOIN doc_matches m ON m.event_id = e.event_id""",
        "doc_events",
        "doc_matches",
    ),
)
def match_prior_events(spark, sf):
    ec = v.doc_ec(spark, sf)
    matched = ev.match_prior_events(ev.event_rollup(ec), ev.event_hashtags(ec), min_score=0.2)
    return matched.select("event_id", "sibling_id")


EXPORT_SQL = """SELECT e.event_id AS uid, c.campaign AS "campaignId", round(c.share, 9) AS "importanceScore",
          coalesce(t.first, k.first, 'None') AS label,
          strftime(epoch_ms(e.start_time_ms), '%Y-%m-%dT%H:%M:%S') AS "startDate",
          strftime(epoch_ms(e.end_time_ms), '%Y-%m-%dT%H:%M:%S.%f') AS "endDate",
          coalesce(t.all_terms, k.first, '') AS hashtags, coalesce(k.all_terms, '') AS keywords,
          l.lng, l.lat{more}
        FROM doc_campaigns c JOIN doc_events e ON e.event_id = c.event_id
        LEFT JOIN (SELECT event_id, string_agg(term, ',' ORDER BY rank) AS all_terms, min_by(term, rank) AS first
          FROM doc_tags GROUP BY event_id) t ON t.event_id = e.event_id
        LEFT JOIN (SELECT event_id, string_agg(term, ',' ORDER BY rank) AS all_terms, min_by(term, rank) AS first
          FROM doc_keywords GROUP BY event_id) k ON k.event_id = e.event_id
        LEFT JOIN (SELECT event_id, lat, lng FROM (SELECT *, row_number() OVER (PARTITION BY event_id
          ORDER BY weight DESC, label) AS r FROM doc_locations) WHERE r = 1) l ON l.event_id = e.event_id
        {joins} WHERE c.share > 0.4"""
EXPORT_VIEWS = ("doc_campaigns", "doc_events", "doc_tags", "doc_keywords", "doc_locations")


def flat_exports(rows):
    return rows.select(
        "uid", "campaignId", F.round("importanceScore", 9).alias("importanceScore"), "label",
        "startDate", "endDate", F.array_join("hashtags", ",").alias("hashtags"),
        F.array_join("keywords", ",").alias("keywords"),
        F.get("location.coordinates", F.lit(0)).alias("lng"),
        F.get("location.coordinates", F.lit(1)).alias("lat"),
    )


EXPORTED = v.sql(EXPORT_SQL.format(more="", joins=""), *EXPORT_VIEWS)


@case("export_events", EXPORTED)
def export_events(spark, sf):
    return flat_exports(export_rows(spark, sf))


def export_rows(spark, sf):
    doc = v.doc_graph(spark, sf)
    picked = materialize(sampled(spark, sf, doc), "sampled-posts")
    words = materialize(ev.word_counts(ev.event_words(picked)), "event-words")
    return ev.export_events(
        ev.event_rollup(doc.ec), ev.event_hashtags(doc.ec), ev.event_keywords(words),
        ev.event_campaigns(doc.ec, picked), doc_locations(spark, sf, picked), threshold=0.4,
        urls=ev.event_urls(words), images=ev.event_images(doc.ec, doc.members, v.text_posts(spark, sf)),
    )


@case("event_export_messages", EXPORTED)
def event_export_messages(spark, sf):
    """Export records as the JSON messages that are sent on, read as records again."""
    from pulseweave.sources.exports import as_messages

    rows = export_rows(spark, sf)
    return flat_exports(as_messages(rows).select(F.from_json("value", rows.schema).alias("r")).select("r.*"))


@case("event_export_sink", EXPORTED)
def event_export_sink(spark, sf):
    """Export records delivered to a folder by the tasks that hold them, and read back."""
    from pulseweave.lineage import new_path
    from pulseweave.sources.exports import event_export_sink, read_messages

    rows = materialize(export_rows(spark, sf), "export-records")
    folder = new_path(spark, "delivered")
    event_export_sink(rows, folder, "events")
    return flat_exports(read_messages(rows, f"{folder}/events"))


v.cte(
    "doc_links_out",
    """
    SELECT event_id, kind, string_agg(link, ',' ORDER BY link) AS links FROM (
      SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY link) AS r FROM (
        SELECT DISTINCT event_id, 'url' AS kind, CASE WHEN word LIKE 'www%' THEN 'http://' || word ELSE word END AS link
        FROM doc_words WHERE word LIKE 'http%' OR word LIKE 'www%'
        UNION SELECT e.event_id, 'photo', p.primary_image_url FROM doc_members m
        JOIN doc_ec e ON e.cluster_id = m.cluster_id JOIN text_posts p ON p.post_id = m.post_id))
    WHERE r <= 100 GROUP BY event_id, kind""",
    "doc_words",
    "doc_members",
    "doc_ec",
    "text_posts",
)


def flat_chain(rows):
    """Export records with their lists as texts."""
    return rows.select(
        "uid", "campaignId", F.round("importanceScore", 9).alias("importanceScore"), "label", "startDate", "endDate",
        F.array_join("hashtags", ",").alias("hashtags"), F.array_join("keywords", ",").alias("keywords"),
        F.get("location.coordinates", F.lit(0)).alias("lng"), F.get("location.coordinates", F.lit(1)).alias("lat"),
        F.array_join("urls", ",").alias("urls"), F.array_join("photos", ",").alias("photos"),
    )


@case(
    "detect_events_chain",
    v.sql(
        EXPORT_SQL.format(
            more=", coalesce(u.links, '') AS urls, coalesce(h.links, '') AS photos",
            joins="""LEFT JOIN doc_links_out u ON u.event_id = e.event_id AND u.kind = 'url'
            LEFT JOIN doc_links_out h ON h.event_id = e.event_id AND h.kind = 'photo'""",
        ),
        *EXPORT_VIEWS,
        "doc_links_out",
    ),
)
def detect_events_chain(spark, sf):
    """The whole chain on documents as posts, with neighbour communities in place of Louvain."""
    from pulseweave.operators.graph import neighbour_partition
    from pulseweave.plans.detection import Settings, detect_events

    s = Settings(
        span_ms=v.DOC_SPAN_MS, min_window_posts=1, min_cluster_posts=v.DOC_MIN_POSTS, prune=False,
        campaign_threshold=0.4, geo_threshold=2.0,
    )
    places = v.gazetteer(spark, sf).withColumn("state", F.lit(None).cast("string"))
    rows = detect_events(v.text_posts(spark, sf), s, places=places, communities=neighbour_partition).exports
    return flat_chain(rows)


@case("detect_events_whole")
def detect_events_whole(spark, sf):
    """Text vectors, leader clusters and tag clusters to linked, pruned, grouped and exported events."""
    from pulseweave.functions import text as tx
    from pulseweave.operators import textjobs as tj
    from pulseweave.operators import windows as wn
    from pulseweave.plans.detection import Settings, detect_events, vector_cluster_tables

    tagged = materialize(v.text_posts(spark, sf), "posts")
    texts = tagged.withColumn("featurizer", F.lit("text"))
    tokens = materialize(tj.token_rows(tagged.where("lang = 'en'"), "post_id", tx.tokenize_en(F.col("text"))), "tokens")
    model = v.word_model(tj.document_frequency(tokens.withColumnRenamed("post_id", "doc_id")))
    vectors = tj.text_vectors(tokens, tagged, model, "post_id", 4)
    windowed = wn.tumbling_windows(texts, v.DOC_SPAN_MS).select("post_id", "lang", "timestamp_ms", "start_time_ms", "end_time_ms")
    clusters, members = vector_cluster_tables(windowed.join(vectors, "post_id"), "text", 0.995)
    s = Settings(
        span_ms=v.DOC_SPAN_MS, min_window_posts=1, min_cluster_posts=v.DOC_MIN_POSTS, min_overlap=0.3, min_clusters=2,
        campaign_threshold=0.2, geo_threshold=2.0,
    )
    places = v.gazetteer(spark, sf).withColumn("state", F.lit(None).cast("string"))
    found = detect_events(tagged.unionByName(texts), s, clusters, members, places)
    return found.exports.select(
        "uid", "label", "startDate", "endDate", "campaignId", F.round("importanceScore", 6).alias("importanceScore"),
        F.size("urls").alias("n_urls"), F.size("photos").alias("n_photos"), "topicMessageCount",
    )


@case("detect_events")
def detect_events(spark, sf):
    """The whole chain on daily windows of the event posts."""
    from pulseweave.plans.detection import Settings, detect_events

    s = Settings(
        span_ms=v.DAY_MS, min_window_posts=100, min_cluster_posts=v.MIN_TAG_POSTS, min_overlap=0.3, prune=False,
        min_clusters=2, campaign_threshold=0.2,
    )
    found = detect_events(v.posts(spark, sf), s)
    return found.exports.select(
        "uid", "label", "startDate", "endDate", "campaignId", F.round("importanceScore", 6).alias("importanceScore"),
        F.array_join("hashtags", ",").alias("hashtags"), "topicMessageCount",
    )


# -- enrichment -------------------------------------------------------------------------


@case(
    "extract_entities",
    r"""SELECT DISTINCT doc_id, label, tag FROM (
      SELECT doc_id, unnest(flatten(list_transform(range(1, 9), lambda n: list_transform(range(1, len(w) - n + 2),
        lambda i: array_to_string(w[i:i + n - 1], ' '))))) AS label
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[''’.][\p{L}\p{M}\p{N}_]+)*') AS w
        FROM documents))
    JOIN (SELECT lower(p_name) AS label, 'ORGANIZATION' AS tag FROM part
      UNION SELECT lower(n_name), 'LOCATION' FROM nation
      UNION SELECT 'is he', 'PERSON' UNION SELECT 'reti', 'PERSON') g USING (label)""",
)
def extract_entities(spark, sf):
    names = (
        v.table(spark, sf, "part").select(F.lower("p_name").alias("label"), F.lit("ORGANIZATION").alias("tag"))
        .union(v.table(spark, sf, "nation").select(F.lower("n_name"), F.lit("LOCATION")))
        .union(spark.sql("SELECT * FROM VALUES ('is he', 'PERSON'), ('reti', 'PERSON')"))
    )
    return en.extract_entities(v.wide(spark, sf, "documents", "doc_id"), "doc_id", "text", names)


def entities(spark, sf):
    return en.extract_entities(v.text_posts(spark, sf), "post_id", "text", place_names(spark, sf))


v.cte(
    "parsed",
    """
    SELECT p.post_id, length(p.text) AS n_chars, e.locations, e.first_place, g.latitude AS lat,
      g.longitude AS lng, g.latitude IS NOT NULL AS geocoded, CAST(p.timestamp_ms AS VARCHAR) AS dates
    FROM text_posts p LEFT JOIN (
      SELECT post_id, string_agg(place, ',' ORDER BY place) AS locations, min(place) AS first_place
      FROM (SELECT DISTINCT t.post_id, g.place FROM (
          SELECT post_id, unnest(regexp_extract_all(lower(text),
            '[\\p{L}\\p{M}\\p{N}_]+(?:[''’.][\\p{L}\\p{M}\\p{N}_]+)*')) AS w FROM text_posts) t
        JOIN gazetteer g ON g.place = t.w) GROUP BY post_id) e ON e.post_id = p.post_id
    LEFT JOIN (SELECT * FROM gazetteer WHERE latitude > -20) g ON g.place = e.first_place""",
    "text_posts",
    "gazetteer",
)


def parsed(spark, sf):
    places = v.gazetteer(spark, sf).where("latitude > -20")
    return en.eventize(v.text_posts(spark, sf), entities(spark, sf), places, "post_id", "text", "timestamp_ms")


@case(
    "eventize",
    v.sql("SELECT post_id, n_chars, coalesce(locations, '') AS locations, lat, lng, geocoded, dates FROM parsed", "parsed"),
)
def eventize(spark, sf):
    return parsed(spark, sf).select(
        "post_id", F.length("message").alias("n_chars"), F.array_join("locations", ",").alias("locations"),
        "lat", "lng", "geocoded", F.array_join("dates", ",").alias("dates"),
    )


@case("geocoded_events", v.sql("SELECT post_id, lat, lng FROM parsed WHERE geocoded", "parsed"))
def geocoded_events(spark, sf):
    from pulseweave.operators.serving import geocoded_events

    return geocoded_events(parsed(spark, sf)).select("post_id", "lat", "lng")


@case(
    "geocode_cached",
    v.sql(
        """, asked AS (SELECT DISTINCT trim(lower(q)) AS place FROM (
          SELECT upper('nation' || (s_nationkey % 20)) || ' ' AS q FROM supplier
          UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT ' ') WHERE trim(q) <> '')
        SELECT place, latitude, longitude, latitude < 0 AS from_cache
        FROM asked JOIN gazetteer USING (place)""",
        "gazetteer",
    ),
)
def geocode_cached(spark, sf):
    s, c = v.table(spark, sf, "supplier"), v.table(spark, sf, "customer")
    nation = F.concat(F.lit("nation"), (F.col("s_nationkey") % 20).cast("string"))
    asked = (
        s.select(F.concat(F.upper(nation), F.lit(" ")).alias("place"))
        .union(c.select("c_mktsegment"))
        .union(spark.sql("SELECT ' '"))
    )
    known = v.gazetteer(spark, sf).select("place", "latitude", "longitude")
    # The cache knows the south; the provider offers two candidates per place.
    provider = known.where("latitude >= 0").withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "latitude", F.when(F.col("rank") == 1, F.col("latitude")).otherwise(F.col("latitude") + 1)
    )
    found, _ = en.geocode_cached(asked, known.where("latitude < 0"), provider)
    return found.select("place", "latitude", "longitude", "from_cache")


@case(
    "translate_cached",
    """SELECT DISTINCT text AS phrase, CASE WHEN length(text) > 200 THEN 'd' ELSE 't' END AS type,
      CASE WHEN role = 'user' THEN md5(text) ELSE lower(text) END AS result
    FROM conversations WHERE text <> ''""",
)
def translate_cached(spark, sf):
    rows = v.table(spark, sf, "conversations").select(
        F.col("text").alias("phrase"), F.when(F.length("text") > 200, "d").otherwise("t").alias("type"), "role"
    )
    cache = rows.where("role = 'user'").select("phrase", "type", F.md5("phrase").alias("result")).distinct()
    en.register_enricher("lower", lambda missing: missing.withColumn("result", F.lower("phrase")))
    found, _ = en.translate_cached(rows, cache, en.enricher("lower"))
    return found


@case("register_enricher", "SELECT doc_id, length(text) AS n FROM documents")
def register_enricher(spark, sf):
    """A plug-in that runs on Arrow batches."""

    def measure(batches):
        for b in batches:
            yield b.assign(n=b["text"].str.len().astype("int64"))[["doc_id", "n"]]

    en.register_enricher("length", lambda df: df.select("doc_id", "text").mapInPandas(measure, "doc_id long, n long"))
    return en.enricher("length")(v.table(spark, sf, "documents"))


@case(
    "map_points",
    v.sql(
        """SELECT event_id, replace(label, '-', '') AS key, lat, lng, label AS message, weight,
          row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, label) = 1 AS focus
        FROM doc_locations""",
        "doc_locations",
    ),
)
def map_points(spark, sf):
    return en.map_points(doc_locations(spark, sf)).withColumn("weight", F.round("weight", 6))
