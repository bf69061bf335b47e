"""Queries behind the event, cluster and network views."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.operators import events as ev
from pulseweave.operators import links as lk
from pulseweave.operators import serving as sv
from workload import views as v
from workload.detection import EVENT_COLS
from workload.registry import case

LO, HI = 1_704_100_000_000, 1_704_200_000_000
OVERLAP_SQL = f"""(end_time_ms BETWEEN {LO} AND {HI} OR start_time_ms BETWEEN {LO} AND {HI}
  OR (start_time_ms <= {LO} AND end_time_ms >= {HI}))"""


@case(
    "events_in_range",
    v.sql(f"SELECT event_id, start_time_ms, end_time_ms FROM doc_events WHERE {OVERLAP_SQL}", "doc_events"),
)
def events_in_range(spark, sf):
    return sv.events_in_range(v.doc_events(spark, sf), LO, HI).select("event_id", "start_time_ms", "end_time_ms")


v.cte(
    "networks",
    "SELECT event_id, CASE WHEN topic_message_count % 2 = 0 THEN 1 ELSE 0 END AS status FROM doc_events WHERE n_clusters > 2",
    "doc_events",
)


def networks(events):
    return events.where("n_clusters > 2").select(
        "event_id", F.when(F.col("topic_message_count") % 2 == 0, 1).otherwise(0).alias("status")
    )


@case(
    "events_with_network_flag",
    v.sql(
        """SELECT e.event_id, CASE WHEN n.event_id IS NULL THEN 0 ELSE 1 END AS has_user_network
        FROM doc_events e LEFT JOIN networks n ON n.event_id = e.event_id""",
        "doc_events",
        "networks",
    ),
)
def events_with_network_flag(spark, sf):
    e = v.doc_events(spark, sf)
    return sv.events_with_network_flag(e, networks(e)).select("event_id", "has_user_network")


@case(
    "pending_networks",
    v.sql(
        "SELECT event_id FROM doc_events WHERE event_id NOT IN (SELECT event_id FROM networks WHERE status = 1)",
        "doc_events",
        "networks",
    ),
)
def pending_networks(spark, sf):
    e = v.doc_events(spark, sf)
    return sv.pending_networks(e, networks(e)).select("event_id")


@case(
    "event_timeline",
    v.sql(
        """, c AS (SELECT start_time_ms, count(*) AS n_events FROM doc_events GROUP BY start_time_ms)
        SELECT start_time_ms, n_events, (SELECT min(start_time_ms) FROM c) AS min_date,
          (SELECT max(start_time_ms) FROM c) AS max_date, (SELECT max(n_events) FROM c) AS max_count FROM c""",
        "doc_events",
    ),
)
def event_timeline(spark, sf):
    curve, extent = sv.event_timeline(v.doc_events(spark, sf))
    ends = {c: extent.select(c).scalar() for c in ("min_date", "max_date", "max_count")}
    return curve.withColumns(ends)


@case(
    "link_timeline",
    v.sql(
        """, c AS (SELECT w.end_time_ms, count(l.source) AS n_links FROM job_windows w
          LEFT JOIN links l ON l.end_time_ms = w.end_time_ms GROUP BY w.end_time_ms)
        SELECT end_time_ms, n_links FROM c
        WHERE end_time_ms >= (SELECT min(end_time_ms) FROM c WHERE n_links > 0)""",
        "job_windows",
        "links",
    ),
)
def link_timeline(spark, sf):
    linkers = v.job_windows(spark, sf).withColumn("featurizer", F.lit("linker"))
    return sv.link_timeline(linkers, v.links(spark, sf))


v.cte(
    "event_posts",
    "SELECT DISTINCT e.event_id, m.post_id FROM doc_ec e JOIN doc_members m ON m.cluster_id = e.cluster_id",
    "doc_ec",
    "doc_members",
)
v.cte(
    "event_sample",
    """
    SELECT event_id, post_id FROM event_posts""",
    "event_posts",
)


def event_sample(spark, sf, doc=None):
    doc = doc or v.doc_graph(spark, sf)
    return sv.sampled_event_members(doc.ec, doc.members)


@case(
    "search_events",
    v.sql(
        """SELECT event_id FROM doc_events WHERE event_id IN (
          SELECT event_id FROM doc_tags WHERE regexp_matches(term, '(?i)SRC1[0-4]')
          UNION ALL SELECT s.event_id FROM event_sample s JOIN text_posts p ON p.post_id = s.post_id
          WHERE regexp_matches(p.text, '(?i)SRC1[0-4]|http://t.co/11') OR regexp_matches(p.screen_name, '(?i)USER_77'))""",
        "doc_events",
        "doc_tags",
        "event_sample",
        "text_posts",
    ).replace("'(?i)SRC1[0-4]')", "'(?i)SRC1[0-4]|http://t.co/11|USER_77')").replace(
        "'(?i)SRC1[0-4]|http://t.co/11') OR", "'(?i)SRC1[0-4]|http://t.co/11|USER_77') OR"
    ).replace("(p.screen_name, '(?i)USER_77')", "(p.screen_name, '(?i)SRC1[0-4]|http://t.co/11|USER_77')"),
)
def search_events(spark, sf):
    doc = v.doc_graph(spark, sf)
    ec = doc.ec
    posts = event_sample(spark, sf, doc).join(
        v.text_posts(spark, sf).select("post_id", "text", "screen_name"), "post_id"
    )
    found = sv.search_events(
        ev.event_rollup(ec), ev.event_hashtags(ec), posts, "SRC1[0-4]|http://t.co/11|USER_77"
    )
    return found.select("event_id")


KIND_SQL = """CASE WHEN broadcast_post_id <> '' THEN 'retweet' WHEN quote_post_id <> '' THEN 'quote'
  WHEN reply_to_post_id <> '' THEN 'reply' ELSE 'direct' END"""


@case("post_type_mix", v.sql(f"SELECT {KIND_SQL} AS label, count(*) AS n_posts FROM posts GROUP BY 1", "posts"))
def post_type_mix(spark, sf):
    return sv.post_type_mix(v.posts(spark, sf))


@case(
    "distinct_refs",
    v.sql("SELECT count(DISTINCT coalesce(broadcast_post_id, quote_post_id)) AS referred_to FROM posts", "posts"),
)
def distinct_refs(spark, sf):
    return sv.distinct_refs(v.posts(spark, sf))


@case(
    "top_broadcasts",
    v.sql(
        """SELECT broadcast_post_id AS label, count(*) AS n_posts FROM posts WHERE broadcast_post_id <> ''
        GROUP BY 1 ORDER BY n_posts DESC, label LIMIT 10""",
        "posts",
    ),
)
def top_broadcasts(spark, sf):
    return sv.top_broadcasts(v.posts(spark, sf))


@case(
    "posts_by_author",
    v.sql(
        """SELECT post_id, screen_name FROM text_posts WHERE post_id IN (SELECT post_id FROM event_sample)""",
        "text_posts",
        "event_sample",
    ),
)
def posts_by_author(spark, sf):
    return sv.posts_by_author(event_sample(spark, sf), v.text_posts(spark, sf)).select("post_id", "screen_name")


@case(
    "author_timeline",
    v.sql(
        """SELECT post_id, screen_name, timestamp_ms, md5(text) AS h FROM text_posts
        WHERE screen_name = 'user_7'""",
        "text_posts",
    ),
)
def author_timeline(spark, sf):
    posts = v.text_posts(spark, sf).withColumn("featurizer", F.lit("text"))
    return sv.author_timeline(posts, "user_7").select(
        "post_id", "screen_name", "timestamp_ms", F.md5("text").alias("h")
    )


@case("unique_member_posts", v.sql("SELECT DISTINCT post_id FROM members", "members"))
def unique_member_posts(spark, sf):
    return sv.unique_member_posts(v.members(spark, sf))


@case(
    "unique_image_urls",
    v.sql("SELECT DISTINCT primary_image_url FROM posts WHERE primary_image_url IS NOT NULL", "posts"),
)
def unique_image_urls(spark, sf):
    return sv.unique_image_urls(v.posts(spark, sf))


@case(
    "monitor_cluster_counts",
    v.sql(
        """, m AS (SELECT monitor_id, start_time_ms FROM monitors WHERE featurizer = 'hashtag'
          ORDER BY start_time_ms DESC, monitor_id LIMIT 10),
        c AS (SELECT m.monitor_id, m.start_time_ms, count(c.cluster_id) AS n_clusters
          FROM m LEFT JOIN clusters c ON c.start_time_ms = m.start_time_ms GROUP BY ALL)
        SELECT *, sum(n_clusters) OVER () AS page_total, (SELECT count(*) FROM clusters) AS grand_total FROM c""",
        "monitors",
        "clusters",
    ),
)
def monitor_cluster_counts(spark, sf):
    clusters = v.clusters(spark, sf).withColumn(
        "monitor_id", F.concat(F.col("start_time_ms").cast("string"), F.lit(":hashtag:"))
    )
    return sv.monitor_cluster_counts(v.monitors(spark, sf), clusters, 10, "hashtag")


@case(
    "cluster_post_details",
    v.sql(
        """SELECT m.cluster_id, m.post_id, array_to_string(p.hashtags, ',') AS detail, p.post_url
        FROM members m JOIN posts p ON p.post_id = m.post_id""",
        "members",
        "posts",
    ),
)
def cluster_post_details(spark, sf):
    return sv.cluster_post_details(v.members(spark, sf), v.posts(spark, sf))


@case(
    "links_between",
    v.sql(
        "SELECT end_time_ms, source, target FROM links WHERE end_time_ms BETWEEN 1704500000000 AND 1705500000000",
        "links",
    ),
)
def links_between(spark, sf):
    # Clusters are linked within a window, so the windows are chosen before linking.
    span = (1_704_500_000_000, 1_705_500_000_000)
    members = v.members(spark, sf).where(F.col("end_time_ms").between(*span))
    return sv.links_between(lk.cluster_links(members), *span).select("end_time_ms", "source", "target")


@case(
    "top_pairs_label",
    v.sql(
        """SELECT event_id, string_agg(term, ', ' ORDER BY rank) AS label FROM doc_tags WHERE rank <= 2
        GROUP BY event_id""",
        "doc_tags",
    ),
)
def top_pairs_label(spark, sf):
    tags = ev.event_hashtags(v.doc_ec(spark, sf))
    listed = F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))).alias("pairs")
    return tags.groupBy("event_id").agg(listed).select(
        "event_id", sv.top_pairs_label(F.col("pairs")).alias("label")
    )


@case(
    "ops_counts",
    v.sql(
        """SELECT (SELECT count(*) FROM doc_events) AS n_events, count(*) AS n_posts,
          (SELECT count(*) FROM job_windows WHERE state = 'running') AS n_running,
          count(*) FILTER (state = 'featurized') AS n_featurized FROM posts""",
        "doc_events",
        "job_windows",
        "posts",
    ),
)
def ops_counts(spark, sf):
    return sv.ops_counts(v.doc_events(spark, sf), v.posts(spark, sf), v.job_windows(spark, sf))


@case(
    "annotate_events",
    v.sql(
        """, a AS (SELECT event_id, campaign, name, relevant FROM (
          SELECT e.event_id, CAST(p.user_id % 3 AS VARCHAR) AS campaign, 'named by ' || p.screen_name AS name,
            p.user_id % 2 = 0 AS relevant, row_number() OVER (PARTITION BY e.event_id, p.user_id % 3
              ORDER BY p.timestamp_ms DESC, 'named by ' || p.screen_name) AS r
          FROM event_posts e JOIN text_posts p ON p.post_id = e.post_id WHERE p.lang = 'fr') WHERE r = 1)
        SELECT e.event_id, a.campaign, coalesce(a.name, e.name) AS name, a.relevant
        FROM doc_events e LEFT JOIN a ON a.event_id = e.event_id""",
        "event_posts",
        "text_posts",
        "doc_events",
    ),
)
def annotate_events(spark, sf):
    # Readers that wrote French posts name the event.
    doc = v.doc_graph(spark, sf)
    ec = doc.ec
    rows = ec.select("event_id", "cluster_id").join(doc.members, "cluster_id").select(
        "event_id", "post_id"
    ).distinct().join(v.text_posts(spark, sf).where("lang = 'fr'"), "post_id")
    notes = rows.select(
        "event_id",
        (F.col("user_id") % 3).cast("string").alias("campaign"),
        F.concat(F.lit("named by "), "screen_name").alias("name"),
        (F.col("user_id") % 2 == 0).alias("relevant"),
        F.col("timestamp_ms").alias("modified"),
    )
    return sv.annotate_events(ev.event_rollup(ec).select(*EVENT_COLS), notes).select(
        "event_id", "campaign", "name", "relevant"
    )
