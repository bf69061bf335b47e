"""Views derived from the given tables, once for Spark and once as SQL.

Each view has a Spark builder and a SQL common table expression of the same
rows. ``sql(text, *views)`` puts the needed expressions in front of a query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.functions import text as tx
from pulseweave.lineage import materialize, spread
from pulseweave.operators import hashtags as ht
from pulseweave.operators import links as lk
from pulseweave.operators import windows as wn
from pulseweave.operators.textjobs import token_rows

DAY_MS = 86_400_000
MIN_TAG_POSTS = 5
DOC_MIN_POSTS = 4
DOC_SPAN_MS = 2 * DAY_MS
LAST_MS = 1_706_659_200_000  # 2024-01-31

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (body, needs)


def sql(query: str, *views: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in _CTES[name][1]:
            visit(need)
        ordered.append(name)

    for v in views:
        visit(v)
    if not ordered:
        return query
    heads = ",\n".join(f"{name} AS ({_CTES[name][0]})" for name in ordered)
    return f"WITH RECURSIVE {heads}\n{query}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wide(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row, spread over all cores."""
    return spread(table(spark, sf, name), key)


# posts: every event as a post with two tags ---------------------------------


def posts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return posts_from_events(e)


def posts_from_events(e: DataFrame) -> DataFrame:
    def ref(kind: str, mod: int):
        return F.when(F.col("event_type") == kind, (F.col("event_id") % mod).cast("string"))

    return e.select(
        F.col("event_id").alias("post_id"),
        F.col("user_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("screen_name"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.array(
            F.col("event_type"), F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
        ).alias("hashtags"),
        F.lit("hashtag").alias("featurizer"),
        F.lit("en").alias("lang"),
        F.when(F.col("event_type") == "error", "featurized").otherwise("new").alias("state"),
        ref("view", 97).alias("broadcast_post_id"),
        ref("click", 89).alias("quote_post_id"),
        ref("signup", 83).alias("reply_to_post_id"),
        F.array((100 * (1 + F.col("user_id") % 6)).cast("string")).alias("campaigns"),
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("text"),
        F.when(
            F.col("event_type") == "view",
            F.concat(F.lit("http://img/"), (F.col("event_id") % 50).cast("string"), F.lit(".jpg")),
        ).alias("primary_image_url"),
        F.concat(F.lit("http://posts/"), F.col("event_id").cast("string")).alias("post_url"),
        F.col("value"),
    )


cte(
    "posts",
    """
    SELECT event_id AS post_id, user_id, 'user_' || user_id AS screen_name,
      epoch_us(ts) // 1000 AS timestamp_ms,
      [event_type, 'k' || json_extract_string(props, '$.k')] AS hashtags,
      'hashtag' AS featurizer, 'en' AS lang,
      CASE WHEN event_type = 'error' THEN 'featurized' ELSE 'new' END AS state,
      CASE WHEN event_type = 'view' THEN CAST(event_id % 97 AS VARCHAR) END AS broadcast_post_id,
      CASE WHEN event_type = 'click' THEN CAST(event_id % 89 AS VARCHAR) END AS quote_post_id,
      CASE WHEN event_type = 'signup' THEN CAST(event_id % 83 AS VARCHAR) END AS reply_to_post_id,
      [CAST(100 * (1 + user_id % 6) AS VARCHAR)] AS campaigns,
      event_type || ' ' || json_extract_string(props, '$.k') AS text,
      CASE WHEN event_type = 'view' THEN 'http://img/' || (event_id % 50) || '.jpg' END
        AS primary_image_url,
      'http://posts/' || event_id AS post_url, value
    FROM events""",
)

cte(
    "posts_w",
    f"""
    SELECT *, timestamp_ms - timestamp_ms % {DAY_MS} AS start_time_ms,
      timestamp_ms - timestamp_ms % {DAY_MS} + {DAY_MS - 1} AS end_time_ms FROM posts""",
    "posts",
)


def posts_w(spark: SparkSession, sf: str) -> DataFrame:
    return wn.tumbling_windows(posts(spark, sf), DAY_MS)


# text_posts: documents as posts, with tags, a url and a place added. Time and author come from
# every n-th event, so that the posts cover the times of all events. -------------------------------


def text_posts(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf, "documents", "doc_id").select("doc_id", "text", "lang", "source")
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    n_events, n_docs = e.count(), table(spark, sf, "documents").count()
    nth = F.lit(max(1, n_events // max(1, n_docs)))
    doc = F.col("doc_id").cast("string")
    place = F.concat(F.lit(" in nation"), (F.col("doc_id") % 25).cast("string"))
    return d.join(e, F.col("doc_id") * nth % F.lit(max(1, n_events)) == F.col("event_id")).select(
        F.col("doc_id").alias("post_id"),
        F.col("user_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("screen_name"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.concat(
            F.col("text"), F.lit(" #tag"), (F.col("doc_id") % 7).cast("string"),
            F.lit(" http://t.co/"), doc, place,
        ).alias("text"),
        "lang",
        F.array(
            F.concat(F.lit("Lang_"), F.col("lang")),
            F.col("source"),
            F.concat(F.lit("tag"), (F.col("doc_id") % 7).cast("string")),
        ).alias("hashtags"),
        F.lit("hashtag").alias("featurizer"),
        F.array((100 * (1 + F.col("doc_id") % 2 * (F.col("doc_id") % 3))).cast("string")).alias(
            "campaigns"
        ),
        F.concat(F.lit("http://img/"), (F.col("doc_id") % 40).cast("string")).alias(
            "primary_image_url"
        ),
    )


cte(
    "text_posts",
    """
    SELECT doc_id AS post_id, user_id, 'user_' || user_id AS screen_name,
      epoch_us(ts) // 1000 AS timestamp_ms,
      text || ' #tag' || (doc_id % 7) || ' http://t.co/' || doc_id || ' in nation' || (doc_id % 25)
        AS text,
      lang, ['Lang_' || lang, source, 'tag' || (doc_id % 7)] AS hashtags,
      'hashtag' AS featurizer,
      [CAST(100 * (1 + doc_id % 2 * (doc_id % 3)) AS VARCHAR)] AS campaigns,
      'http://img/' || (doc_id % 40) AS primary_image_url
    FROM (SELECT *, doc_id * greatest(1, (SELECT count(*) FROM events) // (SELECT count(*) FROM documents))
        % (SELECT count(*) FROM events) AS nth FROM documents)
      JOIN events ON nth = event_id""",
)


def tag_clusters_sql(posts_name: str, span: int, min_posts: int) -> str:
    return f"""
    SELECT 'hashtag:' || end_ms || ':' || term AS cluster_id, 'hashtag' AS data_type,
      end_ms - {span - 1} AS start_time_ms, end_ms AS end_time_ms, term, size, total_posts
    FROM (
      SELECT end_ms, term, count(*) AS size FROM (
        SELECT timestamp_ms - timestamp_ms % {span} + {span - 1} AS end_ms,
          lower(unnest(hashtags)) AS term FROM {posts_name})
      GROUP BY ALL HAVING count(*) >= {min_posts})
    JOIN (
      SELECT timestamp_ms - timestamp_ms % {span} + {span - 1} AS end_ms, count(*) AS total_posts
      FROM {posts_name} GROUP BY ALL) USING (end_ms)"""


def tag_members_sql(posts_name: str, clusters_name: str, span: int) -> str:
    return f"""
    SELECT c.cluster_id, c.data_type, c.end_time_ms, m.post_id
    FROM (SELECT timestamp_ms - timestamp_ms % {span} + {span - 1} AS end_ms,
            lower(unnest(hashtags)) AS term, post_id FROM {posts_name}) m
    JOIN {clusters_name} c ON m.end_ms = c.end_time_ms AND m.term = c.term"""


def links_sql(members_name: str, overlap: float) -> str:
    return f"""
    SELECT p.end_time_ms, p.source, p.target, p.source_data_type, p.target_data_type,
      p.n_common, p.n_common / p.source_size AS weight
    FROM (
      SELECT a.end_time_ms, a.cluster_id AS source, b.cluster_id AS target,
        a.data_type AS source_data_type, b.data_type AS target_data_type,
        sa.size AS source_size, sum(a.times) AS n_common
      FROM (SELECT end_time_ms, cluster_id, data_type, post_id, count(*) AS times
            FROM {members_name} GROUP BY ALL) a
      JOIN (SELECT DISTINCT end_time_ms, cluster_id, data_type, post_id FROM {members_name}) b
        ON a.end_time_ms = b.end_time_ms AND a.post_id = b.post_id AND a.cluster_id <> b.cluster_id
      JOIN (SELECT cluster_id, count(*) AS size FROM {members_name} GROUP BY ALL) sa
        ON sa.cluster_id = a.cluster_id
      JOIN (SELECT cluster_id, count(*) AS size FROM {members_name} GROUP BY ALL) sb
        ON sb.cluster_id = b.cluster_id
      WHERE sa.size < sb.size OR (sa.size = sb.size AND a.cluster_id > b.cluster_id)
      GROUP BY ALL) p
    WHERE p.n_common / p.source_size > {overlap}"""


cte("clusters", tag_clusters_sql("posts", DAY_MS, MIN_TAG_POSTS), "posts")
cte("members", tag_members_sql("posts", "clusters", DAY_MS), "posts", "clusters")
cte("links", links_sql("members", 0.6), "members")
cte("doc_clusters", tag_clusters_sql("text_posts", DOC_SPAN_MS, DOC_MIN_POSTS), "text_posts")
cte("doc_members", tag_members_sql("text_posts", "doc_clusters", DOC_SPAN_MS), "text_posts", "doc_clusters")
cte("doc_links", links_sql("doc_members", 0.6), "doc_members")
cte(
    "doc_partition",
    """
    SELECT end_time_ms AS g, node, least(node, min(other)) AS community FROM (
      SELECT end_time_ms, source AS node, target AS other FROM doc_links
      UNION ALL SELECT end_time_ms, target, source FROM doc_links)
    GROUP BY end_time_ms, node""",
    "doc_links",
)
cte(
    "doc_ec",
    """
    SELECT p.g || '|' || p.community AS event_id, c.* FROM doc_partition p
    JOIN doc_clusters c ON c.cluster_id = p.node""",
    "doc_partition",
    "doc_clusters",
)
cte(
    "doc_events",
    """
    SELECT event_id, 'default' AS name, count(*) AS n_clusters,
      CAST(sum(size) AS BIGINT) AS topic_message_count, min(start_time_ms) AS start_time_ms,
      max(end_time_ms) AS end_time_ms, 1.0::DOUBLE AS importance_score
    FROM doc_ec GROUP BY event_id""",
    "doc_ec",
)


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    groups = ht.hashtag_groups(posts_w(spark, sf)).where(F.col("size") >= MIN_TAG_POSTS)
    return with_ids(groups)


def with_ids(groups: DataFrame) -> DataFrame:
    return groups.select(
        ht.cluster_id(F.lit("hashtag"), F.col("end_time_ms"), F.col("term")).alias("cluster_id"),
        F.lit("hashtag").alias("data_type"),
        "start_time_ms",
        "end_time_ms",
        "term",
        "size",
        "total_posts",
    )


def members(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(ht.hashtag_members(posts_w(spark, sf), clusters(spark, sf)), "members")


def links(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(lk.cluster_links(members(spark, sf)), "links")


def doc_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return wn.tumbling_windows(text_posts(spark, sf), DOC_SPAN_MS)


def doc_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return with_ids(
        ht.hashtag_groups(doc_windowed(spark, sf)).where(F.col("size") >= DOC_MIN_POSTS)
    )


def doc_members(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(ht.hashtag_members(doc_windowed(spark, sf), doc_clusters(spark, sf)), "members")


class DocGraph(NamedTuple):
    members: DataFrame
    links: DataFrame
    partition: DataFrame
    ec: DataFrame


def doc_graph(spark: SparkSession, sf: str) -> DocGraph:
    """Members, links, communities and event clusters of the documents, each made once."""
    return graph_of(doc_windowed(spark, sf), materialize(doc_clusters(spark, sf), "clusters"))


def graph_of(windowed: DataFrame, clusters: DataFrame) -> DocGraph:
    from pulseweave.operators.events import event_clusters
    from pulseweave.operators.graph import neighbour_partition

    rows = materialize(ht.hashtag_members(windowed, clusters), "members")
    found = materialize(lk.cluster_links(rows), "links")
    edges = found.select(F.col("end_time_ms").alias("g"), "source", "target", "weight")
    partition = neighbour_partition(edges)
    return DocGraph(rows, found, partition, materialize(event_clusters(partition, clusters), "event-clusters"))


def doc_ec(spark: SparkSession, sf: str) -> DataFrame:
    return doc_graph(spark, sf).ec


def doc_events(spark: SparkSession, sf: str) -> DataFrame:
    from pulseweave.operators.events import event_rollup

    return event_rollup(doc_ec(spark, sf))


# monitors: windows times settings, with ids ------------------------------------

cte(
    "job_windows",
    f"""
    SELECT start_time_ms, end_time_ms, count(*) AS n_posts,
      CASE WHEN count(*) >= 300 THEN 'running' ELSE 'new' END AS state
    FROM posts_w GROUP BY start_time_ms, end_time_ms""",
    "posts_w",
)
cte(
    "settings",
    """
    SELECT * FROM (VALUES ('text', 'en', 0.65::DOUBLE), ('text', 'ar', 0.65::DOUBLE),
      ('hashtag', NULL, NULL), ('image', NULL, 0.39::DOUBLE)) s(featurizer, lang, threshold)""",
)
cte(
    "monitors",
    """
    SELECT w.start_time_ms || ':' || s.featurizer || ':' || coalesce(s.lang, '') AS monitor_id,
      w.start_time_ms, w.end_time_ms, s.featurizer, s.lang, s.threshold, 'new' AS state
    FROM job_windows w CROSS JOIN settings s""",
    "job_windows",
    "settings",
)


def job_windows(spark: SparkSession, sf: str) -> DataFrame:
    return wn.window_counts(posts_w(spark, sf)).withColumn(
        "state", F.when(F.col("n_posts") >= 300, "running").otherwise("new")
    )


def settings(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        "(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in wn.DEFAULT_MONITORS
    )
    return spark.sql(
        f"SELECT featurizer, lang, CAST(threshold AS DOUBLE) AS threshold FROM VALUES {rows} t(featurizer, lang, threshold)"
    )


def monitors(spark: SparkSession, sf: str) -> DataFrame:
    rows = wn.expand_monitors(
        job_windows(spark, sf).select("start_time_ms", "end_time_ms"), settings(spark)
    )
    return rows.select(
        F.concat_ws(
            ":", F.col("start_time_ms").cast("string"), "featurizer", F.coalesce("lang", F.lit(""))
        ).alias("monitor_id"),
        "start_time_ms", "end_time_ms", "featurizer", "lang", "threshold", "state",
    )


# places --------------------------------------------------------------------------

cte(
    "gazetteer",
    """
    SELECT 'nation' || n_nationkey AS place, lower(n_name) AS city, r_name AS country,
      n_nationkey * 3 - 36 AS latitude, n_nationkey * 5 - 60 AS longitude
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("place"),
        F.lower("n_name").alias("city"),
        F.col("r_name").alias("country"),
        (F.col("n_nationkey") * 3 - 36).alias("latitude"),
        (F.col("n_nationkey") * 5 - 60).alias("longitude"),
    )


# word model: four dimensions from the md5 of each frequent English token -----------

SPACE_SQL = r"[\s\p{Z}\x{85}\x1c-\x1f]"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS_EN) + "]"


def tokens_en_sql(text: str, stop: bool = True) -> str:
    stop_cond = f" AND NOT list_contains({STOP_SQL}, w)" if stop else ""
    return rf"""list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(
        lower({text}), '{SPACE_SQL}', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s@#]', '', 'g')), ' '),
        lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[#@]|[#@]$|^\p{{Nd}}+$')
        AND NOT (length(w) > 4 AND (starts_with(w, 'http') OR starts_with(w, 'www'))){stop_cond}))"""


cte(
    "doc_tokens",
    f"SELECT doc_id, unnest({tokens_en_sql('text')}) AS token FROM documents WHERE lang = 'en'",
)
cte("token_df", "SELECT token, count(*) AS df FROM doc_tokens GROUP BY token", "doc_tokens")
NIBBLES = "0123456789abcdef"
cte(
    "word_model",
    "SELECT token, [" + ", ".join(
        f"CAST(strpos('{NIBBLES}', substr(md5(token), {i}, 1)) AS DOUBLE)" for i in (1, 2, 3, 4)
    ) + "] AS vector FROM token_df WHERE df >= 5",
    "token_df",
)


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = wide(spark, sf, "documents", "doc_id").where(F.col("lang") == "en")
    return token_rows(docs, "doc_id", tx.tokenize_en(F.col("text")))


def word_model(df: DataFrame) -> DataFrame:
    parts = [F.position(F.substring(F.md5("token"), i, 1), F.lit(NIBBLES)) for i in (1, 2, 3, 4)]
    return df.where(F.col("df") >= 5).select(
        "token", F.array(*[p.cast("double") for p in parts]).alias("vector")
    )
