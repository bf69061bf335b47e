"""Ingest, windows and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.operators import ingest as ig
from pulseweave.operators import windows as wn
from workload import views as v
from workload.registry import case

REQUIRED_SQL = """
    SELECT event_id, CAST(event_id AS VARCHAR) AS post_id, event_type AS post_type,
      CASE WHEN value > 2 THEN 'http://posts/' || event_id END AS post_url,
      CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS timestamp_ms,
      CASE WHEN event_type IN ('view', 'click') THEN event_type END AS text,
      CASE WHEN event_type = 'click' THEN ['http://img/' || event_id] END AS images,
      CASE WHEN event_type IN ('click', 'signup') THEN ['t' || user_id, 'k'] END AS hashtags
    FROM events"""


def raw(spark, sf):
    """Events as posts the way they arrive: fields missing here and there."""
    return raw_from(v.table(spark, sf, "events"))


def raw_from(e):
    kind = F.col("event_type")
    sid = F.col("event_id").cast("string")
    return e.select(
        "event_id",
        "ts",
        sid.alias("post_id"),
        kind.alias("post_type"),
        F.when(F.col("value") > 2, F.concat(F.lit("http://posts/"), sid)).alias("post_url"),
        F.when(kind != "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp_ms"),
        F.when(kind.isin("view", "click"), kind).alias("text"),
        F.when(
            kind == "click",
            F.array(F.struct(F.concat(F.lit("http://img/"), sid).alias("expanded_url"))),
        ).alias("image_urls"),
        F.when(
            kind.isin("click", "signup"),
            F.array(F.concat(F.lit("t"), F.col("user_id").cast("string")), F.lit("k")),
        ).alias("hashtags"),
    )


@case(
    "validate_posts",
    f"""SELECT post_id, (post_url IS NOT NULL AND timestamp_ms IS NOT NULL) AS valid,
      array_to_string(list_filter([CASE WHEN post_url IS NULL THEN 'post_url' END,
        CASE WHEN timestamp_ms IS NULL THEN 'timestamp_ms' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM ({REQUIRED_SQL})""",
)
def validate_posts(spark, sf):
    ok, bad = ig.validate_posts(raw(spark, sf))
    return ok.select("post_id", F.lit(True).alias("valid"), F.lit("").alias("reasons")).unionByName(
        bad.select("post_id", F.lit(False).alias("valid"), F.array_join("reasons", ",").alias("reasons"))
    )


@case(
    "normalize_posts",
    f"""SELECT post_id, 'new' AS state, epoch_us(CAST(replace(replace(timestamp_ms, 'T', ' '), 'Z', '')
        AS TIMESTAMP)) // 1000 AS timestamp_ms,
      coalesce(text, '') AS text, coalesce(len(images), 0) AS n_images,
      coalesce(array_to_string(hashtags, ','), '') AS tags FROM ({REQUIRED_SQL})""",
)
def normalize_posts(spark, sf):
    return ig.normalize_posts(raw(spark, sf)).select(
        "post_id", "state", "timestamp_ms", "text", F.size("image_urls").alias("n_images"),
        F.array_join("hashtags", ",").alias("tags"),
    )


@case(
    "merge_quoted_status",
    """SELECT CAST(event_id AS VARCHAR) AS post_id,
      CASE WHEN event_type = 'click' THEN event_type || ',q' || json_extract_string(props, '$.k')
        ELSE event_type END AS tags,
      event_type || ' ' || json_extract_string(props, '$.k') || CASE WHEN event_type = 'click'
        THEN ' quoted ' || json_extract_string(props, '$.k') ELSE '' END AS text
    FROM events""",
)
def merge_quoted_status(spark, sf):
    from pulseweave.sources.tweets import parse_tweets, tweet_ingest
    from workload.documents import raw_tweets

    posts = tweet_ingest(parse_tweets(raw_tweets(spark, sf)))
    return ig.merge_quoted_status(posts).select(
        "post_id", F.array_join("hashtags", ",").alias("tags"), "text"
    )


@case(
    "fan_out_featurizers",
    f"""SELECT post_id, f AS featurizer FROM ({REQUIRED_SQL}),
      unnest(['text', 'image', 'hashtag']) u(f)
    WHERE (f = 'text' AND text IS NOT NULL) OR (f = 'image' AND images IS NOT NULL)
      OR (f = 'hashtag' AND hashtags IS NOT NULL)""",
)
def fan_out_featurizers(spark, sf):
    rows = ig.fan_out_featurizers(ig.normalize_posts(raw(spark, sf)))
    return rows.select("post_id", "featurizer")


@case(
    "dedupe_posts",
    """SELECT conv_id AS post_id, role AS featurizer, turn, text FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS r
      FROM conversations) WHERE r = 1""",
)
def dedupe_posts(spark, sf):
    # Turns of a conversation stand for re-sent posts: one is kept per speaker.
    rows = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("post_id"), F.col("role").alias("featurizer"), "turn", "text"
    )
    return ig.dedupe_posts(rows, "turn")


@case(
    "govern_traffic",
    """SELECT event_id, user_id FROM (
      SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r FROM events) WHERE r % 5 = 0""",
)
def govern_traffic(spark, sf):
    e = v.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ig.govern_traffic(e, 0.25, ["ts", "event_id"]).select("event_id", "user_id")


@case(
    "feed_item_dedupe",
    """SELECT url AS guid, lang AS "extractType", page_id FROM (
      SELECT url, lang, page_id, row_number() OVER (PARTITION BY url, lang ORDER BY page_id) AS r FROM (
        SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS url, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang,
          page_id FROM pages))
    WHERE r = 1 AND (url, lang) NOT IN (SELECT (regexp_extract(url, 'https?://([^/]+)', 1),
      regexp_extract(url, '/(en|fr|de|es)/', 1)) FROM pages WHERE html LIKE '%ad 1 %')""",
)
def feed_item_dedupe(spark, sf):
    # Hosts stand for item ids; hosts with a given advert count as seen before.
    items = v.table(spark, sf, "pages").select(
        F.regexp_extract("url", "https?://([^/]+)", 1).alias("guid"),
        F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("extractType"),
        "page_id",
        "html",
    )
    existing = items.where(F.col("html").contains("ad 1 "))
    return ig.feed_item_dedupe(items.drop("html"), existing, "page_id")


@case(
    "feed_to_posts",
    """SELECT url AS post_id, 'rss' AS post_type, url AS post_url, title AS text,
      (1704067200 + page_id * 60) * 1000 AS timestamp_ms, 'en' AS lang, 'text' AS featurizer
    FROM (SELECT url, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    WHERE NOT contains(title, '%')""",
)
def feed_to_posts(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    at = F.timestamp_seconds(F.col("page_id") * 60 + 1704067200)
    items = v.table(spark, sf, "pages").select(
        F.col("url").alias("guid"),
        F.col("url").alias("link"),
        title.alias("description"),
        F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z").alias("pubdate"),
        title.contains("%").alias("processed"),
    )
    return ig.feed_to_posts(items).drop("state")


@case(
    "capture_image_refs",
    """WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS ref,
        generate_subscripts(regexp_extract_all(html, 'href="/([^"]+)"', 1), 1) AS pos FROM pages),
    t AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT page_id, ref AS token FROM r) GROUP BY token),
    f AS (SELECT page_id, arg_min('http://img/' || ref, pos) AS primary_image_url
      FROM r JOIN t ON t.token = r.ref WHERE t.df < 20 GROUP BY page_id)
    SELECT u.page_id AS post_id, u.urls, f.primary_image_url FROM (
      SELECT page_id, string_agg(ref, ',' ORDER BY pos) AS urls FROM r GROUP BY page_id) u
    LEFT JOIN f ON f.page_id = u.page_id""",
)
def capture_image_refs(spark, sf):
    # Links of a page stand for a post's links; the ones not found on many pages have an image.
    refs = F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)
    posts = v.table(spark, sf, "pages").select(
        F.col("page_id").alias("post_id"),
        F.lit("image").alias("featurizer"),
        F.transform(refs, lambda r: F.struct(r.alias("expanded_url"))).alias("image_urls"),
    )
    seen = posts.select("post_id", F.explode(F.array_distinct("image_urls.expanded_url")).alias("url"))
    fetched = (
        seen.groupBy("url")
        .agg(F.count("*").alias("df"))
        .select("url", F.when(F.col("df") < 20, F.concat(F.lit("http://img/"), "url")).alias("image_url"))
    )
    return ig.capture_image_refs(posts, fetched, "image_url")


# -- windows --------------------------------------------------------------------------


@case(
    "tumbling_windows",
    v.sql(
        """SELECT post_id, w AS start_time_ms, w + 1799999 AS end_time_ms FROM (
          SELECT post_id, timestamp_ms - (timestamp_ms - 600000) % 1800000 AS w FROM posts)""",
        "posts",
    ),
)
def tumbling_windows(spark, sf):
    return wn.tumbling_windows(v.posts(spark, sf), origin_ms=600_000).select(
        "post_id", "start_time_ms", "end_time_ms"
    )


@case(
    "window_min_posts_gate",
    v.sql(
        """SELECT start_time_ms, end_time_ms, count(*) AS n_posts FROM posts_w
        GROUP BY ALL HAVING count(*) >= 330""",
        "posts_w",
    ),
)
def window_min_posts_gate(spark, sf):
    return wn.window_min_posts_gate(v.posts_w(spark, sf), 330)


@case(
    "window_retry_state",
    """WITH p AS (SELECT epoch_us(ts) // 86400000000 AS window_id, (epoch_us(ts) // 21600000000) % 4 AS poll,
        count(*) AS n FROM events GROUP BY ALL),
    c AS (SELECT window_id, poll, sum(n) OVER (PARTITION BY window_id ORDER BY poll) AS n_posts FROM p),
    s AS (SELECT window_id, min(CASE WHEN n_posts >= 255 THEN poll END) AS hit, max(poll) AS last
      FROM c GROUP BY window_id)
    SELECT window_id, CASE WHEN hit <= 2 THEN 'running' WHEN last >= 2 THEN 'skip' ELSE 'new' END AS state,
      CASE WHEN hit <= 2 THEN hit WHEN last >= 2 THEN 2 ELSE last + 1 END AS retries FROM s""",
)
def window_retry_state(spark, sf):
    # Four polls a day; each sees the posts that had arrived by then.
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    polls = (
        v.table(spark, sf, "events")
        .groupBy(
            F.floor(us / 86_400_000_000).alias("window_id"), (F.floor(us / 21_600_000_000) % 4).alias("poll")
        )
        .agg(F.count("*").alias("n"))
        .withColumn("n_posts", F.sum("n").over(Window.partitionBy("window_id").orderBy("poll")))
    )
    return wn.window_retry_state(polls, limit=2, min_posts=255)


@case(
    "expand_monitors",
    v.sql("SELECT monitor_id, start_time_ms, end_time_ms, featurizer, lang, threshold, state FROM monitors", "monitors"),
)
def expand_monitors(spark, sf):
    return v.monitors(spark, sf)


@case(
    "select_batch",
    v.sql(
        """SELECT m.monitor_id, p.post_id FROM posts p JOIN monitors m
        ON p.timestamp_ms BETWEEN m.start_time_ms AND m.end_time_ms AND p.state = 'new'
          AND p.featurizer = m.featurizer AND (m.featurizer <> 'text' OR m.lang = p.lang)
        UNION ALL
        SELECT m.monitor_id, p.post_id FROM text_posts p JOIN monitors m
        ON p.timestamp_ms BETWEEN m.start_time_ms AND m.end_time_ms
          AND m.featurizer = 'text' AND m.lang = p.lang""",
        "posts",
        "text_posts",
        "monitors",
    ),
)
def select_batch(spark, sf):
    cols = ["post_id", "timestamp_ms", "featurizer", "lang", "state"]
    texts = v.text_posts(spark, sf).withColumns({"featurizer": F.lit("text"), "state": F.lit("new")})
    both = v.posts(spark, sf).select(*cols).unionByName(texts.select(*cols))
    return wn.select_batch(both, v.monitors(spark, sf), v.DAY_MS).select("monitor_id", "post_id")


MONITOR_STATE_SQL = """
    SELECT o_orderkey AS set_id, l_linenumber AS monitor_no,
      CASE WHEN l_returnflag = 'R' THEN 'linker' ELSE 'text' END AS featurizer,
      CASE WHEN l_linestatus = 'F' THEN 'done' WHEN l_quantity > 30 THEN 'featurized'
        WHEN l_quantity > 15 THEN 'preprocessed' ELSE 'new' END AS state
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def work_items(spark, sf):
    """Line items as the monitors of an order."""
    li = v.table(spark, sf, "lineitem")
    qty = F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").alias("set_id"),
        F.col("l_linenumber").alias("monitor_no"),
        F.when(F.col("l_returnflag") == "R", "linker").otherwise("text").alias("featurizer"),
        F.when(F.col("l_linestatus") == "F", "done")
        .when(qty > 30, "featurized")
        .when(qty > 15, "preprocessed")
        .otherwise("new")
        .alias("state"),
    )


@case(
    "all_done_gate",
    f"""SELECT set_id, count(*) AS n_monitors FROM ({MONITOR_STATE_SQL}) WHERE featurizer <> 'linker'
    GROUP BY set_id HAVING bool_and(state = 'done')""",
)
def all_done_gate(spark, sf):
    return wn.all_done_gate(work_items(spark, sf), ["set_id"])


@case(
    "advance_state",
    f"""SELECT set_id, monitor_no, CASE
      WHEN featurizer = 'linker' THEN CASE WHEN state = 'new' THEN 'done' ELSE state END
      WHEN state = 'new' THEN 'preprocessed' WHEN state = 'preprocessed' THEN 'featurized'
      WHEN state = 'featurized' THEN 'done' ELSE state END AS state FROM ({MONITOR_STATE_SQL})""",
)
def advance_state(spark, sf):
    return wn.advance_state(work_items(spark, sf)).select("set_id", "monitor_no", "state")


@case(
    "monitor_error_summary",
    """SELECT user_id AS monitor, string_agg('[key ' || event_id || '] ' || value, ',' ORDER BY event_id) AS error
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events
      WHERE event_type = 'error') WHERE r <= 10 GROUP BY user_id""",
)
def monitor_error_summary(spark, sf):
    errors = v.table(spark, sf, "events").where("event_type = 'error'").select(
        F.col("user_id").alias("monitor"),
        "event_id",
        F.concat(F.lit("[key "), F.col("event_id").cast("string"), F.lit("] "), F.col("value").cast("string")).alias("msg"),
    )
    return wn.monitor_error_summary(errors, "monitor", "event_id", "msg")
