"""Document query, edit and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.functions import clock, hashing
from pulseweave.operators import query as q
from pulseweave.sources import collections as col
from pulseweave.sources import tweets as tw
from workload import views as v
from workload.registry import case

LO, HI = 1_704_240_000_000, 1_704_844_800_000  # 2024-01-03 to 2024-01-10


@case("read_collection", "SELECT event_id, user_id, event_type, value FROM events")
def read_collection(spark, sf):
    return col.read_collection(spark, f"{sf}/events.parquet").select(
        "event_id", "user_id", "event_type", "value"
    )


@case("write_collection", "SELECT doc_id, lang, source, n_chars FROM documents")
def write_collection(spark, sf):
    from pulseweave.lineage import new_path

    path = new_path(spark, "collection")
    df = v.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    col.write_collection(df, path, mode="append", partition_by=("lang",))
    return col.read_collection(spark, path, df.schema)


@case(
    "explode_event_clusters",
    v.sql(
        f"""SELECT post_id AS event_id, timestamp_ms AS start_time_ms, timestamp_ms + 999 AS end_time_ms,
          unnest(hashtags) AS cluster_id FROM posts WHERE timestamp_ms >= {LO}""",
        "posts",
    ),
)
def explode_event_clusters(spark, sf):
    # Posts stand for small events, their tags for the clusters of each.
    nested = v.posts(spark, sf).select(
        F.col("post_id").alias("event_id"), F.col("timestamp_ms").alias("start_time_ms"),
        (F.col("timestamp_ms") + 999).alias("end_time_ms"), F.col("hashtags").alias("cluster_ids"),
    )
    return col.explode_event_clusters(nested, LO)


TWEET_JSON_SQL = """
    SELECT event_id, 'user_' || user_id AS name, user_id, event_type,
      json_extract_string(props, '$.k') AS k, epoch_us(ts) // 1000 AS ms FROM events"""


def raw_tweets(spark, sf):
    """Events as tweet JSON lines."""
    e = v.table(spark, sf, "events")
    sid = F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    tweet = F.struct(
        sid.alias("id_str"),
        F.concat_ws(" ", "event_type", k).alias("text"),
        F.lit("en").alias("lang"),
        F.date_format(F.col("ts").cast("timestamp"), "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.struct(
            F.col("user_id").cast("string").alias("id_str"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("screen_name"),
        ).alias("user"),
        F.struct(F.array(F.struct(F.col("event_type").alias("text"))).alias("hashtags")).alias("entities"),
        F.when(
            F.col("event_type") == "click",
            F.struct(
                F.concat(F.lit("quoted "), k).alias("text"),
                F.struct(F.array(F.struct(F.concat(F.lit("q"), k).alias("text"))).alias("hashtags")).alias("entities"),
            ),
        ).alias("quoted_status"),
        F.when(F.col("event_type") == "view", F.struct((F.col("event_id") % 97).cast("string").alias("id_str"))).alias(
            "retweeted_status"
        ),
    )
    return e.select(F.to_json(tweet).alias("value"))


@case(
    "tweet_ingest",
    f"""SELECT CAST(event_id AS VARCHAR) AS post_id, name AS screen_name,
      CAST(user_id AS VARCHAR) AS author_id,
      'https://twitter.com/' || name || '/status/' || event_id AS post_url,
      event_type || ' ' || k AS text, event_type AS tags, 0 AS n_urls,
      CASE WHEN event_type = 'view' THEN CAST(event_id % 97 AS VARCHAR) END AS broadcast_post_id
    FROM ({TWEET_JSON_SQL})""",
)
def tweet_ingest(spark, sf):
    return tw.tweet_ingest(tw.parse_tweets(raw_tweets(spark, sf))).select(
        "post_id", "screen_name", "author_id", "post_url", "text",
        F.array_join("hashtags", ",").alias("tags"),
        F.size("image_urls").alias("n_urls"),
        "broadcast_post_id",
    )


TRACKED = ("the", "and", "reti", "ing")


@case(
    "keyword_track",
    rf"""SELECT doc_id, lang FROM documents WHERE list_has_any(string_split(regexp_replace(
      regexp_replace(lower(text), '{v.SPACE_SQL}', ' ', 'g'), '[^\p{{L}}\p{{N}}_ ]', ' ', 'g'), ' '),
      ['the', 'and', 'reti', 'ing'])""",
)
def keyword_track(spark, sf):
    return tw.keyword_track(v.wide(spark, sf, "documents", "doc_id"), TRACKED).select("doc_id", "lang")


def feeds(spark, sf):
    """Suppliers as feeds; those in debt are switched off."""
    return v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("feed_id"),
        F.col("s_name").alias("url"),
        (F.col("s_acctbal") > 0).alias("active"),
    )


def running(spark, sf):
    """Feeds that deliver: the suppliers of small orders."""
    return (
        v.table(spark, sf, "lineitem")
        .where(F.col("l_quantity") <= 1)
        .select(F.col("l_suppkey").cast("string").alias("feed_id"))
        .distinct()
    )


@case(
    "active_feeds_delta",
    """WITH f AS (SELECT CAST(s_suppkey AS VARCHAR) AS feed_id FROM supplier WHERE s_acctbal > 0),
    r AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS feed_id FROM lineitem WHERE l_quantity <= 1)
    SELECT feed_id, 'added' AS change FROM f WHERE feed_id NOT IN (SELECT feed_id FROM r)
    UNION ALL
    SELECT feed_id, 'removed' FROM r WHERE feed_id NOT IN (SELECT feed_id FROM f)""",
)
def active_feeds_delta(spark, sf):
    added, removed = col.active_feeds_delta(feeds(spark, sf), running(spark, sf))
    return added.select("feed_id", F.lit("added").alias("change")).unionByName(
        removed.select("feed_id", F.lit("removed").alias("change"))
    )


@case(
    "export_time_slice",
    v.sql(
        f"""SELECT 'post' AS kind, CAST(post_id AS VARCHAR) AS id, 'new' AS state FROM posts
        WHERE state <> 'new' AND timestamp_ms BETWEEN {HI} AND {HI + v.DAY_MS}
        UNION ALL SELECT 'cluster', cluster_id, NULL FROM clusters
        WHERE start_time_ms >= {HI - 7 * v.DAY_MS} AND start_time_ms < {HI}""",
        "posts",
        "clusters",
    ),
)
def export_time_slice(spark, sf):
    _, earlier, reset = col.export_time_slice(
        v.posts(spark, sf), v.clusters(spark, sf), HI, HI + v.DAY_MS
    )
    return reset.select(
        F.lit("post").alias("kind"), F.col("post_id").cast("string").alias("id"), "state"
    ).unionByName(
        earlier.select(
            F.lit("cluster").alias("kind"), F.col("cluster_id").alias("id"),
            F.lit(None).cast("string").alias("state"),
        )
    )


@case(
    "change_feed",
    """SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'purchase')
    AND value > 5""",
)
def change_feed(spark, sf):
    e = v.table(spark, sf, "events").withColumn(
        "type",
        F.when(F.col("event_type") == "signup", "create")
        .when(F.col("event_type") == "purchase", "update")
        .otherwise("delete"),
    )
    return col.change_feed(e, F.col("value") > 5).select("event_id", "event_type")


# -- filters --------------------------------------------------------------------------

POST_COLS = ["post_id", "screen_name", "timestamp_ms"]


@case(
    "filter_between",
    v.sql(f"SELECT post_id, screen_name, timestamp_ms FROM posts WHERE timestamp_ms BETWEEN {LO} AND {HI}", "posts"),
)
def filter_between(spark, sf):
    return q.apply_filter(
        v.posts(spark, sf), {"where": {"timestamp_ms": {"between": [LO, HI]}}, "fields": POST_COLS}
    )


@case("filter_where_eq", "SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def filter_where_eq(spark, sf):
    return q.apply_filter(
        v.table(spark, sf, "documents"), {"where": {"lang": "fr"}, "fields": ["doc_id", "source"]}
    )


@case(
    "filter_inq",
    """SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')
    AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def filter_inq(spark, sf):
    docs = q.apply_filter(v.table(spark, sf, "documents"), {"where": {"lang": {"inq": ["fr", "de"]}}})
    good = v.table(spark, sf, "labels").where("quality = 1")
    return q.in_table(docs, "doc_id", good, "doc_id").select("doc_id", "lang")


@case(
    "filter_neq",
    v.sql(
        """SELECT post_id, broadcast_post_id FROM posts
        WHERE broadcast_post_id IS NOT NULL AND broadcast_post_id <> '5'""",
        "posts",
    ),
)
def filter_neq(spark, sf):
    where = {"and": [{"broadcast_post_id": {"neq": None}}, {"broadcast_post_id": {"neq": "5"}}]}
    return q.apply_filter(
        v.posts(spark, sf), {"where": where, "fields": ["post_id", "broadcast_post_id"]}
    )


@case("filter_or", "SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src3' OR n_chars > 5000")
def filter_or(spark, sf):
    where = {"or": [{"lang": "de"}, {"source": "src3"}, {"n_chars": {"gt": 5000}}]}
    return q.apply_filter(v.table(spark, sf, "documents"), {"where": where, "fields": ["doc_id"]})


@case(
    "filter_range_ops",
    """SELECT event_id, value FROM events WHERE value > 2.5 AND value < 40 AND user_id >= 10
    AND event_type IS DISTINCT FROM 'view'""",
)
def filter_range_ops(spark, sf):
    where = {"value": {"gt": 2.5, "lt": 40}, "user_id": {"gte": 10}, "event_type": {"neq": "view"}}
    return q.apply_filter(
        v.table(spark, sf, "events"), {"where": where, "fields": ["event_id", "value"]}
    )


@case("project_fields", "SELECT o_orderkey, o_orderpriority FROM orders")
def project_fields(spark, sf):
    return q.apply_filter(v.table(spark, sf, "orders"), {"fields": ["o_orderkey", "o_orderpriority"]})


@case(
    "order_limit",
    "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25",
)
def order_limit(spark, sf):
    return q.apply_filter(
        v.table(spark, sf, "events"),
        {"order": ["value desc", "event_id"], "limit": 25, "fields": ["event_id", "value"]},
    )


@case(
    "count_where",
    v.sql(
        f"SELECT count(*) AS count FROM posts WHERE state = 'new' AND timestamp_ms BETWEEN {LO} AND {HI}",
        "posts",
    ),
)
def count_where(spark, sf):
    return q.count_where(
        v.posts(spark, sf), {"state": "new", "timestamp_ms": {"between": [LO, HI]}}
    )


@case(
    "find_first",
    "SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 1",
)
def find_first(spark, sf):
    return q.find_first(
        v.table(spark, sf, "events"), {"event_type": "purchase"}, ["value desc", "event_id"]
    ).select("event_id", "ts")


@case(
    "keyset_page",
    "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND event_id > 300 ORDER BY event_id LIMIT 100",
)
def keyset_page(spark, sf):
    return q.keyset_page(
        v.table(spark, sf, "events"), "event_id", 300, 100, {"event_type": "click"}
    ).select("event_id", "user_id")


@case(
    "include_relation",
    v.sql(
        """SELECT w.start_time_ms, w.n_posts, count(m.monitor_id) AS n_monitors,
          string_agg(m.monitor_id, ',' ORDER BY m.monitor_id) AS monitor_ids
        FROM job_windows w LEFT JOIN monitors m ON m.start_time_ms = w.start_time_ms
        GROUP BY ALL""",
        "job_windows",
        "monitors",
    ),
)
def include_relation(spark, sf):
    parents = v.job_windows(spark, sf).select("start_time_ms", "n_posts")
    children = v.monitors(spark, sf).select(F.col("start_time_ms").alias("set_start"), "monitor_id")
    nested = q.include_relation(parents, children, "start_time_ms", "set_start", "monitors", max_children=4)
    return nested.select(
        "start_time_ms", "n_posts", F.size("monitors").alias("n_monitors"),
        F.array_join(F.transform("monitors", lambda m: m["monitor_id"]), ",").alias("monitor_ids"),
    )


@case(
    "include_relation_rows",
    """SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def include_relation_rows(spark, sf):
    c = v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    o = v.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return q.include_relation(c, o, "c_custkey", "o_custkey", "orders").select(
        "c_custkey", "c_mktsegment", "orders.o_orderkey", "orders.o_totalprice"
    )


@case(
    "find_or_create",
    """SELECT doc_id, quality, toxic FROM labels
    UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def find_or_create(spark, sf):
    defaults = v.table(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")
    )
    return q.find_or_create(v.table(spark, sf, "labels"), defaults, ["doc_id"])


UPDATES_SQL = """
    SELECT o_custkey, o_totalprice, o_orderkey FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r
      FROM orders) WHERE r = 1"""


@case(
    "upsert_by_key",
    f"""WITH u AS ({UPDATES_SQL})
    SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM u)
    UNION ALL SELECT o_custkey, o_totalprice FROM u""",
)
def upsert_by_key(spark, sf):
    updates = q.latest_by_key(
        v.table(spark, sf, "orders"),
        ["o_custkey"],
        [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()],
    ).select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"))
    base = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return q.upsert_by_key(base, updates, ["c_custkey"])


@case(
    "update_all",
    v.sql(
        """SELECT post_id, CASE WHEN state = 'featurized' THEN 'done' ELSE state END AS state
        FROM posts""",
        "posts",
    ),
)
def update_all(spark, sf):
    return q.update_all(v.posts(spark, sf), {"state": "featurized"}, {"state": "done"}).select(
        "post_id", "state"
    )


@case(
    "destroy_by_ids",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def destroy_by_ids(spark, sf):
    toxic = v.table(spark, sf, "labels").where("toxic = 1")
    return q.destroy_by_ids(v.table(spark, sf, "documents"), toxic, "doc_id").select("doc_id", "lang")


@case("destroy_all", "SELECT doc_id, lang FROM documents WHERE false")
def destroy_all(spark, sf):
    return q.destroy_all(v.table(spark, sf, "documents").select("doc_id", "lang"))


SETTING_KIND = ("boolean", "int", "float", "object", "string")


@case(
    "typed_settings",
    """SELECT p_partkey AS key,
      CASE WHEN p_size % 5 = 0 THEN (p_brand <> 'false') END AS bool_value,
      CASE WHEN p_size % 5 = 1 THEN CAST(p_size AS BIGINT) END AS int_value,
      CASE WHEN p_size % 5 = 2 THEN p_retailprice END AS float_value,
      CASE WHEN p_size % 5 = 3 THEN p_brand END AS object_brand,
      CASE WHEN p_size % 5 = 4 THEN p_name END AS string_value
    FROM part""",
)
def typed_settings(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in SETTING_KIND]), (F.col("p_size") % 5 + 1).cast("int"))
    p = v.table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"),
        kind.alias("type"),
        F.element_at(
            F.array(
                F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"),
                F.to_json(F.struct(F.col("p_brand").alias("brand"))), F.col("p_name"),
            ),
            (F.col("p_size") % 5 + 1).cast("int"),
        ).alias("value"),
    )
    return q.typed_settings(p).select(
        "key", "bool_value", "int_value", "float_value",
        F.col("object_value")["brand"].alias("object_brand"), "string_value",
    )


@case("created_stamp", "SELECT doc_id, true AS stamped FROM documents")
def created_stamp(spark, sf):
    rows = q.created_stamp(v.table(spark, sf, "documents").select("doc_id"))
    return rows.select("doc_id", F.col("created").isNotNull().alias("stamped"))


# -- scalars --------------------------------------------------------------------------


@case("ms_from_dt", "SELECT event_id, (epoch_us(ts) // 1000 // 1000) * 1000 AS ms FROM events")
def ms_from_dt(spark, sf):
    return v.table(spark, sf, "events").select("event_id", clock.ms_from_ts(F.col("ts")).alias("ms"))


@case(
    "ms_from_string",
    """SELECT o_orderkey, epoch_ms(o_orderdate) AS ms,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders""",
)
def ms_from_string(spark, sf):
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".979Z"))
    return v.table(spark, sf, "orders").select(
        "o_orderkey",
        clock.ms_from_iso(iso).alias("ms"),
        F.date_format(clock.ts_from_iso(iso), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
    )


@case(
    "dt_from_ms",
    v.sql(
        "SELECT post_id, strftime(epoch_ms(timestamp_ms), '%Y-%m-%d %H:%M:%S.%g') AS at FROM posts", "posts"
    ),
)
def dt_from_ms(spark, sf):
    return v.posts(spark, sf).select(
        "post_id",
        F.date_format(clock.ts_from_ms(F.col("timestamp_ms")), "yyyy-MM-dd HH:mm:ss.SSS").alias("at"),
    )


@case(
    "ms_time_interval",
    """SELECT l_orderkey, l_linenumber,
      CAST(trunc((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000) AS BIGINT) * 1000 AS ms
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def ms_time_interval(spark, sf):
    li, o = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        clock.ms_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("ms"),
    )


@case(
    "iso_time",
    v.sql(
        """SELECT post_id, CASE WHEN timestamp_ms % 1000 = 0
          THEN strftime(epoch_ms(timestamp_ms), '%Y-%m-%dT%H:%M:%S')
          ELSE strftime(epoch_ms(timestamp_ms), '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM posts""",
        "posts",
    ),
)
def iso_time(spark, sf):
    return v.posts(spark, sf).select("post_id", clock.iso_from_ms(F.col("timestamp_ms")).alias("iso"))


@case(
    "array_helpers",
    v.sql(
        """SELECT post_id, array_to_string(list_concat(hashtags, campaigns), ',') AS joined,
          len(list_filter([broadcast_post_id, quote_post_id, reply_to_post_id], lambda x: x IS NOT NULL))
            AS n_refs,
          hashtags[1] AS first_tag, len(list_distinct(list_concat(hashtags, hashtags))) AS n_unique
        FROM posts""",
        "posts",
    ),
)
def array_helpers(spark, sf):
    refs = F.array_compact(F.array("broadcast_post_id", "quote_post_id", "reply_to_post_id"))
    return v.posts(spark, sf).select(
        "post_id",
        F.array_join(F.concat("hashtags", "campaigns"), ",").alias("joined"),
        F.size(refs).cast("long").alias("n_refs"),
        F.get(F.slice("hashtags", 1, 1), F.lit(0)).alias("first_tag"),
        F.size(F.array_distinct(F.concat("hashtags", "hashtags"))).cast("long").alias("n_unique"),
    )


@case(
    "string_hash32",
    """WITH RECURSIVE w AS (SELECT doc_id, source || ':' || lang || doc_id AS s FROM documents),
    h AS (SELECT doc_id, s, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''),
      lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) AS u FROM w)
    SELECT doc_id, CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END AS hash FROM h""",
)
def string_hash32(spark, sf):
    name = F.concat(F.col("source"), F.lit(":"), F.col("lang"), F.col("doc_id").cast("string"))
    return v.table(spark, sf, "documents").select(
        "doc_id", hashing.string_hash32(name).alias("hash")
    )
