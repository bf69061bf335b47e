"""Tag clusters, links and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.lineage import broadcast_if_small, materialize
from pulseweave.operators import graph as gr
from pulseweave.operators import hashtags as ht
from pulseweave.operators import links as lk
from workload import views as v
from workload.registry import case


@case(
    "hashtag_groups",
    v.sql(
        """SELECT end_time_ms, term, count(*) AS size, any_value(total_posts) AS total_posts FROM (
          SELECT end_time_ms, lower(unnest(hashtags)) AS term, count(*) OVER (PARTITION BY end_time_ms) AS total_posts
          FROM posts_w) GROUP BY ALL""",
        "posts_w",
    ).replace("any_value(total_posts)", "max(total_posts)"),
)
def hashtag_groups(spark, sf):
    return ht.hashtag_groups(v.posts_w(spark, sf)).select("end_time_ms", "term", "size", "total_posts")


@case("hashtag_members", v.sql("SELECT cluster_id, data_type, end_time_ms, post_id FROM members", "members"))
def hashtag_members(spark, sf):
    return v.members(spark, sf)


WEEK = 7 * v.DAY_MS
v.cte(
    "priors",
    f"""
    SELECT c.*, 1e-5 + coalesce(sum(p.size), 0) AS prior_alpha, 1 + coalesce(sum(p.total_posts), 0) AS prior_beta
    FROM clusters c LEFT JOIN clusters p ON p.term = c.term
      AND p.end_time_ms BETWEEN c.start_time_ms - {WEEK} AND c.start_time_ms
    GROUP BY ALL""",
    "clusters",
)
v.cte(
    "likelihoods",
    """
    SELECT *, least(1.0, list_sum(list_transform(
        range(CAST(ceil(prior_beta * size / total_posts + 10 * sqrt(prior_beta * size / total_posts) + 60) AS BIGINT)),
        lambda n: exp((prior_alpha + n) * ln(prior_beta * size / total_posts)
          - prior_beta * size / total_posts - lgamma(prior_alpha + n + 1))))) AS likelihood
    FROM priors""",
    "priors",
)
v.cte(
    "scored",
    "SELECT *, CASE WHEN likelihood > 0.7 THEN 1 ELSE 0 END AS is_unlikely FROM likelihoods",
    "likelihoods",
)


@case(
    "hashtag_priors",
    v.sql("SELECT cluster_id, round(prior_alpha, 6) AS prior_alpha, prior_beta FROM priors", "priors"),
)
def hashtag_priors(spark, sf):
    return ht.hashtag_priors(v.clusters(spark, sf), v.DAY_MS).select(
        "cluster_id", F.round("prior_alpha", 6).alias("prior_alpha"), "prior_beta"
    )


@case(
    "hashtag_likelihood",
    v.sql("SELECT cluster_id, round(likelihood, 6) AS likelihood FROM likelihoods", "likelihoods"),
)
def hashtag_likelihood(spark, sf):
    rows = ht.hashtag_likelihood(ht.hashtag_priors(v.clusters(spark, sf), v.DAY_MS))
    return rows.select("cluster_id", F.round("likelihood", 6).alias("likelihood"))


@case(
    "hashtag_clusters",
    v.sql(
        """SELECT cluster_id, start_time_ms, end_time_ms, term, size, total_posts,
          round(likelihood, 6) AS likelihood, is_unlikely FROM scored""",
        "scored",
    ),
)
def hashtag_clusters(spark, sf):
    return scored(spark, sf).select(
        "cluster_id", "start_time_ms", "end_time_ms", "term", "size", "total_posts",
        F.round("likelihood", 6).alias("likelihood"), "is_unlikely",
    )


def scored(spark, sf):
    return ht.hashtag_clusters(v.posts_w(spark, sf), v.DAY_MS, v.MIN_TAG_POSTS)


# -- links ----------------------------------------------------------------------------


@case(
    "cluster_links",
    v.sql(
        "SELECT end_time_ms, source, target, n_common, round(weight, 9) AS weight FROM links", "links"
    ),
)
def cluster_links(spark, sf):
    return v.links(spark, sf).select(
        "end_time_ms", "source", "target", "n_common", F.round("weight", 9).alias("weight")
    )


@case(
    "link_common_posts",
    v.sql(
        """SELECT l.source, l.target, a.post_id FROM links l JOIN members a ON a.cluster_id = l.source
        WHERE (l.target, a.post_id) IN (SELECT (cluster_id, post_id) FROM members)""",
        "links",
        "members",
    ),
)
def link_common_posts(spark, sf):
    members = v.members(spark, sf)
    return lk.link_common_posts(lk.cluster_links(members), members)


@case(
    "prune_unlikely",
    v.sql(
        """SELECT l.source, l.target, round(l.weight, 9) AS weight FROM links l
        JOIN scored a ON a.cluster_id = l.source JOIN scored b ON b.cluster_id = l.target
        WHERE a.is_unlikely = 1 AND b.is_unlikely = 1""",
        "links",
        "scored",
    ),
)
def prune_unlikely(spark, sf):
    _, kept = lk.prune_unlikely(scored(spark, sf), v.links(spark, sf))
    return kept.select("source", "target", F.round("weight", 9).alias("weight"))


@case(
    "graph_from_links",
    v.sql(
        """SELECT DISTINCT 'node' AS kind, n AS a, 'hashtag' AS b, NULL::DOUBLE AS value
        FROM (SELECT source AS n FROM links UNION ALL SELECT target FROM links)
        UNION ALL SELECT 'edge', source, target, round(weight, 9) FROM links""",
        "links",
    ),
)
def graph_from_links(spark, sf):
    nodes, edges = lk.graph_from_links(v.links(spark, sf))
    return nodes.select(
        F.lit("node").alias("kind"), F.col("node").alias("a"), F.col("data_type").alias("b"),
        F.lit(None).cast("double").alias("value"),
    ).unionByName(
        edges.select(
            F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"),
            F.round("value", 9).alias("value"),
        )
    )


# -- graphs ---------------------------------------------------------------------------


def link_edges(spark, sf):
    return v.links(spark, sf).select(F.col("end_time_ms").alias("g"), "source", "target", "weight")


@case("louvain_communities")
def louvain_communities(spark, sf):
    return gr.louvain_communities(link_edges(spark, sf))


@case(
    "louvain_cliques",
    """
    SELECT n_regionkey AS g, s_suppkey AS node,
      min(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey // 250) AS first_member
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def louvain_cliques(spark, sf):
    """Suppliers of one nation and id range all linked: the communities are these cliques, lone suppliers included."""
    nations = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("g"))
    own = v.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("nation"), F.floor(F.col("s_suppkey") / 250).alias("part")
    )
    own = own.join(nations, "nation")
    other = own.select("nation", "part", F.col("node").alias("target"))
    edges = own.withColumnRenamed("node", "source").join(other, ["nation", "part"]).where("source < target")
    part = gr.louvain_communities(edges.select("g", "source", "target", F.lit(1.0).alias("weight")), nodes=own.select("g", "node"))
    first = part.groupBy("g", "community").agg(F.min("node").alias("first_member"))
    return part.join(first, ["g", "community"]).select("g", "node", "first_member")


@case(
    "louvain_cover",
    v.sql(
        """SELECT end_time_ms AS g, count(DISTINCT node) AS n_nodes, true AS beats_neighbours
        FROM (SELECT end_time_ms, unnest([source, target]) AS node FROM links) GROUP BY end_time_ms""",
        "links",
    ),
)
def louvain_cover(spark, sf):
    """Every linked cluster has one community, and modularity is at least that of the neighbour partition."""
    edges = materialize(link_edges(spark, sf), "cover-edges")
    part = materialize(gr.louvain_communities(edges), "cover-partition")
    q = gr.modularity(edges, part)
    least = gr.modularity(edges, gr.neighbour_partition(edges)).withColumnRenamed("modularity", "least")
    nodes = part.groupBy("g").agg(F.count("*").alias("n_nodes"))
    return nodes.join(q, "g").join(least, "g").select(
        "g", "n_nodes", (F.col("modularity") >= F.col("least") - 1e-9).alias("beats_neighbours")
    )


# Buyers and suppliers of small orders as a graph per market: a larger test graph.
v.cte(
    "trade",
    """
    SELECT c_nationkey % 5 AS g, o_custkey AS source, 1000000 + l_suppkey AS target, l_quantity AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
)
v.cte(
    "trade_pairs",
    "SELECT g, source AS a, target AS b, sum(weight) AS w FROM trade GROUP BY ALL",
    "trade",
)
v.cte(
    "trade_part",
    "SELECT DISTINCT g, node, node % 7 AS community FROM (SELECT g, a AS node FROM trade_pairs UNION ALL SELECT g, b FROM trade_pairs)",
    "trade_pairs",
)


def trade(spark, sf):
    li, o, c = (v.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            (F.col("c_nationkey") % 5).alias("g"), F.col("o_custkey").alias("source"),
            (F.col("l_suppkey") + 1_000_000).alias("target"), F.col("l_quantity").alias("weight"),
        )
    )


def trade_part(spark, sf):
    pairs = gr.undirected(trade(spark, sf))
    return (
        pairs.select("g", F.explode(F.array("a", "b")).alias("node"))
        .distinct()
        .withColumn("community", F.col("node") % 7)
    )


@case(
    "modularity",
    v.sql(
        """, e AS (SELECT t.g, x.community AS ca, y.community AS cb, w FROM trade_pairs t
          JOIN trade_part x ON x.g = t.g AND x.node = t.a JOIN trade_part y ON y.g = t.g AND y.node = t.b),
        m AS (SELECT g, sum(w) AS m FROM e GROUP BY g),
        d AS (SELECT g, c, sum(w) AS deg FROM (SELECT g, ca AS c, w FROM e UNION ALL SELECT g, cb, w FROM e) GROUP BY ALL),
        i AS (SELECT g, sum(w) AS inside FROM e WHERE ca = cb GROUP BY g)
        SELECT m.g, round(i.inside / m.m - (SELECT sum((deg / (2 * m.m)) ** 2) FROM d WHERE d.g = m.g), 9) AS modularity
        FROM m JOIN i ON i.g = m.g""",
        "trade_pairs",
        "trade_part",
    ).replace(")\n, e AS", "),\ne AS"),
)
def modularity(spark, sf):
    return gr.modularity(trade(spark, sf), trade_part(spark, sf)).withColumn(
        "modularity", F.round("modularity", 9)
    )


@case(
    "contract_graph",
    v.sql(
        """SELECT t.g, least(x.community, y.community) AS source, greatest(x.community, y.community) AS target,
          sum(w) AS weight FROM trade_pairs t JOIN trade_part x ON x.g = t.g AND x.node = t.a
          JOIN trade_part y ON y.g = t.g AND y.node = t.b GROUP BY ALL""",
        "trade_pairs",
        "trade_part",
    ),
)
def contract_graph(spark, sf):
    return gr.contract_graph(trade(spark, sf), trade_part(spark, sf))


@case(
    "partition_at_level",
    v.sql(
        """SELECT g, node, community, dense_rank() OVER (PARTITION BY g ORDER BY community) - 1 AS number
        FROM (SELECT g, node, 10 + community % 3 AS community FROM trade_part)""",
        "trade_part",
    ),
)
def partition_at_level(spark, sf):
    low = trade_part(spark, sf)
    high = low.select("g", F.col("community").alias("node"), (10 + F.col("community") % 3).alias("community")).distinct()
    whole = gr.partition_at_level([low, high])
    return whole.join(
        gr.renumber(whole).withColumnRenamed("community", "number"), ["g", "node"]
    ).select("g", "node", "community", "number")


@case(
    "community_members",
    v.sql(
        """SELECT g, community, node, count(*) OVER (PARTITION BY g, community) AS n_members FROM trade_part""",
        "trade_part",
    ),
)
def community_members(spark, sf):
    return gr.community_members(trade_part(spark, sf))


@case("louvain_trade")
def louvain_trade(spark, sf):
    """Communities and modularity of the trade graphs."""
    edges = materialize(gr.undirected(trade(spark, sf)), "trade").withColumnsRenamed(
        {"a": "source", "b": "target", "w": "weight"}
    )
    part = gr.louvain_communities(edges)
    sizes = part.groupBy("g").agg(F.count_distinct("community").alias("n_communities"))
    return sizes.join(gr.modularity(edges, part), "g").withColumn("modularity", F.round("modularity", 6))


# -- authors ---------------------------------------------------------------------------

v.cte(
    "authors",
    """
    SELECT DISTINCT e.event_id, p.screen_name AS author FROM doc_ec e
    JOIN doc_members m ON m.cluster_id = e.cluster_id JOIN text_posts p ON p.post_id = m.post_id""",
    "doc_ec",
    "doc_members",
    "text_posts",
)
v.cte(
    "follows",
    """
    SELECT 'user_' || a.user_id AS follower, 'user_' || b.user_id AS followed
    FROM (SELECT DISTINCT user_id FROM events) a JOIN (SELECT DISTINCT user_id FROM events) b
      ON (a.user_id * 7 + b.user_id * 3) % 11 = 0 AND a.user_id <> b.user_id""",
)


def authors(spark, sf):
    doc = v.doc_graph(spark, sf)
    return materialize(gr.event_authors(doc.ec, doc.members, v.text_posts(spark, sf)), "authors")


def follows(spark, sf):
    # a*7 + b*3 = 0 (mod 11) holds for one remainder of b per remainder of a, so
    # the follower table is an equi-join of the users with themselves. Users are few and
    # their pairs many, so the followers are dealt over all tasks.
    users = v.table(spark, sf, "events").select("user_id").distinct()
    users = users.repartition(4 * spark.sparkContext.defaultParallelism, "user_id")
    a = users.select(F.col("user_id").alias("a"), ((F.col("user_id") * 5) % 11).alias("r"))
    b = users.select(F.col("user_id").alias("b"), (F.col("user_id") % 11).alias("r"))
    pairs = a.join(broadcast_if_small(b), "r").where("a <> b")
    return pairs.select(
        F.concat(F.lit("user_"), F.col("a").cast("string")).alias("follower"),
        F.concat(F.lit("user_"), F.col("b").cast("string")).alias("followed"),
    )


@case("event_authors", v.sql("SELECT event_id, author FROM authors", "authors"))
def event_authors(spark, sf):
    return authors(spark, sf)


v.cte(
    "network_pairs",
    """
    SELECT DISTINCT x.event_id, least(x.author, y.author) AS a, greatest(x.author, y.author) AS b
    FROM authors x JOIN follows f ON f.follower = x.author
    JOIN authors y ON y.event_id = x.event_id AND y.author = f.followed""",
    "authors",
    "follows",
)


def hash_sql(col: str) -> str:
    u = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({col}, ''),
      lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)"""
    return f"(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END)"


@case(
    "user_network",
    v.sql(
        f"""SELECT event_id, 'link' AS kind, {hash_sql('a')} AS x, CAST({hash_sql('b')} AS VARCHAR) AS y FROM network_pairs
        UNION ALL SELECT event_id, 'node', {hash_sql('n')}, n FROM (
          SELECT event_id, a AS n FROM network_pairs UNION SELECT event_id, b FROM network_pairs)""",
        "network_pairs",
    ),
)
def user_network(spark, sf):
    nodes, links = gr.user_network(authors(spark, sf), follows(spark, sf))
    return links.select(
        "event_id", F.lit("link").alias("kind"), F.col("source").alias("x"), F.col("target").cast("string").alias("y")
    ).unionByName(nodes.select("event_id", F.lit("node").alias("kind"), F.col("id").alias("x"), F.col("name").alias("y")))
