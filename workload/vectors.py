"""Vector and clustering jobs over the embeddings, one window per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseweave.functions.vector import cosine
from pulseweave.operators import clustering as cl
from pulseweave.operators import vectorjobs as vj
from workload import views as v
from workload.registry import case

DIM = 64


def vectors(spark, sf):
    return v.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")
    )


COS_SQL = "list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))"
v.cte("vecs", "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings")


@case(
    "cosine_similarity",
    v.sql(
        f"""SELECT b.vec_id, round({COS_SQL}, 9) AS cosine FROM vecs a
        JOIN (SELECT label, min(vec_id) AS first_id FROM vecs GROUP BY label) f ON a.vec_id = f.first_id
        JOIN vecs b ON b.label = a.label""",
        "vecs",
    ),
)
def cosine_similarity(spark, sf):
    rows = vectors(spark, sf)
    first = rows.groupBy("label").agg(F.min_by("vector", "vec_id").alias("lead"))
    return rows.join(first, "label").select(
        "vec_id", F.round(cosine(F.col("vector"), F.col("lead")), 9).alias("cosine")
    )


@case(
    "skip_zero_vectors",
    """SELECT vec_id FROM embeddings WHERE label <> 3 AND (label <> 4 OR vec_id % 2 = 0)""",
)
def skip_zero_vectors(spark, sf):
    # One label gets zero vectors, one is made of pictures of which half lack an address.
    rows = vectors(spark, sf).select(
        "vec_id",
        F.when(F.col("label") == 3, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector")).alias("vector"),
        F.when(F.col("label") == 4, "image").otherwise("text").alias("featurizer"),
        F.when(F.col("vec_id") % 2 == 0, "http://img").alias("primary_image_url"),
    )
    return vj.skip_unusable_vectors(rows, "vector", "featurizer", "primary_image_url").select("vec_id")


PAIRS_SQL = f"""
    SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, {COS_SQL} AS cosine
    FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS_SQL} > 0.3"""
v.cte("pairs", PAIRS_SQL, "vecs")


def pairs(spark, sf):
    return vj.similarity_pairs(vectors(spark, sf), "label", "vec_id", "vector", 0.3)


@case(
    "similarity_pairs",
    v.sql("SELECT label, id_a, id_b, round(cosine, 6) AS cosine FROM pairs", "pairs"),
)
def similarity_pairs(spark, sf):
    return pairs(spark, sf).withColumn("cosine", F.round("cosine", 6))


def assigned(spark, sf, **kw):
    return cl.leader_clusters(
        vectors(spark, sf), ["label"], "vec_id", "vec_id", "vector", 0.2, **kw
    )


# The rule followed row by row: the list of leaders grows along each label's order.
v.cte(
    "led",
    """SELECT label, last(leaders ORDER BY pos) AS leaders FROM (
    WITH RECURSIVE o AS (
      SELECT label, vec_id, e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM vecs),
    r AS (
      SELECT label, pos, [struct_pack(id := vec_id, e := e)] AS leaders FROM o WHERE pos = 1
      UNION ALL
      SELECT o.label, o.pos, CASE WHEN len(list_filter(r.leaders,
          lambda l: round(list_cosine_similarity(l.e, o.e), 9) > 0.2)) = 0
        THEN list_append(r.leaders, struct_pack(id := o.vec_id, e := o.e)) ELSE r.leaders END
      FROM r JOIN o ON o.label = r.label AND o.pos = r.pos + 1)
    SELECT label, pos, leaders FROM r) GROUP BY label""",
    "vecs",
)
v.cte(
    "assigned",
    """SELECT label, vec_id, arg_min(lead, (-sim, lead)) AS leader,
      CASE WHEN arg_min(lead, (-sim, lead)) = vec_id THEN NULL ELSE max(sim) END AS similarity
    FROM (SELECT a.label, a.vec_id, l.id AS lead,
            CASE WHEN l.id = a.vec_id THEN 2.0 ELSE round(list_cosine_similarity(l.e, a.e), 9) END AS sim
          FROM vecs a JOIN (SELECT label, unnest(leaders) AS l FROM led) USING (label))
    GROUP BY label, vec_id""",
    "led",
)
LEADER_SQL = v.sql("SELECT label, vec_id, leader, round(similarity, 6) AS similarity FROM assigned", "assigned")


@case("leader_clusters", LEADER_SQL)
def leader_clusters(spark, sf):
    return assigned(spark, sf).select("label", "vec_id", "leader", F.round("similarity", 6).alias("similarity"))


@case("leader_clusters_distributed", LEADER_SQL)
def leader_clusters_distributed(spark, sf):
    """The same in rounds far smaller than the groups."""
    rows = assigned(spark, sf, round_rows=16)
    return rows.select("label", "vec_id", "leader", F.round("similarity", 6).alias("similarity"))


@case(
    "published_clusters",
    v.sql(
        """SELECT label, leader, count(*) AS size, round(coalesce(avg(similarity), 0), 6) AS average_similarity,
          round(coalesce(var_samp(similarity), 0), 6) AS variance, round(avg(e[1]), 6) AS c0
        FROM assigned JOIN vecs USING (label, vec_id) GROUP BY label, leader HAVING count(*) >= 4""",
        "assigned",
    ),
)
def published_clusters(spark, sf):
    out = cl.published_clusters(
        assigned(spark, sf), vectors(spark, sf), ["label"], "vec_id", "vector"
    )
    return out.select(
        "label", "leader", "size", F.round("average_similarity", 6).alias("average_similarity"),
        F.round("variance", 6).alias("variance"), F.round(F.col("centroid")[0], 6).alias("c0"),
    )


@case(
    "cluster_size_tiers",
    v.sql(
        """SELECT cluster_id, size, CASE WHEN size >= 10 THEN 'high' ELSE 'medium' END AS tier
        FROM (SELECT user_id * 100 + event_id % 60 AS cluster_id, count(*) AS size FROM events GROUP BY 1)
        WHERE size >= 4""",
    ),
)
def cluster_size_tiers(spark, sf):
    # Sixty clusters of each user's events, so that sizes fall in every tier.
    cluster = F.col("user_id") * 100 + F.col("event_id") % 60
    sizes = v.table(spark, sf, "events").groupBy(cluster.alias("cluster_id")).agg(F.count("*").alias("size"))
    return vj.cluster_size_tiers(sizes)


@case(
    "centroids",
    v.sql(
        "SELECT label, count(*) AS size, " + ", ".join(f"round(avg(e[{i + 1}]), 8) AS c{i}" for i in range(DIM))
        + " FROM vecs GROUP BY label",
        "vecs",
    ),
)
def centroids(spark, sf):
    out = vj.centroids(vectors(spark, sf), ["label"], "vector")
    return out.select(
        "label", "size", *[F.round(F.col("centroid")[i], 8).alias(f"c{i}") for i in range(DIM)]
    )


@case(
    "cluster_similarity_stats",
    v.sql(
        """SELECT id_a, round(avg(cosine), 6) AS average_similarity,
          round(coalesce(var_samp(cosine), 0), 6) AS variance, round(coalesce(stddev_samp(cosine), 0), 6) AS stddev
        FROM pairs GROUP BY id_a""",
        "pairs",
    ),
)
def cluster_similarity_stats(spark, sf):
    out = vj.cluster_similarity_stats(pairs(spark, sf), ["id_a"], "cosine")
    return out.select("id_a", *[F.round(c, 6).alias(c) for c in ("average_similarity", "variance", "stddev")])


@case("image_vectors")
def image_vectors(spark, sf):
    """Page sources stand for image files."""
    files = v.table(spark, sf, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    out = vj.image_vectors(files, bins=8)
    return out.select("path", *[F.round(F.get("vector", F.lit(i)), 9).alias(f"b{i}") for i in range(8)])


@case(
    "vector_scatter",
    v.sql(
        "WITH c AS (SELECT label, [" + ", ".join(f"avg(e[{i + 1}])" for i in range(DIM)) + """] AS centroid
            FROM vecs GROUP BY label),
        p AS (SELECT label, unnest(range(64)) AS idx, unnest(centroid) AS value FROM c ORDER BY label)
        SELECT label, idx, round(value, 8) AS value,
          round((SELECT list_min(centroid) FROM c ORDER BY label LIMIT 1), 8) AS y_min,
          round((SELECT list_max(centroid) FROM c ORDER BY label LIMIT 1), 8) AS y_max
        FROM p WHERE label IN (SELECT label FROM c ORDER BY label LIMIT 6)""",
        "vecs",
    ).replace("\nWITH c AS", ",\nc AS"),
)
def vector_scatter(spark, sf):
    cents = vj.centroids(vectors(spark, sf), ["label"], "vector").withColumn("data_type", F.lit("text"))
    return vj.vector_scatter(cents, "text", 7, "label").select(
        "label", "idx", *[F.round(c, 8).alias(c) for c in ("value", "y_min", "y_max")]
    )


@case(
    "l1_dot_similarity",
    v.sql(
        """, t AS (SELECT end_time_ms AS slot, term, size AS weight FROM clusters),
        s AS (SELECT slot, sum(weight) AS s FROM t GROUP BY slot)
        SELECT a.slot, round(coalesce(sum(x.weight * y.weight), 0) / (a.s * b.s), 9) AS score
        FROM s a JOIN s b ON b.slot = a.slot - 86400000
        JOIN t x ON x.slot = a.slot LEFT JOIN t y ON y.slot = b.slot AND y.term = x.term
        GROUP BY a.slot, a.s, b.s""",
        "clusters",
    ),
)
def l1_dot_similarity(spark, sf):
    terms = v.clusters(spark, sf).select(F.col("end_time_ms").alias("slot"), "term", F.col("size").alias("weight"))
    before = terms.withColumn("slot", F.col("slot") + v.DAY_MS)
    return vj.l1_dot_similarity(terms, before, ["slot"]).withColumn("score", F.round("score", 9))
