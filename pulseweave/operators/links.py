"""Links between clusters of a window that share posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import materialize

MIN_OVERLAP = 0.6
_TIES = 16


def cluster_links(members: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Pairs of clusters whose overlap is above ``min_overlap``, exactly.

    ``members`` holds (cluster_id, data_type, end_time_ms, post_id), repeats
    counted. The overlap is the share of the smaller cluster's posts found in
    the larger one; at equal size the cluster with the later id is the source.

    A qualifying pair shares a post among the rarest posts of its smaller
    cluster: leave out the commonest posts of that cluster as long as their
    weight is within ``min_overlap`` of its size, and what they could add is not
    enough. So only those rare posts look for partners, and posts that sit in
    very many clusters generate no pairs unless a cluster has nothing else. The
    overlap of the candidates found is then counted in full.
    """
    unique = members.groupBy("end_time_ms", "post_id", "cluster_id", "data_type").agg(
        F.count("*").alias("times")
    )
    unique = materialize(unique, "members")
    sizes = unique.groupBy("cluster_id").agg(F.sum("times").alias("size"))
    reach = unique.groupBy("end_time_ms", "post_id").agg(F.count("*").alias("reach"))
    rows = (
        unique.join(reach.where(F.col("reach") > 1), ["end_time_ms", "post_id"], "left")
        .join(sizes, "cluster_id")
        .withColumn("reach", F.coalesce("reach", F.lit(1)))
        .withColumn("level", F.col("reach") * _TIES + F.pmod(F.xxhash64("post_id"), F.lit(_TIES)))
    )
    rows = materialize(rows, "ranked-members")

    # Weight per rarity level and cluster, then the level where the rest is too light.
    per_level = rows.groupBy("cluster_id", "size", "level").agg(F.sum("times").alias("w"))
    upto = Window.partitionBy("cluster_id").orderBy("level")
    cut = (
        per_level.withColumn("seen", F.sum("w").over(upto))
        .where(F.col("size") - F.col("seen") <= F.col("size") * min_overlap)
        .groupBy("cluster_id")
        .agg(F.min("level").alias("cut"))
    )
    probe = (
        rows.join(cut, "cluster_id")
        .where((F.col("level") <= F.col("cut")) & (F.col("reach") > 1))
        .select(
            "end_time_ms", "post_id", F.col("cluster_id").alias("source"),
            F.col("data_type").alias("source_data_type"), F.col("size").alias("source_size"),
        )
    )
    index = rows.where(F.col("reach") > 1).select(
        "end_time_ms", "post_id", F.col("cluster_id").alias("target"),
        F.col("data_type").alias("target_data_type"), F.col("size").alias("target_size"),
    )
    smaller_first = (F.col("source_size") < F.col("target_size")) | (
        (F.col("source_size") == F.col("target_size")) & (F.col("source") > F.col("target"))
    )
    candidates = (
        probe.join(index, ["end_time_ms", "post_id"])
        .where(smaller_first)
        .select(
            "end_time_ms", "source", "source_data_type", "source_size", "target", "target_data_type"
        )
        .distinct()
    )
    source_posts = unique.select(F.col("cluster_id").alias("source"), "post_id", "times")
    target_posts = unique.select(F.col("cluster_id").alias("target"), "post_id")
    return (
        candidates.join(source_posts, "source")
        .join(target_posts, ["target", "post_id"])
        .groupBy(*candidates.columns)
        .agg(F.sum("times").alias("n_common"))
        .withColumn("weight", F.col("n_common") / F.col("source_size"))
        .where(F.col("weight") > min_overlap)
        .select(
            "end_time_ms", "source", "source_data_type", "target", "target_data_type",
            "weight", "n_common",
        )
    )


def link_common_posts(links: DataFrame, members: DataFrame) -> DataFrame:
    """The shared posts of each link as rows (source, target, post_id)."""
    src = members.select(F.col("cluster_id").alias("source"), "post_id")
    tgt = members.select(F.col("cluster_id").alias("target"), "post_id").distinct()
    return (
        links.select("source", "target")
        .join(src, "source")
        .join(tgt, ["target", "post_id"], "left_semi")
        .select("source", "target", "post_id")
    )


def prune_unlikely(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops clusters scored as ordinary, and every link that touches one.

    Clusters without a score stay.
    """
    ordinary = F.coalesce(F.col("is_unlikely") == 0, F.lit(False))
    dropped = nodes.where(ordinary).select("cluster_id")
    kept = links
    for end in ("source", "target"):
        kept = kept.join(dropped.select(F.col("cluster_id").alias(end)), end, "left_anti")
    return nodes.where(~ordinary), kept.select(*links.columns)


def graph_from_links(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, data_type) of both link ends, and weighted edges."""
    ends = [
        links.select(
            "end_time_ms", F.col(e).alias("node"), F.col(f"{e}_data_type").alias("data_type")
        )
        for e in ("source", "target")
    ]
    nodes = ends[0].unionByName(ends[1]).distinct()
    edges = links.select("end_time_ms", "source", "target", F.col("weight").alias("value"))
    return nodes, edges
