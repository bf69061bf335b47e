"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseweave.lineage import materialize


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``low``: the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(least, "u").withColumn("low", F.least("u", "low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rated = _least_neighbour(both)
    return rated.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rated = _least_neighbour(down)
    moved = rated.select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = rated.select("u", F.col("low").alias("v"))
    return moved.union(own).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest: equal in two rounds only at the end."""
    row = edges.agg(
        F.count("*"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to rows (u, v) where v is the least id of u's component.

    Nodes that are the least of their component have no row. Rounds go on until
    nothing changes, O(log² n) of them; the state of a round is a table in shared
    storage, and the driver sees its row count and digest only.
    """
    state = materialize(edges.filter("u <> v").select("u", "v").distinct(), "components")
    mark = _mark(state)
    while mark[0]:
        state = materialize(_small_star(_large_star(state)), "components")
        now = _mark(state)
        if now == mark:
            break
        mark = now
    return state
