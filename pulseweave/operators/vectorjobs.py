"""Vector jobs: similarity pairs, centroids, statistics, image vectors, scatter."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions.vector import cosine, mean_vector, usable
from pulseweave.lineage import broadcast_if_small, materialize

BLOCK_ROWS = 4096
#: Cells of a product of two blocks that a task holds at a time.
STRIP_CELLS = 1 << 18


def skip_unusable_vectors(
    df: DataFrame, vector: str, featurizer: str | None = None, image_url: str | None = None
) -> DataFrame:
    """Rows that can be clustered; image rows also need their picture's address."""
    cond = usable(F.col(vector))
    if featurizer and image_url:
        cond = cond & ((F.col(featurizer) != "image") | F.col(image_url).isNotNull())
    return df.where(cond)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(float)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def strips(rows: int, columns: int) -> Iterator[slice]:
    """Slices of the rows of a product of blocks, each of a bounded number of cells."""
    height = max(1, STRIP_CELLS // max(1, columns))
    for start in range(0, rows, height):
        yield slice(start, start + height)


def _block_matches(left: pd.DataFrame, right: pd.DataFrame, same: bool, threshold: float):
    a, b = _unit_rows(left["v"]), _unit_rows(right["v"])
    left_ids, right_ids = left["id"].to_numpy(), right["id"].to_numpy()
    found = []
    for part in strips(len(a), len(b)):
        # A margin below the threshold; the exact test follows on the pairs kept.
        i, j = np.nonzero(a[part] @ b.T > threshold - 1e-6)
        i += part.start
        ids_a, ids_b = left_ids[i], right_ids[j]
        keep = ids_a < ids_b if same else ids_a != ids_b
        i, j, ids_a, ids_b = i[keep], j[keep], ids_a[keep], ids_b[keep]
        exact = np.einsum("ij,ij->i", a[i], b[j])
        hit = exact > threshold
        found.append((np.minimum(ids_a[hit], ids_b[hit]), np.maximum(ids_a[hit], ids_b[hit]), exact[hit]))
    lo, hi, exact = (np.concatenate(x) for x in zip(*found))
    return lo, hi, exact


def similarity_pairs(
    vectors: DataFrame, group: str, vec_id: str, vector: str, threshold: float,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs of a group whose cosine is strictly above the threshold, exactly.

    Each group is cut into blocks of bounded size and every pair of blocks is a
    task of its own, so a group of any size spreads over the cluster and no task
    holds more than two blocks and a strip of their product. Before vectors are sent anywhere, block pairs
    are dropped that a distance bound rules out: blocks are slices of the angle
    to one vector of the group, and two vectors whose angles to that common
    vector differ by more than the threshold angle cannot be similar enough.
    """
    rows = vectors.where(usable(F.col(vector))).select(
        F.col(group).alias("grp"), F.col(vec_id).alias("id"), F.col(vector).alias("v")
    )
    placed, slices = _angle_slices(rows, block_rows)
    reach = float(np.arccos(max(-1.0, min(1.0, threshold)))) + 1e-6
    a, b = slices.alias("a"), slices.alias("b")
    plan = a.join(
        b,
        (F.col("a.grp") == F.col("b.grp"))
        & (F.col("a.slice") <= F.col("b.slice"))
        & (F.col("b.lo") - F.col("a.hi") <= reach),
    ).select(
        F.col("a.grp").alias("grp"), F.col("a.slice").alias("sa"), F.col("b.slice").alias("sb")
    )
    plan = broadcast_if_small(plan)
    p = placed.alias("p")
    left = p.join(
        plan.alias("l"), (F.col("p.grp") == F.col("l.grp")) & (F.col("p.slice") == F.col("l.sa"))
    ).select(*_fresh("l"))
    right = p.join(
        plan.alias("r"),
        (F.col("p.grp") == F.col("r.grp"))
        & (F.col("p.slice") == F.col("r.sb"))
        & (F.col("r.sa") != F.col("r.sb")),
    ).select(*_fresh("r"))
    group_type = vectors.schema[group].dataType.simpleString()
    id_type = vectors.schema[vec_id].dataType.simpleString()

    def pair_up(key, l_rows: pd.DataFrame, r_rows: pd.DataFrame) -> pd.DataFrame:
        same = key[1] == key[2]
        other = l_rows if same else r_rows
        if len(l_rows) == 0 or len(other) == 0:
            return pd.DataFrame({"grp": [], "id_a": [], "id_b": [], "cosine": []})
        lo, hi, cos = _block_matches(l_rows, other, same, threshold)
        return pd.DataFrame({"grp": key[0], "id_a": lo, "id_b": hi, "cosine": cos})

    keys = ("grp", "sa", "sb")
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(
            pair_up, f"grp {group_type}, id_a {id_type}, id_b {id_type}, cosine double"
        )
        .withColumnRenamed("grp", group)
    )


def _fresh(plan: str) -> list[Column]:
    """Columns of one side of a block pair, named anew so that the sides differ."""
    names = {f"{plan}.grp": "grp", f"{plan}.sa": "sa", f"{plan}.sb": "sb", "p.id": "id", "p.v": "v"}
    return [F.col(old).alias(new) for old, new in names.items()]


ANGLE_STEPS = 1024
BASE_STRIDE, STEP_STRIDE = 10**10, 10**6


def _angle_slices(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Places vectors in slices of the angle to one vector of their group.

    Slices come from a histogram of angle steps per group, so they hold about
    ``block_rows`` vectors each; a single step larger than that is cut further
    by a hash of the id. Slice numbers rise with the angle.
    """
    pivots = rows.groupBy("grp").agg(F.min_by("v", "id").alias("pivot"))
    bounded = F.greatest(F.least(cosine(F.col("v"), F.col("pivot")), F.lit(1.0)), F.lit(-1.0))
    step_width = float(np.pi / ANGLE_STEPS)
    stepped = materialize(
        rows.join(broadcast_if_small(pivots), "grp").select(
            "grp", "id", "v", F.floor(F.acos(bounded) / step_width).cast("long").alias("step")
        ),
        "angles",
    )
    before = Window.partitionBy("grp").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    hist = (
        stepped.groupBy("grp", "step")
        .agg(F.count("*").alias("n"))
        .select(
            "grp",
            "step",
            F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_rows).alias("base"),
            F.ceil(F.col("n") / block_rows).cast("long").alias("parts"),
        )
    )
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    inside = F.when(F.col("parts") > 1, F.col("step") * STEP_STRIDE + part).otherwise(0)
    placed = stepped.join(broadcast_if_small(hist), ["grp", "step"]).withColumn(
        "slice", F.col("base") * BASE_STRIDE + inside
    )
    slices = placed.groupBy("grp", "slice").agg(
        (F.min("step") * step_width).alias("lo"), ((F.max("step") + 1) * step_width).alias("hi")
    )
    return placed.select("grp", "slice", "id", "v"), slices


def centroids(members: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Mean vector and size per cluster."""
    return members.groupBy(*by).agg(
        F.count("*").alias("size"), mean_vector(F.col(vector)).alias("centroid")
    )


def cluster_similarity_stats(sims: DataFrame, by: Sequence[str], sim: str) -> DataFrame:
    """Mean, sample variance and deviation of join similarities; zeros below two."""
    return sims.groupBy(*by).agg(
        F.coalesce(F.avg(sim), F.lit(0.0)).alias("average_similarity"),
        F.coalesce(F.var_samp(sim), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(sim), F.lit(0.0)).alias("stddev"),
    )


# Sizes at which a cluster is promoted.
MEDIUM_SIZE, HIGH_SIZE = 4, 10


def size_tier(size: Column) -> Column:
    return F.when(size >= HIGH_SIZE, "high").when(size >= MEDIUM_SIZE, "medium").otherwise("low")


def cluster_size_tiers(clusters: DataFrame, size: str = "size", published: bool = True) -> DataFrame:
    tiered = clusters.withColumn("tier", size_tier(F.col(size)))
    return tiered.where(F.col("tier") != "low") if published else tiered


FAILED_VECTOR = (-1.0,)


def byte_histogram(content: bytes, bins: int) -> Sequence[float]:
    """Default image vector: share of each byte range."""
    if not content:
        raise ValueError("empty image")
    counts, _ = np.histogram(np.frombuffer(content, dtype=np.uint8), bins=bins, range=(0, 256))
    return (counts / counts.sum()).tolist()


def image_vectors(
    images: DataFrame, model: Callable[[bytes], Sequence[float]] | None = None, bins: int = 64
) -> DataFrame:
    """Feature vector per image file (``path``, ``content``); a failed one gets ``[-1]``."""
    featurize = model or (lambda content: byte_histogram(content, bins))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                try:
                    out.append(list(featurize(content)))
                except Exception:
                    out.append(list(FAILED_VECTOR))
            yield pd.DataFrame({"path": batch["path"], "vector": out})

    return images.select("path", "content").mapInPandas(run, "path string, vector array<double>")


def vector_scatter(
    clusters: DataFrame, data_type: str, max_index: int, order: str, centroid: str = "centroid"
) -> DataFrame:
    """Points (cluster, index, value) of the first vectors, with the first one's value range."""
    first = (
        clusters.where((F.col("data_type") == data_type) & F.col(centroid).isNotNull())
        .orderBy(order)
        .limit(max_index - 1)
    )
    extent = clusters.where((F.col("data_type") == data_type) & F.col(centroid).isNotNull())
    head = extent.orderBy(order).limit(1)
    return (
        first.withColumn("y_min", head.select(F.array_min(centroid)).scalar())
        .withColumn("y_max", head.select(F.array_max(centroid)).scalar())
        .select(order, "y_min", "y_max", F.posexplode(centroid).alias("idx", "value"))
    )


def l1_dot_similarity(
    a: DataFrame, b: DataFrame, pair: Sequence[str], term: str = "term", weight: str = "weight"
) -> DataFrame:
    """Dot product of two L1-normalised weighted term lists per pair key.

    Lists without weight give no score.
    """
    sa = a.groupBy(*pair).agg(F.sum(weight).alias("_sa"))
    sb = b.groupBy(*pair).agg(F.sum(weight).alias("_sb"))
    common = (
        a.select(*pair, term, F.col(weight).alias("_wa"))
        .join(b.select(*pair, term, F.col(weight).alias("_wb")), [*pair, term])
        .groupBy(*pair)
        .agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    )
    totals = sa.join(sb, list(pair)).where((F.col("_sa") != 0) & (F.col("_sb") != 0))
    score = F.coalesce("_dot", F.lit(0.0)) / (F.col("_sa") * F.col("_sb"))
    return totals.join(common, list(pair), "left").select(*pair, score.alias("score"))
