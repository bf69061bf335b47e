"""Leader clustering of vectors in arrival order, per group of posts.

The rule: a vector leads a cluster if no earlier leader of its group is more
similar to it than the threshold; every other vector belongs to the leader it is
most similar to. Unlike a running mean, leaders do not move, so the outcome depends
on arrival order alone and not on how rows are spread, and centroids, tiers and
statistics follow from the members afterwards.

Leaders are found in rounds over the vectors that none leads so far. Each round takes
the first of them in every group, a bounded number, finds the leaders among them in
order, and leaves those of the others that no new leader is similar to. Vectors that
are led are not looked at again until the end, when all vectors meet the leaders of
their group once, in blocks of bounded size. Leaders that the angles to a few pivots put
out of a block's reach are left out of the products.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.functions.vector import mean_vector, usable
from pulseweave.lineage import materialize
from pulseweave.operators.vectorjobs import MEDIUM_SIZE

DEFAULT_THRESHOLD = 0.5
#: Undecided vectors of a group that one round looks at in order.
ROUND_ROWS = 2048
#: Vectors of a group that meet a round's leaders in one task.
BLOCK_ROWS = 16_384
DIGITS = 9
#: Leaders that serve as pivots, and rows that are held against them together.
PIVOTS, SLICE_ROWS = 8, 512


def _join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins on the group keys, of which any may be null; ``right`` gives its other columns."""
    own = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c).alias(c) for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(own, on).drop(*[f"_r_{k}" for k in keys])


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(float)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _cosines(rows: np.ndarray, leaders: np.ndarray) -> np.ndarray:
    """Cosines rounded so that the same pair compares alike in every task."""
    return np.round(rows @ leaders.T, DIGITS)


def first_leaders(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Positions of the leaders among unit vectors in order."""
    leaders: list[int] = []
    for i in range(len(rows)):
        if not leaders or not (_cosines(rows[i : i + 1], rows[leaders]) > threshold).any():
            leaders.append(i)
    return np.array(leaders, dtype=int)


def best_leaders(rows: np.ndarray, leaders: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors the earliest most similar leader (-1: none above the threshold) and the cosine.

    Rows are taken in slices of similar angle to the first pivot; a leader whose angle to
    some pivot lies further from the slice's than the threshold allows is not compared.
    """
    best, sim = np.full(len(rows), -1), np.full(len(rows), -2.0)
    if len(leaders) <= 2 * PIVOTS:
        slices, in_reach = [np.arange(len(rows))], None
    else:
        angle = lambda x: np.arccos(np.clip(x @ leaders[:PIVOTS].T, -1, 1))
        own, theirs = angle(rows), angle(leaders)
        order = np.argsort(own[:, 0], kind="stable")
        slices = [order[i : i + SLICE_ROWS] for i in range(0, len(rows), SLICE_ROWS)]
        reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
        in_reach = lambda at: np.flatnonzero(((theirs >= own[at].min(axis=0) - reach) & (theirs <= own[at].max(axis=0) + reach)).all(axis=1))
    for at in slices:
        met = np.arange(len(leaders)) if in_reach is None else in_reach(at)
        if len(at) and len(met):
            sims = _cosines(rows[at], leaders[met])
            first = sims.argmax(axis=1)
            sim[at] = sims[np.arange(len(at)), first]
            best[at] = np.where(sim[at] > threshold, met[first], -1)
    return best, sim


def _new_leaders(batch: DataFrame, keys: Sequence[str], types: dict[str, str], threshold: float) -> DataFrame:
    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_nth")
        found = own.iloc[first_leaders(_unit(own["vector"]), threshold)]
        return found[names]

    names = [*keys, "item", "ord", "vector"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    return batch.select(*names, "_nth").groupBy(*keys).applyInPandas(run, schema)


def _meet(rows: DataFrame, leaders: DataFrame, keys: Sequence[str], schema: str, run) -> DataFrame:
    """Each block of a group's rows together with the leaders of that group."""
    blocks = rows.select(*keys, "_block").distinct()
    named = leaders.select(*keys, F.col("item").cast("string").alias("l_item"), F.col("item").alias("l_key"), F.col("ord").alias("l_ord"), F.col("vector").alias("l_vector"))
    by = [*keys, "_block"]
    mine = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    return mine.groupBy(*by).cogroup(_join_groups(named, blocks, keys).groupBy(*by)).applyInPandas(run, schema)


def _ordered(new: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    new = new.sort_values(["l_ord", "l_key"], kind="stable")
    return new["l_item"].to_numpy(), _unit(new["l_vector"])


def _not_led(rest: DataFrame, leaders: DataFrame, keys: Sequence[str], types: dict[str, str], threshold: float) -> DataFrame:
    names = rest.columns

    def run(own: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(new):
            return own[names]
        best, _ = best_leaders(_unit(own["vector"]), _ordered(new)[1], threshold)
        return own[names][best < 0]

    return _meet(rest, leaders, keys, ", ".join(f"`{c}` {types[c]}" for c in names), run)


def _assigned(rows: DataFrame, leaders: DataFrame, keys: Sequence[str], types: dict[str, str], threshold: float) -> DataFrame:
    """Ids of rows with their leader among ``leaders``, if any; 2 stands for a leader's similarity with itself."""
    names = [*keys, "item"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", leader string, similarity double"

    def run(own: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out = own[names].copy()
        out["leader"], out["similarity"] = None, -2.0
        if len(own) and len(new):
            ids, vectors = _ordered(new)
            best, sim = best_leaders(_unit(own["vector"]), vectors, threshold)
            led = best >= 0
            leader = np.full(len(own), None, object)
            leader[led] = ids[best[led]]
            itself = own["_id"].isin(set(ids)).to_numpy()
            leader[itself] = own["_id"].to_numpy()[itself]
            out["leader"], out["similarity"] = leader, np.where(itself, 2.0, sim)
        return out[out["leader"].notna()]

    return _meet(rows, leaders, keys, schema, run)


def _whole_groups(rows: DataFrame, keys: Sequence[str], types: dict[str, str], threshold: float) -> DataFrame:
    """Leaders and members of groups that one task may hold."""
    names = [*keys, "item"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["ord", "item"], kind="stable")
        vectors = _unit(own["vector"])
        leaders = first_leaders(vectors, threshold)
        best, sim = best_leaders(vectors, vectors[leaders], threshold)
        itself = np.isin(np.arange(len(own)), leaders)
        out = own[names].copy()
        out["leader"] = own["item"].to_numpy()[np.where(itself, np.arange(len(own)), leaders[best])]
        out["similarity"] = pd.Series(sim, index=out.index).astype(object).where(~itself, None)
        return out

    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + f", leader {types['item']}, similarity double"
    return rows.groupBy(*keys).applyInPandas(run, schema)


def leader_clusters(
    vectors: DataFrame,
    group: Sequence[str],
    vec_id: str,
    order: str,
    vector: str,
    threshold: float = DEFAULT_THRESHOLD,
    round_rows: int = ROUND_ROWS,
) -> DataFrame:
    """Rows (group, vec_id, leader, similarity): the cluster of each usable vector.

    ``leader`` is the id of the cluster's first vector; ``similarity`` is the cosine
    with it, null for a leader. ``round_rows`` bounds a round's work and has no
    influence on the outcome. Ids are unique within a group, not across groups.
    """
    keys = list(group)
    rows = vectors.where(usable(F.col(vector))).select(
        *keys, F.col(vec_id).alias("item"), F.col(order).alias("ord"), F.col(vector).cast("array<double>").alias("vector")
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # Leaders are held as strings: a column of whole numbers with nulls would become inexact.
    types |= {"_id": "string", "_block": "long"}
    rows = materialize(rows, "leader-rows")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
    left, most, found = rows, sizes.agg(F.max("_size")).first()[0] or 0, []
    if most <= round_rows:
        # Every group is one round, whose task can see to its members too.
        return _whole_groups(rows, keys, types, threshold).withColumnRenamed("item", vec_id)
    blocks = sizes.select(*keys, F.ceil(F.col("_size") / BLOCK_ROWS).alias("_blocks"))
    rows = _join_groups(rows, blocks, keys).select(
        *keys, "item", "ord", "vector", F.col("item").cast("string").alias("_id"), F.pmod(F.xxhash64("item"), F.col("_blocks")).alias("_block")
    )
    left = rows
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "item"))
    while most:
        batch = left.withColumn("_nth", nth).where(F.col("_nth") <= round_rows)
        found.append(materialize(_new_leaders(batch, keys, types, threshold), "leaders"))
        if most <= round_rows:
            break
        last = F.max(F.struct("ord", "item")).alias("_last")
        rest = _join_groups(left, batch.groupBy(*keys).agg(last), keys).where(F.struct("ord", "item") > F.col("_last")).drop("_last")
        left = materialize(_not_led(rest, found[-1], keys, types, threshold), "not-led")
        most = left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    parts = [_assigned(rows, leaders, keys, types, threshold).withColumn("_round", F.lit(i)) for i, leaders in enumerate(found)]
    led = parts[0].drop("_round")
    if len(parts) > 1:
        # Leaders of earlier rounds come first among equals.
        best = F.max_by(F.struct("leader", "similarity"), F.struct("similarity", -F.col("_round"))).alias("best")
        led = reduce(DataFrame.unionByName, parts).groupBy(*keys, "item").agg(best).select(*keys, "item", "best.*")
    leader = F.col("leader").cast(types["item"]).alias("leader")
    return led.select(*keys, F.col("item").alias(vec_id), leader, F.when(F.col("similarity") < 2, F.col("similarity")).alias("similarity"))


def published_clusters(assigned: DataFrame, vectors: DataFrame, group: Sequence[str], vec_id: str, vector: str) -> DataFrame:
    """Size, centroid and similarity statistics of clusters of at least four vectors."""
    keys = [*group, vec_id]
    rows = _join_groups(assigned, vectors.select(*keys, F.col(vector).alias("_v")), keys)
    sim = F.col("similarity")
    return (
        rows.groupBy(*group, "leader")
        .agg(
            F.count("*").alias("size"),
            mean_vector(F.col("_v")).alias("centroid"),
            F.coalesce(F.avg(sim), F.lit(0.0)).alias("average_similarity"),
            F.coalesce(F.var_samp(sim), F.lit(0.0)).alias("variance"),
        )
        .where(F.col("size") >= MEDIUM_SIZE)
    )
