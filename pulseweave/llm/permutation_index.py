"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index is cut into blocks of
vectors; in a block, pivot inverted files post every vector under each of its pivots,
with the place that the pivot has in the vector's order. A query reads the files of its
own pivots and adds up, per vector, what each shared pivot takes off the footrule
distance of the two orders. The vectors nearest by footrule, a bounded share of the
block, are reranked by the exact cosine; no other vector is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import materialize

NEIGHBOURS = 5
SEED = 23
#: Vectors and queries of one block.
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 4_096
#: More than cosines of unit vectors in single precision are off.
ROUGH_ERROR = 1e-4


@dataclass(frozen=True)
class Layout:
    """Pivots, how many of them represent a vector, and how many vectors a query reranks.

    Pivots are drawn by hash from the table, twice the square root of its size within the
    bounds given. A vector is posted under its ``posted`` nearest, and a query reads as
    many files. Of each block the ``share`` nearest by footrule are reranked, and ``more``.
    """

    least_pivots: int = 256
    most_pivots: int = 4096
    posted: int = 64
    share: float = 0.08
    more: int = 32

    def pivots(self, rows: int) -> int:
        return min(self.most_pivots, max(self.least_pivots, 2 * math.isqrt(rows)))

    def shortlist(self, rows: int) -> int:
        return min(rows, math.ceil(self.share * rows) + self.more)


def usable(vector: Column) -> Column:
    """True for vectors with finite components that are not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector, nearest first, ties to the lower pivot."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int16)


class PivotFiles:
    """Inverted files of a block: under each pivot the rows that hold it, and its place there."""

    def __init__(self, held: np.ndarray, pivots: int) -> None:
        self.rows, self.length = held.shape
        by_pivot = np.argsort(held.ravel(), kind="stable")
        self.row, self.place = np.divmod(by_pivot, max(self.length, 1))
        self.starts = np.searchsorted(held.ravel()[by_pivot], np.arange(pivots + 1))

    def shared(self, order: np.ndarray) -> np.ndarray:
        """Per row, half of what the pivots it shares with ``order`` take off the footrule distance.

        A pivot that only one order has stands behind the end of the other. With places a
        and b of a shared pivot in orders of length m, the distance is less by
        (m - a) + (m - b) - abs(a - b), which is twice m - max(a, b).
        """
        low, high = self.starts[order], self.starts[order + 1]
        size = high - low
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        worth = self.length - np.maximum(self.place[at], np.repeat(np.arange(len(order)), size))
        return np.bincount(self.row[at], weights=worth, minlength=self.rows)

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of ``order`` to every row."""
        return self.length * (self.length + 1) - 2 * self.shared(order)


def exact_cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal values wherever they stand."""
    dots = (vectors * query[None, :]).sum(axis=1)
    norms = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
    return np.clip(dots / norms, -1.0, 1.0)


def nearest(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest ids of a shortlist and their exact cosines, ties to the smaller id.

    An id with several vectors counts once, by its nearest. ``rough`` are single
    precision cosines; what they put near the k-th id is computed exactly.
    """
    names, of = np.unique(ids, return_inverse=True)
    tops = np.full(len(names), -np.inf)
    np.maximum.at(tops, of, rough)
    bound = np.partition(tops, len(tops) - k)[len(tops) - k] if len(tops) > k else -np.inf
    near = np.flatnonzero(rough >= bound - ROUGH_ERROR)
    scores = exact_cosines(query, vectors[near].astype(float))
    best = np.lexsort((ids[near], -scores))
    best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])][:k]
    return ids[near][best], scores[best]


def shortlist(shared: np.ndarray, most: int, least: int) -> np.ndarray:
    """The ``most`` rows nearest by footrule, with all that tie with the last.

    Rows that share no pivot are in it only if fewer than ``least`` others are.
    """
    if most >= len(shared):
        return np.arange(len(shared))
    bound = np.partition(shared, len(shared) - most)[len(shared) - most]
    found = np.flatnonzero(shared >= max(bound, 1))
    return found if len(found) >= least else np.arange(len(shared))


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def _ordered(pivots: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = orders(_matrix(batch.column(1), pivots.shape[1]), pivots, length)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel(), pa.int16())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "order"])

    return run


def _search(layout: Layout, pivots: int, dim: int, k: int):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not held.num_rows or not asked.num_rows:
            return schema.empty_table()
        held, asked = held.combine_chunks(), asked.combine_chunks()
        take = lambda t, c: t.column(c).combine_chunks()
        ids = take(held, "vec_id").to_numpy()
        unit = lambda rows: rows / np.abs(rows).max(axis=1, keepdims=True)
        single = lambda rows: (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
        vectors, queries = _matrix(take(held, "v"), dim), _matrix(take(asked, "v"), dim)
        length = len(take(held, "order")[0])
        files = PivotFiles(take(held, "order").flatten().to_numpy().reshape(-1, length), pivots)
        orders_asked = take(asked, "order").flatten().to_numpy().reshape(-1, length)
        units, queries_unit = single(unit(vectors)), single(unit(queries))
        most, out = layout.shortlist(len(ids)), []
        for i, name in enumerate(take(asked, "vec_id").to_numpy()):
            # The query's own rows are nearest to it, so they come on top of the shortlist.
            own = np.flatnonzero(ids == name)
            near = np.setdiff1d(shortlist(files.shared(orders_asked[i]), most + len(own), k + len(own)), own, assume_unique=True)
            if len(near):
                best, scores = nearest(queries[i], ids[near], vectors[near], units[near] @ queries_unit[i], k)
                out.append((np.full(len(best), name), best, scores))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema) if out else schema.empty_table()

    return run


def index_vectors(embeddings: DataFrame, layout: Layout) -> tuple[DataFrame, int, int]:
    """Every usable vector with its pivot order, written once; number of pivots, dimensions.

    Vectors of a length other than the commonest have no cosine with the rest and take
    no part, like null, zero and non-finite ones. Rows that repeat count once.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    rows = rows.filter(F.size("v") == dim)
    # A bounded number of vectors, from which alone the pivot orders are learned; all rows are indexed.
    n_pivots = layout.pivots(common["count"] if common else 0)
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(n_pivots).collect()
    points = np.array([r["v"] for r in drawn], dtype=float).reshape(-1, dim)
    points /= np.abs(points).max(axis=1, keepdims=True)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    length = min(layout.posted, len(points))
    if not length:
        return rows.withColumn("order", F.array().cast("array<smallint>")), 0, dim
    found = rows.mapInArrow(_ordered(points, length), f"vec_id long, v array<{'float' if single else 'double'}>, order array<smallint>")
    return materialize(found, "permutation-index"), len(points), dim


def nearest_neighbours(embeddings: DataFrame, queries: Column, k: int = NEIGHBOURS, layout: Layout | None = None) -> DataFrame:
    """The k nearest found for every row where ``queries`` holds (a condition on vec_id).

    Columns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the cosine in double
    precision; ties go to the smaller vec_id. Candidates are all rows but those with the
    query's own id; repeated rows with one id count once. An empty table has no result.
    """
    layout = layout or Layout()
    index, pivots, dim = index_vectors(embeddings, layout)
    schema = "query_id long, vec_id long, score double"
    if not pivots:
        empty = embeddings.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    asked = index.filter(queries)
    blocks, groups = (max(1, math.ceil(rows.count() / size)) for rows, size in ((index, BLOCK_VECTORS), (asked, BLOCK_QUERIES)))
    one = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns, keys = ["vec_id", "v", "order"], ["block", "group"]
    held = index.select(*columns, one(blocks).alias("block"), every(groups).alias("group"))
    # Columns of its own, as both sides are one table.
    asked = asked.select(*[F.col(c).alias(c) for c in columns], one(groups).alias("group"), every(blocks).alias("block"))
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(layout, pivots, dim, k), schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
