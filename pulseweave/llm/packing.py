"""Packing into length buckets whose bounds minimise padding.

The global histogram of lengths is exact up to 131,072 tokens and has 65,536 bins in
each doubling beyond, so its size is bounded whatever the corpus holds. Dynamic
programming over it finds the bucket bounds; rows get a position in their bucket by
counting, and a bucket's rows are cut into batches of one token budget.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.llm.common import blank_words

BUCKETS = 16
BATCH_TOKENS = 65_536
#: Bins of the histogram in each doubling of the length; lengths up to twice as many have their own.
BINS_PER_OCTAVE = 1 << 16
ROWS_PER_CHUNK = 50_000


def length_bin(n: Column) -> Column:
    """The bin of a length, named by its largest length."""
    octave = F.greatest(F.length(F.bin(n)) - F.lit(BINS_PER_OCTAVE.bit_length()), F.lit(0))
    step = F.pow(F.lit(2), octave).cast("long")
    return (F.ceil(n / step) * step).cast("long")


def _next_layer(before: np.ndarray, n: np.ndarray, total: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of one bucket more for every last bin, and the first bin of that bucket.

    A bucket from i to j costs ``longest[j] * rows - tokens``, for which the best i never
    falls as j grows. Bins in the middle of the open ranges are solved first, so each
    halving of the ranges looks at every bin about once.
    """
    h = len(longest)
    best, came = np.full(h, np.inf), np.zeros(h, np.int64)
    low, high = np.array([0]), np.array([h - 1])
    least, most = np.array([0]), np.array([h - 1])
    while len(low):
        middle = (low + high) // 2
        stop = np.minimum(most, middle)
        size = stop - least + 1
        starts = np.cumsum(size) - size
        i = np.repeat(least - starts, size) + np.arange(size.sum())
        j = np.repeat(middle, size)
        cost = before[i] + longest[j] * (n[j + 1] - n[i]) - (total[j + 1] - total[i])
        lowest = np.minimum.reduceat(cost, starts)
        at = np.flatnonzero(cost == np.repeat(lowest, size))
        first = at[np.searchsorted(at, starts)]
        best[middle], came[middle] = lowest, i[first]
        left, right = low < middle, middle < high
        low, high, least, most = (
            np.concatenate((low[left], middle[right] + 1)), np.concatenate((middle[left] - 1, high[right])),
            np.concatenate((least[left], i[first][right])), np.concatenate((i[first][left], most[right])),
        )
    return best, came


def best_bounds(counts: np.ndarray, sums: np.ndarray, longest: np.ndarray, buckets: int) -> list[int]:
    """Last bin of each bucket so that total padding is least.

    Bins are in order of length. A bucket pads all its rows to the longest of them. Of
    equal plans that with fewer buckets wins, then that with the earlier bounds.
    """
    h = len(counts)
    n = np.concatenate(([0.0], np.cumsum(counts, dtype=float)))
    total = np.concatenate(([0.0], np.cumsum(sums, dtype=float)))
    best = longest * n[1:] - total[1:]
    came: list[np.ndarray] = [np.zeros(h, int)]
    reached = [best[-1]]
    for _ in range(1, min(buckets, h)):
        # The buckets so far end before bin i; none end before the first.
        best, first = _next_layer(np.concatenate(([np.inf], best[:-1])), n, total, longest)
        came.append(first)
        reached.append(best[-1])
    k = int(np.argmin(reached))
    bounds, j = [], h - 1
    while True:
        bounds.append(j)
        if k == 0:
            return bounds[::-1]
        j, k = int(came[k][j]) - 1, k - 1


def pack(documents: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BATCH_TOKENS) -> DataFrame:
    """Bucket and batch of every document.

    Columns: ``doc_id``, ``n_tokens``, ``bucket`` (from 0), ``padded_to`` (length of the
    bucket's longest row, 1 at least), ``batch`` (from 0 in each bucket) and ``padding``.
    A batch holds as many rows as the budget allows at that length, one at least, and
    only a bucket's last batch may hold fewer. ``length`` is the column of token counts;
    without it words between white space count. Null and empty texts have length zero.
    Repeated rows are packed each; an empty table gives an empty result.
    """
    n = F.size(blank_words(F.col("text"))) if length is None else length
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    bins = (
        rows.groupBy(length_bin(F.col("n_tokens")).alias("bin"))
        .agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
        .orderBy("bin")
        .collect()  # bounded: at most 65,536 rows for each doubling of the length
    )
    if not bins:
        return rows.select("doc_id", "n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("bucket", "padded_to", "batch", "padding")])
    counts, sums, longest = (np.array([r[i] for r in bins], dtype=float) for i in (1, 2, 3))
    ends = best_bounds(counts, sums, longest, buckets)
    tops = [int(longest[e]) for e in ends]
    sizes = np.diff(np.concatenate(([0], np.cumsum(counts)[ends])))
    literal = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])
    bucket = F.size(F.filter(literal(tops), lambda top: top < F.col("n_tokens"))).cast("long")
    placed = rows.withColumn("bucket", bucket)
    parts = F.get(literal(math.ceil(s / ROWS_PER_CHUNK) for s in sizes), F.col("bucket").cast("int"))
    # Any row may go to any chunk: rows that share id and length are dealt out like others.
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "n_tokens", "row"), parts))
    filled = placed.groupBy("bucket", "chunk").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.select("bucket", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "chunk").orderBy("doc_id", "n_tokens", "row")
    placed = placed.withColumn("nth", F.row_number().over(inside) - 1).join(filled, ["bucket", "chunk"])
    padded = F.get(literal(max(t, 1) for t in tops), F.col("bucket").cast("int"))
    fit = F.get(literal(max(1, budget // max(t, 1)) for t in tops), F.col("bucket").cast("int"))
    return placed.select(
        "doc_id", "n_tokens", "bucket", padded.alias("padded_to"),
        F.floor((F.col("before") + F.col("nth")) / fit).cast("long").alias("batch"),
        (padded - F.col("n_tokens")).alias("padding"),
    )
