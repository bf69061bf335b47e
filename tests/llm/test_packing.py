"""Bucket bounds against all plans, and batches."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from pulseweave.llm import packing


def test_bounds_are_best():
    rng = np.random.default_rng(0)
    for _ in range(30):
        h = int(rng.integers(1, 9))
        longest = np.sort(rng.choice(200, h, replace=False) + 1).astype(float)
        counts = rng.integers(1, 20, h).astype(float)
        sums = counts * (longest - rng.random(h))
        cost = lambda ends: sum(
            (longest[e] * counts[s : e + 1] - sums[s : e + 1]).sum() for s, e in zip([0, *[x + 1 for x in ends[:-1]]], ends)
        )
        plans = [(*c, h - 1) for n in range(min(3, h)) for c in itertools.combinations(range(h - 1), n)]
        assert np.isclose(cost(packing.best_bounds(counts, sums, longest, 3)), min(map(cost, plans)))


def test_batches_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CHUNK", 7)
    texts = [(i, "w " * (i % 40)) for i in range(200)] + [(300, None), (301, "x " * 30_000), (5, "w " * 5), (None, "a b")]
    frame = spark.createDataFrame([(i, t, 1, 1) for i, t in texts], "doc_id long, text string, bucket int, chunk int").repartition(3)
    rows = packing.pack(frame, buckets=4, budget=100).collect()
    want = sorted(((i, len((t or "").split())) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in rows), key=str) == want
    batches, top = {}, {}
    for r in rows:
        assert r["padded_to"] >= max(1, r["n_tokens"]) and r["padding"] == r["padded_to"] - r["n_tokens"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        top[r["bucket"]] = max(top.get(r["bucket"], 1), r["n_tokens"])
    assert len(top) <= 4
    for (bucket, batch), own in batches.items():
        fit = max(1, 100 // own[0]["padded_to"])
        last = max(b for k, b in batches if k == bucket)
        assert own[0]["padded_to"] == top[bucket] and len(own) <= fit and (len(own) == fit or batch == last)


def test_bins_are_bounded(spark):
    bins = spark.range(0, 1 << 20).select(packing.length_bin(F.col("id")).alias("b"), "id")
    assert bins.filter("b < id").count() == 0 and bins.filter("id <= 131072 AND b <> id").count() == 0
    wide = spark.range(0, 1 << 20).select(packing.length_bin((1 << 40) + F.col("id") * (1 << 20)).alias("b"))
    assert wide.distinct().count() <= (1 << 16) + 1


def plain_padding(lengths, buckets):
    """Least padding over all cuts of the sorted lengths, by the plain recurrence."""
    lengths = sorted(lengths)
    n = len(lengths)
    total = [0, *itertools.accumulate(lengths)]
    best = [0] + [float("inf")] * n
    for _ in range(buckets):
        best = [0] + [min(best[i] + lengths[j - 1] * (j - i) - (total[j] - total[i]) for i in range(j)) for j in range(1, n + 1)]
    return best[n]


def test_padding_is_least_over_exact_lengths(spark):
    rng = np.random.default_rng(4)
    for buckets in (1, 3, 6):
        lengths = [int(x) for x in rng.lognormal(6, 1.5, 180)]
        frame = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n long").withColumn("text", F.lit(""))
        rows = packing.pack(frame, F.col("n"), buckets=buckets)
        assert rows.agg(F.sum("padding")).first()[0] == plain_padding(lengths, buckets)


def test_rows_without_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_CHUNK", 50)
    frame = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    rows = packing.pack(frame, budget=20).groupBy("bucket", "batch").count().collect()
    assert len(rows) == 100 and all(r["count"] == 10 for r in rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
