"""Recall and exactness of the permutation index."""

import numpy as np
from pyspark.sql import functions as F

from pulseweave.llm import permutation_index as pi

SMALL = "/root/testdata/sf0.1/embeddings.parquet"
EVERY = "vec_id % 50 = 0"


def brute(ids, vectors, queries, k=5):
    out = []
    for q in queries:
        i = ids.index(q)
        scores = [(-float(pi.exact_cosines(vectors[i], v[None])[0]), n) for n, v in zip(ids, vectors) if n != q]
        out += [(q, rank, n, -s) for rank, (s, n) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_recall(spark, monkeypatch):
    """Footrule picks about a tenth of the vectors of each of two blocks."""
    monkeypatch.setattr(pi, "BLOCK_VECTORS", 1200)
    frame = spark.read.parquet(SMALL)
    layout = pi.Layout()
    assert layout.shortlist(1000) <= 0.12 * 1000
    got = pi.nearest_neighbours(frame, F.expr(EVERY), layout=layout).collect()
    rows = frame.orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    want = brute(ids, vectors, [i for i in ids if i % 50 == 0])
    hits = len({(q, n) for q, _, n, _ in want} & {(r["query_id"], r["vec_id"]) for r in got})
    assert hits / len(want) > 0.9
    exact = {(q, n): s for q, _, n, s in want}
    assert all(abs(exact[k] - r["score"]) < 1e-12 for r in got if (k := (r["query_id"], r["vec_id"])) in exact)
    assert all(sorted(r["rank"] for r in got if r["query_id"] == q) == [1, 2, 3, 4, 5] for q in {r["query_id"] for r in got})


def test_small_and_odd_vectors_are_exact(spark, monkeypatch):
    monkeypatch.setattr(pi, "BLOCK_VECTORS", 3)
    monkeypatch.setattr(pi, "BLOCK_QUERIES", 1)
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).tolist()) for i in range(12)] + [(i, [1.0, 1.0, 0.0, 0.0]) for i in (50, 20, 21, 22, 23, 24, 25)]
    good += [(26, [2.0, 2.0, 0.0, 0.0]), (27, [1e300, 1e300, 0.0, 0.0][:4])]
    odd = [(100, None), (150, [0.0] * 4), (200, [1.0, None, 0.0, 0.0]), (250, [float("nan")] * 4), (300, [float("inf"), 0.0, 0.0, 0.0]), (350, []), (400, [1.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in good[:-1] + odd], "vec_id long, embedding array<double>, pivot int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in pi.nearest_neighbours(frame, F.expr(EVERY)).collect())
    ids, vectors = [i for i, _ in good[:-1]], np.array([v for _, v in good[:-1]])
    assert got == sorted((q, r, n, round(s, 12)) for q, r, n, s in brute(ids, vectors, [0, 50]))


def test_few_and_no_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in pi.nearest_neighbours(frame, F.expr(EVERY)).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert pi.nearest_neighbours(frame.limit(0), F.expr(EVERY)).count() == 0


def test_footrule():
    order, others = np.array([3, 1, 2]), np.array([[3, 1, 2], [1, 3, 2], [4, 5, 6], [2, 4, 3]])
    place = lambda o, p: list(o).index(p) if p in o else 3
    want = [sum(abs(place(order, p) - place(o, p)) for p in set(order) | set(o)) for o in others]
    assert pi.PivotFiles(others, 8).footrule(order).tolist() == want


def test_shortlist_is_bounded_and_keeps_ties():
    shared = np.array([5, 0, 3, 3, 9, 0, 1, 3.0])
    assert pi.shortlist(shared, 3, 2).tolist() == [0, 2, 3, 4, 7]
    assert pi.shortlist(shared, 7, 2).tolist() == [0, 2, 3, 4, 6, 7]
    assert len(pi.shortlist(np.zeros(9), 3, 2)) == 9 and len(pi.shortlist(shared, 20, 2)) == 8
    assert pi.Layout().shortlist(51_282) < 0.1 * 51_282 and pi.Layout().pivots(51_282) == 452


def test_rows_that_repeat_fill_no_places(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    of = lambda r: sorted(map(tuple, pi.nearest_neighbours(spark.createDataFrame(r, "vec_id long, embedding array<double>"), F.expr(EVERY)).collect()))
    once = of(rows)
    assert len(once) == 10 and of(rows * 6) == once
    # Six rows of an id that differ by their length only have the same cosine.
    scaled = of([(i, [x * 2**n for x in v]) for n in range(6) for i, v in rows])
    assert [r[:3] for r in scaled] == [r[:3] for r in once]
