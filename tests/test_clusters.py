import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseweave.functions.gamma import gamma_cdf
from pulseweave.operators import clustering as cl
from pulseweave.operators import hashtags as ht
from pulseweave.operators import links as lk
from pulseweave.operators import vectorjobs as vj
from tests import oracles

SCHEMA = "g string, vec_id long, vector array<double>"


def groups(spark, seed=3, n=60, dim=5, hot=180):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for g, size in (("a", n), ("b", n // 2), (None, hot)):
        for i in range(size):
            v = centres[rng.integers(4)] + rng.normal(scale=0.35, size=dim)
            rows.append((g, len(rows), [float(x) for x in v]))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_join_and_no_join(spark):
    rows = [("x", 1, [1.0, 1.0, 1.0]), ("x", 2, [1.0, 1.0, 1.0]), ("x", 3, [5.0, 0.0, 2.0]), ("x", 4, []), ("x", 5, [0.0, 0.0, 0.0])]
    out = cl.leader_clusters(spark.createDataFrame(rows, SCHEMA), ["g"], "vec_id", "vec_id", "vector", 0.9)
    assert {r.vec_id: r.leader for r in out.collect()} == {1: 1, 2: 1, 3: 3}


def test_leader_matches_plain_python(spark):
    rows, df = groups(spark)
    got = cl.leader_clusters(df, ["g"], "vec_id", "vec_id", "vector", 0.8).collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for r, (owner, sim) in zip(mine, oracles.leader([r[2] for r in mine], 0.8)):
            want[r[1]] = (mine[owner][1], None if sim is None else round(sim, 9))
    assert {r.vec_id: (r.leader, None if r.similarity is None else round(r.similarity, 9)) for r in got} == want


def test_rounds_blocks_and_partitions_do_not_matter(spark, monkeypatch):
    rows, df = groups(spark)
    cut = lambda out: sorted(((r.g, r.vec_id, r.leader, r.similarity) for r in out.collect()), key=str)
    want = cut(cl.leader_clusters(df, ["g"], "vec_id", "vec_id", "vector", 0.8))
    assert len(want) == len(rows)
    monkeypatch.setattr(cl, "BLOCK_ROWS", 16)
    for parts, size in ((1, 7), (9, 1), (3, 64)):
        out = cl.leader_clusters(df.repartition(parts), ["g"], "vec_id", "vec_id", "vector", 0.8, round_rows=size)
        assert cut(out) == want


def test_groups_may_share_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, [float(x) for x in rng.normal(size=3)]) for g in ("p", "q", None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.g, r.vec_id): r.leader for r in cl.leader_clusters(df, ["g"], "vec_id", "vec_id", "vector", 0.5, round_rows=8).collect()}
    assert len(got) == 150
    for g in ("p", "q", None):
        mine = [r for r in rows if r[0] == g]
        assert [got[g, i] for i in range(50)] == [o for o, _ in oracles.leader([r[2] for r in mine], 0.5)]
    out = cl.leader_clusters(df, ["g"], "vec_id", "vec_id", "vector", 0.5)
    sizes = cl.published_clusters(out, df, ["g"], "vec_id", "vector").collect()
    assert all(r["size"] == sum(1 for k, v in got.items() if k[0] == r.g and v == r.leader) for r in sizes)


def test_wide_centroids(spark):
    df = spark.range(40).select((F.col("id") % 2).alias("g"), F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda i: (i + F.col("id")).cast("double")).alias("vector"))
    rows = {r.g: r for r in vj.centroids(df, ["g"], "vector").collect()}
    assert rows[0]["size"] == 20 and rows[0]["centroid"][0] == 20.0 and len(rows[1]["centroid"]) == 4096


@pytest.mark.parametrize("block", [8, 4096])
def test_similarity_pairs_exact(spark, block):
    rows, df = groups(spark)
    df = df.where("g is not null")
    got = vj.similarity_pairs(df, "g", "vec_id", "vector", 0.6, block_rows=block)
    want = set()
    for a in rows:
        for b in rows:
            if a[0] and a[0] == b[0] and a[1] < b[1]:
                x, y = np.array(a[2]), np.array(b[2])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) > 0.6:
                    want.add((a[0], a[1], b[1]))
    pairs = [(r.g, r.id_a, r.id_b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_block_pairs_take_strips_of_memory():
    rng = np.random.default_rng(4)
    block = lambda first: pd.DataFrame({"id": np.arange(first, first + 4000), "v": list(rng.normal(size=(4000, 8)))})
    left, right = block(0), block(4000)
    tracemalloc.start()
    lo, hi, cos = vj._block_matches(left, right, False, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    x, y = (np.stack(b["v"].to_numpy()) for b in (left, right))
    full = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    assert len(lo) == (full > 0.9).sum() and (lo < 4000).all() and (hi >= 4000).all() and np.allclose(full[lo, hi - 4000], cos)
    assert peak < 60 << 20


@pytest.mark.parametrize(
    "a, x",
    [(1e-5, 0.3), (1e-5, 1.0), (5.00001, 3.0), (40.0, 55.0), (900.0, 880.0), (1999.0, 2010.0),
     (2500.0, 2500.0), (2500.0, 2450.0), (50000.0, 50300.0), (1e6, 1e6 + 800), (1e6, 1e6 - 1500),
     (10.0, 1e7), (1e7, 10.0)],
)
def test_gamma_cdf(spark, a, x):
    got = spark.range(1).select(gamma_cdf(F.lit(1.0), F.lit(a), F.lit(x))).first()[0]
    want = 1.0 if x > 50 * a + 1000 else 0.0 if a > 50 * x + 1000 else oracles.gamma_cdf(a, x)
    assert math.isclose(got, want, abs_tol=2e-7)


def members_of(spark, clusters, end=1):
    rows = [(c, "hashtag", end, p) for c, posts in clusters.items() for p in posts]
    return spark.createDataFrame(rows, "cluster_id string, data_type string, end_time_ms long, post_id long")


def test_links_known_case(spark):
    m = members_of(spark, {"1": [10, 20, 30, 40], "2": [30, 40, 50, 60]}).unionByName(
        members_of(spark, {"3": [60, 70, 80, 90]}, end=3)
    )
    out = lk.cluster_links(m, 0.4).collect()
    assert [(r.source, r.target, r.weight, r.n_common) for r in out] == [("2", "1", 0.5, 2)]
    common = lk.link_common_posts(lk.cluster_links(m, 0.4), m).collect()
    assert sorted(r.post_id for r in common) == [30, 40]


@pytest.mark.parametrize("seed, overlap", [(1, 0.2), (2, 0.5), (3, 0.6), (4, 0.0)])
def test_links_match_brute_force_with_hot_posts(spark, seed, overlap):
    rng = np.random.default_rng(seed)
    clusters = {}
    for i in range(40):
        posts = list(rng.integers(0, 60, size=rng.integers(1, 12)))
        if rng.random() < 0.6:
            posts.append(999)  # one post in more than half of the clusters
        if rng.random() < 0.2:
            posts.append(posts[0])  # counted twice
        clusters[f"c{i:02d}"] = [int(p) for p in posts]
    clusters["only-hot"], clusters["only-hot-2"] = [999], [999]
    got = {(r.source, r.target): round(r.weight, 9) for r in lk.cluster_links(members_of(spark, clusters), overlap).collect()}
    assert got == oracles.overlap_links(clusters, overlap)


def test_repeated_tag_counts_twice(spark):
    posts = spark.createDataFrame(
        [(0, 99, 1, ["X", "x"]), (0, 99, 2, ["x"]), (0, 99, 3, None)],
        "start_time_ms long, end_time_ms long, post_id long, hashtags array<string>",
    )
    row = ht.hashtag_groups(posts).first()
    assert (row.term, row.size, row.total_posts) == ("x", 3, 2)


def test_prior_looks_back_seven_days_only(spark):
    day = 86_400_000
    rows = [(d * day, d * day + day - 1, "t", 10 + d, 100) for d in range(12)]
    df = spark.createDataFrame(rows, "start_time_ms long, end_time_ms long, term string, size long, total_posts long")
    out = {r.size - 10: r for r in ht.hashtag_priors(df, day).collect()}
    assert out[0].prior_alpha == pytest.approx(1e-5) and out[0].prior_beta == 1
    for d in range(12):
        past = [10 + e for e in range(d) if d * day - 7 * day <= e * day + day - 1 <= d * day]
        assert out[d].prior_alpha == pytest.approx(1e-5 + sum(past))
        assert out[d].prior_beta == 1 + 100 * len(past)


def test_image_vectors(spark, tmp_path):
    from pulseweave.sources.feeds import binary_image_source

    (tmp_path / "a.jpg").write_bytes(bytes([0, 0, 255, 255]))
    (tmp_path / "b.jpg").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"no")

    def model(content):
        if content == b"broken":
            raise ValueError("not a picture")
        return vj.byte_histogram(content, 4)

    images = binary_image_source(spark, str(tmp_path))
    out = {r.path[-5:]: r.vector for r in vj.image_vectors(images, model).collect()}
    assert out == {"a.jpg": [0.5, 0, 0, 0.5], "b.jpg": [-1.0]}


def test_leaders_out_of_reach_change_nothing():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 6))
    rows = np.concatenate([c + rng.normal(scale=0.03, size=(60, 6)) for c in centres])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    leaders = rows[rng.permutation(len(rows))[:200]]
    for threshold in (0.2, 0.9, 0.99):
        best, sim = cl.best_leaders(rows, leaders, threshold)
        all_sims = cl._cosines(rows, leaders)
        want = np.where(all_sims.max(axis=1) > threshold, all_sims.argmax(axis=1), -1)
        assert (best == want).all() and (sim[best >= 0] == all_sims.max(axis=1)[best >= 0]).all()
