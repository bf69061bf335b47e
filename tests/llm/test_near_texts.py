"""Near copies against brute-force Jaccard similarity over all pairs."""

import random
import time

import numpy as np

import corpus_pipeline as cp
from pulseweave.llm import near_texts


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.choice((6, 40, 120, 300)))
        out.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    return [" ".join(t) for t in out]


def first_of_each(rows):
    """Least id of each group that chains over pairs of Jaccard 0.8 or more, by all pairs."""
    rows = sorted(rows)
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted(rows[x][0] for x in set(label))


def test_stage_against_brute_force(spark):
    rows = list(enumerate(texts()))
    want = first_of_each(rows)
    assert len(want) < len(rows) - 50
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in dict(cp.STAGES)["simhash_near_dedup"](spark, frame, "").collect())
    assert got == want


def test_similar_sets_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(40):
        base = [set(rng.choice(400, rng.integers(1, 60), replace=False).tolist()) for _ in range(6)]
        sets = []
        for b in base * 8:
            own = {x for x in b if rng.random() > rng.choice([0, 0.05, 0.15])} or b
            sets.append(own | set(rng.choice(400, rng.integers(0, 1 + len(own) // 8), replace=False).tolist()))
        got = near_texts.similar_sets(np.array([x for s in sets for x in sorted(s)]), np.array([len(s) for s in sets]))
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        assert got.tolist() == label


def test_many_half_alike_texts():
    """Ten thousand texts of one template with words of their own: no pair is compared needlessly."""
    n, common, own = 10_000, 100, 100
    codes = np.concatenate([np.tile(np.arange(common), (n, 1)), common + np.arange(n * own).reshape(n, own)], axis=1)
    start = time.perf_counter()
    label = near_texts.similar_sets(codes.ravel(), np.full(n, common + own))
    assert (label == np.arange(n)).all() and time.perf_counter() - start < 20


def test_rows_and_not_ids_decide(spark):
    rng = random.Random(2)
    other = [" ".join(rng.choices([f"v{i}" for i in range(900)], k=30)) for _ in range(40)]
    rows = [(None, t) for t in other[:20]] + [(7, t) for t in other[20:]] + [(3, other[0].upper()), (None, other[1]), (9, None), (8, " "), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(dict(cp.STAGES)["simhash_near_dedup"](spark, frame, "").collect(), key=str)
    want = [(None, t) for t in other[1:20]] + [(7, t) for t in other[20:]] + [(3, other[0].upper()), (8, " ")]
    assert [tuple(r) for r in got] == [tuple(r) for r in sorted(spark.createDataFrame(want, frame.schema).collect(), key=str)]
    assert near_texts.keep_one(frame.limit(0)).count() == 0


def test_crowds_give_the_same_ties(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.int64).view(np.uint64)
    a = np.concatenate([base[:, 0] ^ np.uint64(1 << i) for i in range(20)])
    b = np.tile(base[:, 1], 20)
    found = []
    for crowd in (10_000, 3):
        monkeypatch.setattr(near_texts, "CROWD", crowd)
        found.append(near_texts.close_ties(np.arange(800) % 2, a, b))
    assert all((x == y).all() for x, y in zip(*found)) and len(found[0][0]) == 760


def test_fingerprints_meet_at_anchors():
    """Every fingerprint is within a bit of its anchor, and pairs meet there as often as the formula says."""
    rng = np.random.default_rng(12)
    width, bands = near_texts.layout(1000)
    one = rng.integers(0, 1 << width, 400_000).astype(np.uint64)
    anchor = near_texts.anchors(one, width)
    off = np.bitwise_count(one ^ anchor)
    assert off.max() == 1 and abs((off == 0).mean() - 1 / 16) < 0.002
    assert len(np.unique(near_texts.anchors(np.arange(1 << width, dtype=np.uint64), width))) == 1 << near_texts.LEAST_NAME
    differ = 0.15
    flips = sum((rng.random(len(one)) < differ).astype(np.uint64) << np.uint64(i) for i in range(width))
    met = (near_texts.anchors(one ^ flips, width) == anchor).mean()
    assert abs(met - near_texts.meeting(differ, width)) < 0.003
    assert 1 - (1 - met) ** bands > 0.985
