"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pulseweave.llm import simhash
from pulseweave.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text, words=4):
    tokens = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (id, fingerprint); least id reachable over links, per row."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(rows))]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(500)]
    out = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(60)]
    long = rng.choices(vocabulary, k=900)
    for i in range(100, 130):
        copy = list(long)
        copy[rng.randrange(900)] = "changed"
        out.append((i, " ".join(copy).upper() if i % 3 == 0 else "\t ".join(copy)))
    out += [(i, out[5][1]) for i in range(200, 210)]
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (303, "one"), (None, "one"), (304, "one two three"), (305, "x " * 30_000)]
    return out


def test_against_all_pairs(spark):
    rows = texts()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, bits int, tokens int").repartition(3)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()), key=str)
    prints = [(i, plain_print(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=str)
    assert got == want


def test_no_link_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.int64).view(np.uint64)
    bits = list(base)
    for b in base[:80]:
        for _ in range(4):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            bits.append(b ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)))
    bits = np.unique(np.array(bits, np.uint64))
    want = plain_components([(int(b), int(b)) for b in bits])
    for homes in (20_000, 1):  # the second deals every anchor over several tasks
        monkeypatch.setattr(simhash, "HOMES_PER_TASK", homes)
        frame = spark.createDataFrame([(int(x),) for x in bits.view(np.int64)], "bits long")
        roots = {r["u"]: r["v"] for r in connected_components(simhash.print_links(frame)).collect()}
        groups, plain = {}, {}
        for b, c in zip(bits.view(np.int64), want):
            groups.setdefault(roots.get(int(b), int(b)), set()).add(int(b))
            plain.setdefault(c, set()).add(int(b))
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_hamming_tables_cover():
    home, near = simhash.hamming_tables()
    words = np.arange(1 << 15)
    assert (np.bitwise_count(words ^ home) <= 1).all() and len(np.unique(home)) == 1 << 11
    for bit in range(15):  # a neighbour's home is among the visited
        assert (near == home[words ^ (1 << bit)][:, None]).any(axis=1).all()


def test_majority_of_long_runs():
    rng = np.random.default_rng(1)
    lengths = np.array([0, 1, 255, 256, 1000, 0, 2])
    hashes = rng.integers(0, 1 << 63, lengths.sum(), dtype=np.int64).view(np.uint64)
    at = 0
    for got, n in zip(simhash.majority_bits(hashes, lengths), lengths):
        own = hashes[at : at + n]
        at += n
        assert int(got) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > n)


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r["u"]: r["v"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)}


def test_keep_one_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 8), (3, "other words are here", 9), (3, "other words are here", 9), (None, "null id", 1)], "doc_id long, text string, component_id int")
    kept = simhash.keep_one(frame, simhash.near_duplicates(frame))
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3]
    empty = frame.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
