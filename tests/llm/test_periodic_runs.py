"""Periodic runs against plain search, and the query against its contract in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from pulseweave.llm import periodic_runs as pr
from pulseweave.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=6):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            if length >= max(least, 4 * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def samples():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "a", "b", "b"] * 4, ["a"] * 40 + ["b"] + ["a"] * 40]
    out.append((["a"] * 30 + ["b"]) * 9 + ["a"] * 7)
    out.append((["a", "b"] * 20 + ["c"] * 9) * 6)
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    out.append(b)
    thue = [0]
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    out.append(["xy"[x] for x in thue])
    for _ in range(250):
        kinds = "abcdefgh"[: rng.randint(1, 8)]
        text = rng.choices(kinds, k=rng.randint(0, 30))
        for _ in range(rng.randint(1, 4)):
            unit = rng.choices(kinds, k=rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 33]))
            times = rng.uniform(1, 7)
            text += (unit * 8)[: int(len(unit) * times)]
            if rng.random() < 0.3:
                text = (text * 5)[: int(len(text) * rng.uniform(1, 5))]
            text += rng.choices(kinds, k=rng.randint(0, 6))
        out.append(text[:1500])
    return out


def test_runs_against_plain_search():
    texts = samples()
    hashes = np.array([zlib.crc32(w.encode()) for t in texts for w in t], np.uint64)
    sizes = np.array([len(t) for t in texts])
    found = {}
    first = np.cumsum(sizes) - sizes
    for s, e, q in zip(*pr.text_runs(hashes, sizes)):
        row = int(np.searchsorted(np.cumsum(sizes), s, "right"))
        if e - s >= 6:
            found.setdefault(row, []).append((int(s - first[row]), int(e - s), int(q)))
    for i, t in enumerate(texts):
        assert found.get(i, []) == plain_runs(t), t


def test_synchronising_set_is_consistent_and_sparse():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    ids[9000:9500] = ids[100:600]
    for scale in (2, 8, 32):
        level = ids
        for width in (1 << b for b in range(scale.bit_length() - 1)):
            level = pr.mixed(level[:-width] * pr._ODD + level[width:])
        picks = pr.synchronising_set(level, np.zeros(len(level), bool), scale)
        near = lambda a, b: set((picks[(picks >= a) & (picks < b - 2 * scale)] - a).tolist())
        assert near(9000, 9500) == near(100, 600)
        assert np.diff(picks).max() <= scale and len(picks) < 6 * len(ids) / scale


def test_documents(spark):
    text = "one two " * 5 + "end " * 7 + "é ü\t\n é ü é ü\x0b é ü x"
    rows = [(1, text, "d"), (1, text, "d"), (2, None, "d"), (3, "", None), (None, "a " * 9, "d"), (4, " \n\t ", "d"), (5, "w " * 70_000 + "x y z " * 40_000, "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("n_words", F.lit("x"))
    got = pr.periodic_runs(frame.repartition(3)).collect()
    want = []
    for doc, t, _ in rows[:-1]:
        words = WORD.findall(t or "")
        runs = plain_runs(words)
        want.append((doc, len(words), runs, plain_collapse(words, runs)))
    want.append((5, 190_000, [(0, 70_000, 1), (70_000, 120_000, 3)], "w x y z"))
    order = lambda rows: sorted(rows, key=str)
    assert order((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == order(want)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pr.periodic_runs(empty).count() == 0


def plain_rows(docs):
    for doc, text in docs:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = plain_runs(words)
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        yield doc, len(runs), s, length, q, runs and 1000 * length // q or None, digest(listed), digest(plain_collapse(words, runs))


def test_query_against_plain_python(spark, tmp_path):
    odd = [(10_000 + i, t) for i, t in enumerate([None, "", " ", "x", "a b " * 30, "b"] * 30)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.substring_index("text", " ", 900).alias("text"))
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = {r[0]: r for r in plain_rows([(r["doc_id"], r["text"]) for r in docs.collect()])}
    rows = got.collect()
    assert len(rows) == len(want) and any(r["n_runs"] > 1 for r in rows)
    for r in rows:
        assert tuple(r) == want[r["doc_id"]]
