"""Benchmark windows against a plain scan."""

import random
import re

import pytest

from pulseweave.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["été", "ß9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=14))) for i in range(6)]
    items += [(10, "solo"), (11, "two words"), (12, None), (13, "..."), (2, items[0][1]), (14, items[1][1])]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(30)]
    docs += [(100 + i, f"Start, {t.upper() if i % 2 else t}! end {t}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "!!!"), (203, "Solo two\nWORDS solo"), (203, "none here"), (203, "none here"), (None, items[2][1]), (204, "w0 " * 20_000 + items[3][1])]
    return docs, items


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_plain_scan(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = fixture()
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, words int, row int").repartition(3)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items] + [(None, "w0 w1", 0)], "item_id long, text string, len int")
    found = decontaminate.contamination(frame, bench)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in found.collect()]
    assert sorted(got, key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination(docs, none).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep this. Alpha, beta GAMMA! And that", 5), (2, "clean", 6), (3, None, 7)], "doc_id long, text string, start int")
    bench = spark.createDataFrame([("x", "alpha beta gamma")], "item_id string, text string")
    found = decontaminate.contamination(docs, bench)
    cut = decontaminate.remove_spans(docs, found)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Keep this. ! And that", 2: "clean", 3: None}
    assert sorted(r["doc_id"] for r in decontaminate.remove_documents(docs, found).collect()) == [2, 3]
