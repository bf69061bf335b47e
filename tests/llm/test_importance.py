"""Importance weights and the draw."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulseweave.llm import importance as im
from pulseweave.llm.textbytes import Hasher, portions, split_words

SMALL = "/root/testdata/sf0.01"


def plain_weights(texts, good):
    """Every text alone, counts in dictionaries."""
    grams = []
    for text in texts:
        (_, data, offsets), = portions(pa.array([text], pa.string()))
        buckets, exists = im.gram_buckets(split_words(data, offsets, im._IN_WORD), Hasher())
        grams.append(buckets[exists].tolist())
    raw, target = {}, {}
    for own, is_good in zip(grams, good):
        for g in own:
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + is_good
    n, m, size = sum(raw.values()), sum(target.values()), 1 << im.BUCKET_BITS
    ratio = {g: np.log((target[g] + 1) / (m + size) / ((raw[g] * m / n + 1) / (m + size))) for g in raw}
    return [sum(ratio[g] for g in own) * 64 / len(own) if own else None for own in grams]


def test_weights_against_plain_counts(spark):
    texts = [(i, f"Good prose number {i}, with words and more words here.\nAnd a line.") for i in range(20)]
    texts += [(i, "BAD!! BAD!! BAD!! " * 8) for i in range(20, 26)] + [(30, None), (31, ""), (32, " "), (33, "x"), (33, "x"), (34, "é \t ü"), (35, "z " * 30_000)]
    good = {i for i in range(0, 20, 2)}
    frame = spark.createDataFrame([(i, t, 0, True) for i, t in texts], "doc_id long, text string, n_grams int, target boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(26)] + [(None, 1)], "doc_id long, quality int")
    got = sorted(((r["doc_id"], r["log_weight"]) for r in im.importance_weights(frame, labels).collect()), key=lambda r: r[0])
    want = plain_weights([t for _, t in texts], [i in good for i, _ in texts])
    for (i, w), (j, _), v in zip(got, texts, want):
        assert i == j and (w is None) == (v is None) and (v is None or abs(w - v) < 1e-9)


def test_words_hash_alike_anywhere():
    (_, data, offsets), = portions(pa.array(["alpha beta", "x y alpha beta", None, "alpha"], pa.string()))
    words = split_words(data, offsets, im._IN_WORD)
    assert words.per_row.tolist() == [2, 4, 0, 1]
    buckets, exists = im.gram_buckets(words, Hasher())
    assert buckets[0, 0] == buckets[4, 0] == buckets[6, 0] and buckets[1].tolist() == buckets[5].tolist()
    assert exists[:, 1].tolist() == [False, True, False, True, True, True, False]


def test_junk_is_rejected_and_clean_texts_stay(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = im.quality_selection(docs, labels).join(labels, "doc_id").collect()
    assert all(r["selected"] for r in got if r["quality"] == 1)
    assert not any(r["selected"] for r in got if r["quality"] == 0)


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), np.array([1.0] * 50 + [2.0] * 3), np.array([0.0, 5e-324, 1e-320]), np.array([7.0])):
        frame = spark.createDataFrame([(float(v),) for v in values], "key double").repartition(3)
        for k in {1, 2, len(values) // 2 + 1, len(values)}:
            assert im.kth_largest(frame, k) == np.sort(values)[::-1][min(k, len(values)) - 1]
    assert im.kth_largest(frame.limit(0), 3) is None


def test_draw_of_k_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(50)] + [(99, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = im.quality_selection(docs, none, k=10).collect()
    assert len(rows) == 51 and sum(r["selected"] for r in rows) == 10
    keys = sorted((r["selection_key"] for r in rows if r["selection_key"] is not None), reverse=True)
    assert {r["selection_key"] for r in rows if r["selected"]} == set(keys[:10])
    assert im.quality_selection(docs.limit(0), none).count() == 0
    assert docs.select(F.count("*")).first()[0] == 51


def test_rows_that_share_an_id_draw_for_themselves(spark):
    rows = [(None, f"the words of text number {i} are here") for i in range(50)] + [(7, f"another text {i} of the same id") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = im.quality_selection(frame, labels, k=20).collect()
    # Without labels all weights are zero, so keys are noise alone.
    assert len({r["selection_key"] for r in got}) == 100 and sum(r["selected"] for r in got) == 20


def test_short_texts_are_held_to_the_same_bound(spark):
    good = [(i, "we walk to the old town and talk about the long day " * 3) for i in range(40)]
    poor = [(100 + i, "BUY NOW!!! 100% $$$ CLICK >>> WIN " * 9) for i in range(40)]
    short = [(200, "BUY NOW!!!"), (201, "we walk to the old town")]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "doc_id long, quality int")
    frame = spark.createDataFrame(good + poor + short, "doc_id long, text string")
    drawn = {r["doc_id"] for r in im.quality_selection(frame, labels).collect() if r["selected"]}
    assert 201 in drawn and 200 not in drawn and set(range(40)) <= drawn and not drawn & set(range(100, 140))
