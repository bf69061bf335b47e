"""Joins with small tables of words, word vectors read once, and cosines of blocks."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulseweave.operators import textjobs as tj


def many_words(spark):
    """A few words, taken from a table whose estimated size is far too large for a broadcast."""
    rows = spark.range(40_000_000).where("id < 5")
    return rows.select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_stop_words_are_broadcast(spark):
    tokens = spark.createDataFrame([(1, "w1"), (1, "w9"), (2, None), (2, "w4"), (2, "w9")], "doc_id long, token string")
    kept = tj.stopword_filter(tokens, many_words(spark))
    assert "SortMergeJoin" not in planned(kept) and "BroadcastHashJoin" in planned(kept)
    assert sorted(kept.select("doc_id", "token").collect(), key=str) == [(1, "w9"), (2, "w9"), (2, None)]


def test_vector_variants(spark):
    tokens = [(d, f"w{i}") for d in (1, 2, None) for i in range(7) if d != 2 or i > 3] + [(3, "unknown")]
    weights = {f"w{i}": float(i % 4) for i in range(6)}
    vectors = {f"w{i}": [1.0 + i, -2.0 * i] for i in range(1, 7)}
    idf = many_words(spark).select(F.col("word").alias("token"), (F.substring("word", 2, 1).cast("int") % 4).cast("double").alias("idf"))
    idf = idf.unionByName(spark.createDataFrame([("w5", 1.0)], "token string, idf double"))
    model = spark.createDataFrame(list(vectors.items()), "token string, vector array<double>")
    found = tj.text_vector_variants(spark.createDataFrame(tokens, "doc_id long, token string"), model, idf, "doc_id")
    assert "SortMergeJoin" not in planned(found)
    want = {}
    for doc in (1, 2, None):
        own = sorted((t for d, t in tokens if d == doc), key=lambda t: (-weights.get(t, 0.0), t))
        known = [(np.array(vectors[t]), weights.get(t, 0.0), i < 3) for i, t in enumerate(own) if t in vectors]
        want[doc] = [sum(v * w for v, w in part) for part in ([(v, 1) for v, _, _ in known], [(v, w) for v, w, _ in known], [(v, w * top) for v, w, top in known])]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows.keys() == want.keys()
    for doc, (plain, weighted, top) in want.items():
        assert np.allclose(rows[doc]["plain"], plain) and np.allclose(rows[doc]["weighted"], weighted) and np.allclose(rows[doc]["top_weighted"], top)


def test_word_lists_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def words(text):
        made.add(1)
        return text.split()

    texts = spark.createDataFrame([("a b c a b",)] * 30, "text string")
    model = tj.train_word_vectors(texts.select(F.udf(words, "array<string>")("text").alias("t")), "t", dim=4, min_count=1, seed=1)
    assert tj.word_model_table(model).count() == 3
    assert made.value == 30


def test_cosines_of_blocks_take_strips_of_memory():
    rng = np.random.default_rng(3)
    block = pd.DataFrame({"id": rng.permutation(3000), "v": list(rng.normal(size=(3000, 4)))})
    tracemalloc.start()
    got = tj._bin_counts(block, block, True, 0.01)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    v = np.stack(block["v"].to_numpy())
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cosines = (v @ v.T)[np.triu_indices(3000, 1)]
    slots, n = np.unique(np.floor(np.round(cosines, 9) / 0.01 + 1e-9).astype(int), return_counts=True)
    assert dict(zip(got["bin"], got["n"])) == dict(zip(slots, n)) and peak < 40 << 20
