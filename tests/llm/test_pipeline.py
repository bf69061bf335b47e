"""The pipeline's stages, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from pulseweave.llm import importance
from tests.llm.test_decontaminate import plain
from tests.llm.test_near_texts import first_of_each

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    stages = dict(cp.STAGES)
    good = stages["quality_classifier"](spark, docs, SMALL).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert all(labels.get(r["doc_id"], 1) == int(r["doc_id"] in kept) for r in docs.collect() if r["doc_id"] in labels)
    known = stages["language_id"](spark, good, SMALL).cache()
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} <= kept
    assert known.count() >= 0.97 * len(kept)
    single = stages["simhash_near_dedup"](spark, known, SMALL).cache()
    assert single.columns == docs.columns
    assert sorted(r["doc_id"] for r in single.collect()) == first_of_each([(r["doc_id"], r["text"]) for r in known.collect()])
    clean = stages["benchmark_decontamination"](spark, single, SMALL).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = [r[0] for r in plain([(r["doc_id"], r["text"]) for r in single.collect()], items) if not r[-1]]
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(want)
    packed = stages["length_packing"](spark, clean, SMALL).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(want)
    assert sorted(r["doc_id"] for r in cp.run(spark, SMALL).collect()) == sorted(want)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "The words of this text are here", "en", "s", 31), (3, "The words of this text are here", "en", "s", 31), (None, "The words of that text are there", "en", None, 3)]
    clashing = spark.createDataFrame(rows, schema)
    for extra in ("score", "lang_pred", "row", "bits", "words", "selected", "_id", "_first", "quality", "bucket"):
        clashing = clashing.withColumn(extra, F.lit("x"))
    for frame in (clashing, spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            got = stage(spark, frame, SMALL)
            assert name == "length_packing" or got.columns == frame.columns
            got.collect()


def test_every_stage_is_one_of_the_operators():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "language_id", "simhash_near_dedup", "benchmark_decontamination", "length_packing"]
    assert importance.PLAUSIBLE < 0
