"""The pipeline's stages decide by row where ids are null or repeat."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from pulseweave.llm import importance

SMALL = "/root/testdata/sf0.001"


def hot_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    third = F.pmod("doc_id", F.lit(3))
    return docs.withColumn("doc_id", F.when(third == 0, None).when(third == 1, 1).otherwise(F.col("doc_id")))


def test_quality_keeps_only_the_rows_drawn(spark):
    docs = hot_ids(spark).cache()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    drawn = importance.quality_selection(docs.withColumn("body", F.col("text")), labels, keep=("body",)).filter("selected").select("doc_id", F.col("body").alias("text"))
    got = dict(cp.STAGES)["quality_classifier"](spark, docs, SMALL)
    order = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=str)
    assert order(got) == order(drawn)
    assert 0 < got.filter("doc_id IS NULL").count() < docs.filter("doc_id IS NULL").count()


def test_benchmark_drops_only_the_rows_that_hit(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    rows = [(i, t) for i in (None, 4) for t in ("before " + item + " after", "clean words of one text", "clean words of another", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(cp.STAGES)["benchmark_decontamination"](spark, frame, SMALL).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((i, t) for i, t in rows if not (t or "").startswith("before")), key=str)
