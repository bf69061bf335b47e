"""A cleaning pipeline over ``documents``: quality, language, near-duplicates, benchmark, packing.

Each stage takes what the one before has kept, written as Parquet and read again.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.llm import decontaminate, importance, language_crf, near_texts, packing
from pulseweave.llm.common import table
from pulseweave.session import tune

#: Least expected share of words in the predicted language.
LEAST_LANGUAGE_SCORE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the importance resampling draws, each by its own text."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    chosen = importance.quality_selection(rows, table(tune(spark), sf_dir, "labels"), keep=("row",))
    return chosen.filter("selected").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, by at least a part of their words."""
    tune(spark)
    # The row travels as one column, so that its own names cannot clash with the result's.
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("row"))
    found = language_crf.identify_languages(rows, keep=("row",))
    kept = found.filter((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingle sets of Jaccard similarity 0.8 or more."""
    tune(spark)
    return near_texts.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    found = decontaminate.contamination(docs, table(tune(spark), sf_dir, "benchmark"))
    return decontaminate.remove_documents(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document that is left."""
    tune(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("length_packing", pack),
]

#: Trained models decide here, which SQL cannot express; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
