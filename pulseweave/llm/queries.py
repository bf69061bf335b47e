"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.llm import (
    chat,
    decontaminate,
    importance,
    language_crf,
    licenses,
    line_dedup,
    packing,
    periodic_runs,
    permutation_index,
    prefix_trie,
    simhash,
    token_counts,
    warc,
)
from pulseweave.llm.common import blank_words, table
from pulseweave.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(turns.unionByName(extra))
    read = chat.read_windows(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select(
        "conv_id", "window", F.size("turns").cast("long").alias("n"), said.alias("said"),
        F.array_join("loss", "").alias("loss"), F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("parts"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.char_length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_crf.held_out())
    return language_crf.identify_languages(docs, keep=("doc_id", "held_out"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; the cache of this run starts empty."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known license texts that a document, or one of its lines, is."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


@query
def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all others."""
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket and batch of every document by its words."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether it is drawn."""
    return importance.quality_selection(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.page_records(table(spark, sf_dir, "pages")).drop("target_uri")


def _repeating(documents: DataFrame) -> DataFrame:
    """The texts of op11: in a tenth of the documents the words repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = documents.select(
        "doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, blank_words(F.col("text"))).alias("words")
    )
    n = F.size("words").cast("long")
    cut = chosen.withColumn("a", F.when(n > 0, F.col("g") % n))
    cut = cut.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    source = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
    made = F.array_join(F.transform("words", lambda w, i: F.get("words", source(i).cast("int"))), " ")
    return cut.select("doc_id", F.when(a.isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, and its text without the repeats."""
    found = periodic_runs.periodic_runs(_repeating(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    best = found.withColumn("best", ranked)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.short")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and its text without those of earlier documents."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _rebuilt(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The turns of op13: a conversation starts with up to three turns of the one its twenty share."""
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4))
    own = rows.withColumn("h", taken)
    base = rows.filter("conv_id % 20 = 0 AND pos <= 3").select(F.col("conv_id").alias("base"), "pos", "x1", "x2", "words")
    borrowers = ids.select("conv_id", taken.alias("h"), F.expr("conv_id - conv_id % 20").alias("base"))
    heads = borrowers.join(base, "base").filter("pos <= h").select("conv_id", "pos", "x1", "x2", "words")
    n_heads = borrowers.join(base.groupBy("base").agg(F.max("pos").alias("most")), "base", "left")
    shift = n_heads.select("conv_id", (F.least("h", F.coalesce("most", F.lit(0))) - F.col("h")).alias("shift"))
    rest = own.filter("pos > h").join(shift, "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "x1", "x2", "words")
    return heads.unionByName(rest)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    rows = materialize(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), "turn-rows")
    ids = rows.select("conv_id").distinct()
    found = prefix_trie.trie_nodes(_rebuilt(rows, ids), ids)
    return found.withColumn("ends_sha256", F.sha2(F.array_join("ends", ","), 256)).drop("ends")
