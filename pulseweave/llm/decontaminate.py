"""Benchmark decontamination by a broadcast hash set of test n-grams.

Windows of the benchmark are hashed; windows of the documents probe that set, and
a hit counts only after its words were compared. Everything runs as Spark
expressions: the windows of a document are exploded inside the scan's stage, so
only hits and one marker row per document ever reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.llm.common import lower_ascii

WINDOW_WORDS = 10
#: Everything that is not part of a word after lower-casing A to Z.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows and bytes up to which the set of windows is broadcast; beyond, the windows' text is joined.
BROADCAST_ROWS = 5_000_000
BROADCAST_BYTES = 256 << 20


def item_words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def benchmark_windows(benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """Distinct windows: ``len``, ``gram`` (its words), ``hash`` and the ``items`` that hold it.

    An item of fewer words than a window is one window of its own length; an item
    without words has none. Ids are kept as strings; rows with a null id are left out.
    """
    own = benchmark.filter(F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("words")
    )
    own = own.filter(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(words)))
    starts = own.withColumn("start", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)))
    grams = starts.select("item_id", "len", F.slice("words", F.col("start"), F.col("len")).alias("gram"))
    return (
        grams.groupBy("len", "gram")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .withColumn("hash", F.xxhash64("gram"))
    )


def _document_windows(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """A row per window (``start`` from 1), and one with start 0 that stands for the document."""
    size = F.size("words")
    mark, none = F.array(F.lit(None).cast("bigint")), F.array().cast("array<bigint>")

    def of(length: int) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(1), size - (length - 1)),
            lambda i: F.xxhash64(F.slice(F.col("words"), i, F.lit(length))),
        )
        return F.concat(mark, F.when(size >= length, hashed).otherwise(none))

    sets = [F.struct(F.lit(n).alias("len"), of(n).alias("hashes")) for n in lengths]
    sets = sets or [F.struct(F.lit(0).alias("len"), mark.alias("hashes"))]
    per_length = docs.select("row", "doc_id", "text_key", "words", F.inline(F.array(*sets)))
    each = per_length.select("row", "doc_id", "text_key", "words", "len", F.posexplode("hashes").alias("start", "hash"))
    # One length has the document's row; the leading places of the others are empty.
    return each.filter((F.col("start") > 0) | (F.col("len") == (lengths or [0])[0]))


def _covered(hits: Column) -> Column:
    """Number of words under the windows of ``hits``, an array of (start, len) by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, h: F.struct(
        F.greatest(s["end"], h["start"] + h["len"] - 1).alias("end"),
        (s["n"] + F.greatest(F.lit(0), h["start"] + h["len"] - 1 - F.greatest(s["end"], h["start"] - 1))).alias("n"),
    )
    return F.aggregate(hits, zero, step, lambda s: s["n"].cast("long"))


def contamination(documents: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """Benchmark windows found in each document.

    One row per row of ``documents``: ``doc_id``, ``n_words``, ``n_hit`` (words inside
    an occurrence of a window), ``n_items``, ``items`` (sorted ids as strings),
    ``spans`` (merged runs of hit words: first and last word, from 1),
    ``contaminated``, and ``text_key``, a hash of the text. Null and empty texts have no words. Rows that share an id keep
    a row each, other columns are left out, and an empty benchmark hits nothing.

    The set of windows grows with the benchmark, not with the documents. It is
    written first, so its rows and bytes are known; above the limits the windows'
    text takes part in a shuffled join in place of the broadcast.
    """
    grams = materialize(benchmark_windows(benchmark, words), "benchmark-windows")
    facts = grams.agg(
        F.collect_set("len"), F.count("*"), F.sum(F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", " ")))
    ).first()
    lengths, n_grams, n_bytes = sorted(facts[0]), facts[1], facts[2] or 0
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_key"),
        item_words(F.col("text")).alias("words"),
    )
    probes = _document_windows(docs, lengths)
    known = grams.select(F.col("hash").alias("known"), "gram", "items")
    if n_grams <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES:
        found = probes.join(F.broadcast(known), F.col("hash") == F.col("known"), "left")
        same = F.slice("words", F.greatest("start", F.lit(1)), F.col("len")) == F.col("gram")
        found = found.withColumn("true_hit", F.coalesce(same, F.lit(False)))
    else:
        text = F.array_join(F.slice("words", F.greatest("start", F.lit(1)), F.col("len")), " ")
        probes = probes.select("row", "doc_id", "text_key", F.when(F.col("start") == 0, F.size("words")).alias("n"), "start", "len", text.alias("window"))
        known = known.select(F.array_join("gram", " ").alias("gram"), "items")
        marks = probes.filter("start = 0")
        found = probes.filter("start > 0").join(known, F.col("window") == F.col("gram"))
        found = found.withColumn("true_hit", F.lit(True)).unionByName(
            marks.withColumn("true_hit", F.lit(False)), allowMissingColumns=True
        )
    n_words = F.when(F.col("start") == 0, F.size("words") if "words" in found.columns else F.col("n"))
    rows = found.filter("start = 0 OR true_hit").select(
        "row", "doc_id", "text_key", n_words.alias("n"),
        F.when(F.col("true_hit"), F.struct("start", "len")).alias("hit"),
        F.when(F.col("true_hit"), F.col("items")).alias("items"),
    )
    per_doc = rows.groupBy("row", "doc_id", "text_key").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("hit")).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per_doc.select(
        "doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), "items",
        merged_spans(F.col("hits")).alias("spans"), (F.size("hits") > 0).alias("contaminated"), "text_key",
    )


def merged_spans(hits: Column) -> Column:
    """Runs of hit words (first, last) from windows sorted by start."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(runs: Column, hit: Column) -> Column:
        new = F.struct(hit["start"].alias("first"), (hit["start"] + hit["len"] - 1).alias("last"))
        joins = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["last"] >= hit["start"] - 1)
        longer = F.struct(
            F.try_element_at(runs, F.lit(-1))["first"].alias("first"),
            F.greatest(F.try_element_at(runs, F.lit(-1))["last"], new["last"]).alias("last"),
        )
        return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(new))
        )

    return F.aggregate(hits, none, step)


def remove_documents(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without the rows whose text holds a benchmark window; all columns stay.

    Rows that share an id, or have none, are told apart by their text.
    """
    bad = found.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_key"])
    return documents.join(bad, same, "left_anti")


def remove_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` with the hit words, and what lies between them, cut from ``text``.

    All columns and rows stay; texts without a hit are not touched.
    """
    spans = found.filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans")
    )
    spans = spans.dropDuplicates(["_id", "_key"])
    same = documents["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(documents["text"]) == spans["_key"])
    raw_gap, raw_word = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words = F.array_remove(F.split("text", raw_gap), "")
    gaps = F.split("text", raw_word, -1)
    inside = lambda i, first: F.exists("_spans", lambda s: (s["first"] + first <= i) & (i <= s["last"]))
    piece = lambda i: F.concat(
        F.when(inside(i, 0), "").otherwise(F.get(words, i - 1)),
        F.when(inside(i + 1, 1), "").otherwise(F.get(gaps, i)),
    )
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(1), F.size(words)), piece), ""))
    joined = documents.join(spans, same, "left")
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).select(*documents.columns)
