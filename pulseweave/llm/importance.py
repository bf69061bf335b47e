"""Quality by importance resampling over hashed n-gram models.

Two generative models are bags of hashed n-grams: one of a target corpus (labelled
good documents), one of all raw documents. The log ratio of a document's probability
under both is its weight; Gumbel noise added to the weights and a top-k over the
sums draws k documents without replacement in proportion to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseweave.lineage import materialize
from pulseweave.llm.textbytes import Hasher, Words, mixed, portions, row_sums, split_words

#: Labelled good documents that the target model takes at most, by hash of their ids.
TARGET_ROWS = 20_000
BUCKET_BITS = 16
#: A document weighs as so many of its average n-grams, so length alone decides nothing.
EFFECTIVE_GRAMS = 64
#: Least weight of a plausible document of any length: half a nat lost on its average n-gram.
PLAUSIBLE = -0.5 * EFFECTIVE_GRAMS
SMOOTHING = 1.0
SEED = 17

_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Kinds of bytes in the shape of a word: lower, upper, digit, beyond ASCII; other bytes are their own kind.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 1
_SALTS = mixed(np.arange(1, 5, dtype=np.uint64))
_PAIR = np.uint64(0x100000001B3)


def gram_buckets(words: Words, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word's place: (words, 4) buckets, and which of them exist.

    They are the word, the pair of words, the word's shape (its run-length-reduced
    kinds of characters, and whether it repeats the word before) and the pair of shapes.
    """
    word = hasher.spans(words.data, words.start, words.end)
    kind = _KIND[words.data]
    change = np.concatenate(([True], kind[1:] != kind[:-1])) if len(kind) else np.zeros(0, bool)
    change[words.start] = True
    place = np.cumsum(change)
    shape = hasher.spans(kind[change], place[words.start] - 1, place[words.end - 1])
    follows = np.concatenate(([False], words.row[1:] == words.row[:-1])) if len(word) else np.zeros(0, bool)
    last_word, last_shape = np.roll(word, 1), np.roll(shape, 1)
    repeats = follows & (word == last_word)
    shape = shape + repeats.astype(np.uint64)
    last_shape = np.roll(shape, 1)
    grams = np.stack([word, word * _PAIR + last_word, shape, shape * _PAIR + last_shape], axis=1)
    buckets = (mixed(grams ^ _SALTS[None, :]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    exists = np.ones(buckets.shape, bool)
    exists[:, 1] = exists[:, 3] = follows
    return buckets, exists


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, raw, target = Hasher(), np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for first, data, offsets in portions(batch.column(0)):
            words = split_words(data, offsets, _IN_WORD)
            buckets, exists = gram_buckets(words, hasher)
            raw += np.bincount(buckets[exists], minlength=len(raw))
            mine = exists & good[first + words.row][:, None]
            target += np.bincount(buckets[mine], minlength=len(raw))
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])


def _score(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            total, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in portions(batch.column(2)):
                words = split_words(data, offsets, _IN_WORD)
                buckets, exists = gram_buckets(words, hasher)
                rows = slice(first, first + len(offsets) - 1)
                total[rows] = row_sums((ratio[buckets] * exists).sum(axis=1), words.per_row)
                grams[rows] = row_sums(exists.sum(axis=1), words.per_row)
            weight = total * EFFECTIVE_GRAMS / np.maximum(grams, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *batch.columns[3:], pa.array(grams), pa.array(weight, mask=grams == 0)],
                ["doc_id", "target", *batch.schema.names[3:], "n_grams", "log_weight"],
            )

    return run


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of labelled good documents, ``rows`` of them at most, the same in every run."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    return good.orderBy(F.xxhash64("good_id", F.lit(SEED)), "good_id").limit(rows)


def importance_weights(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``target`` (in the target sample), the columns ``keep``, ``n_grams`` and ``log_weight``.

    The raw model counts every n-gram of all documents, the target model those of the
    labelled sample. A text without words has no weight (null). Without any good
    label both models are equal and all weights zero. Rows that repeat stay repeated.
    """
    good = materialize(target_ids(labels), "target-ids")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    docs = docs.join(F.broadcast(good), docs["doc_id"] == good["good_id"], "left")
    docs = docs.select("doc_id", F.col("good_id").isNotNull().alias("target"), "text", *keep)
    counted = docs.select("text", "target").mapInArrow(_count, "bucket long, raw long, target long")
    model = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    size = 1 << BUCKET_BITS  # the most rows that the model can have
    raw, target = np.zeros(size), np.zeros(size)
    for bucket, n, m in model:
        raw[bucket], target[bucket] = n, m
    ratio = np.zeros(size)
    if target.sum():
        share = lambda c: (c + SMOOTHING) / (c.sum() + SMOOTHING * size)
        # The raw model is smoothed towards what the target's size could show.
        scaled = raw * (target.sum() / raw.sum())
        ratio = np.log(share(target) / share(scaled))
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("target", T.BooleanType())]
    fields += [T.StructField(f.name, f.dataType) for f in docs.select(*keep).schema]
    fields += [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType())]
    return docs.mapInArrow(_score(ratio), T.StructType(fields))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the column ``key``, by counting in ever narrower bins.

    Each pass is one aggregation into at most 4,096 bins; it ends when one value is left.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    while low < high:
        width = (high - low) / 4096
        inside = keys.filter(F.col("key").between(low, high))
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(4095)) if width > 0 else F.lit(0)
        bins = inside.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        bins = sorted(bins.collect(), key=lambda r: -r["bin"])
        for b in bins:
            if k <= b["n"]:
                break
            k -= b["n"]
        if (b["low"], b["high"]) == (low, high):
            values = sorted((r[0] for r in inside.select("key").distinct().collect()), reverse=True)
            for v in values:  # neighbouring numbers that no bin can part: a handful
                n = inside.filter(F.col("key") == v).count()
                if k <= n:
                    return v
                k -= n
        low, high = b["low"], b["high"]
    return low


def quality_selection(documents: DataFrame, labels: DataFrame, k: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Draws documents by weight: adds ``selection_key`` and ``selected`` to the weights.

    The noise of a row is a hash of its id and text, so a run gives the same draw again and
    rows that share an id, or have none, draw for themselves. Without ``k`` as many rows
    are drawn as have a weight of ``PLAUSIBLE`` or more. Texts without words are never drawn;
    rows that tie with the k-th are all drawn. The columns ``keep`` come along with their row.
    """
    marked = documents.withColumn("_noise", F.xxhash64("doc_id", F.col("text").cast("string"), F.lit(SEED)))
    scored = materialize(importance_weights(marked, labels, (*keep, "_noise")), "weights")
    uniform = (F.pmod(F.col("_noise"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = scored.withColumn("selection_key", F.col("log_weight") - F.log(-F.log(uniform)))
    if k is None:
        k = scored.filter(F.col("log_weight") >= PLAUSIBLE).count()
    bound = kth_largest(keyed.select(F.col("selection_key").alias("key")).filter("key IS NOT NULL"), k)
    chosen = F.lit(False) if bound is None else F.coalesce(F.col("selection_key") >= F.lit(bound), F.lit(False))
    return keyed.withColumn("selected", chosen).select("doc_id", *keep, "n_grams", "log_weight", "selection_key", "selected")
