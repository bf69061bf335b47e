"""Near-duplicates by SimHash fingerprints and anchor points of a covering code.

A fingerprint of 64 bits is cut into three segments, so two fingerprints that
differ in at most ``THRESHOLD`` = 4 bits differ in at most one bit of some
segment. The anchors of a segment are the words of a covering code: on 15 bits
the perfect Hamming code (every word is within one bit of exactly one code word),
on the other bits all words. A fingerprint has its home at the nearest anchor and
visits every anchor within the covering radius plus one bit; if it differs from
another in one bit of the segment, it visits that one's home. Fingerprints are
compared per anchor, homes with visitors, in all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.llm.common import blank_words, lower_ascii, task_count
from pulseweave.llm.components import connected_components

SHINGLE_WORDS = 4
#: Differing bits up to which two fingerprints are linked.
THRESHOLD = 4
#: First bit of each segment, and the width of its part outside the Hamming code.
SEGMENTS = ((0, 6), (21, 6), (42, 7))
HAMMING_BITS = 15
#: Homes of one anchor beyond which they are dealt over several tasks.
HOMES_PER_TASK = 20_000
ROWS_PER_TASK = 400_000
PAIRS_AT_ONCE = 2_000_000


def shingle_hashes(tokens: str, words: int = SHINGLE_WORDS) -> Column:
    """XXH64 (seed 42) of every shingle of the word column ``tokens``.

    Fewer words make one shingle, none make none. ``tokens`` is a column and not an
    expression, which would be computed again for every shingle.
    """
    joined = lambda start: F.xxhash64(F.array_join(F.slice(tokens, start, words), " "))
    last = F.greatest(F.size(tokens) - F.lit(words - 1), F.lit(1))
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), last), joined)
    )


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes: a bit is set if over half of a run have it.

    Bits are counted eight at a time, one in each byte of a 64-bit lane; a lane
    takes 255 hashes before it could overflow, so long runs are cut into such parts.
    """
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full].astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = (n + 254) // 255
    first_part = np.concatenate(([0], np.cumsum(parts)[:-1]))
    within = np.arange(parts.sum()) - np.repeat(first_part, parts)
    part_starts = np.repeat(starts, parts) + 255 * within
    lane = np.uint64(0x0101010101010101)
    found = np.zeros(len(full), np.uint64)
    for shift in range(8):
        bits = (hashes >> np.uint64(shift)) & lane
        sums = np.add.reduceat(bits, part_starts).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums.astype(np.int64), first_part, axis=0)
        for byte in range(8):
            over = (2 * counts[:, byte] > n).astype(np.uint64)
            found |= over << np.uint64(8 * byte + shift)
    out[full] = found
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        prints = majority_bits(hashes, lengths).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "bits"])


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and the fingerprint ``bits`` as a signed long; zero for no words.

    Extra columns are left out. A null text counts as empty.
    """
    tokens = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), blank_words(lower_ascii(F.col("text"))).alias("tokens")
    )
    hashed = tokens.select("doc_id", shingle_hashes("tokens", words).alias("h"))
    return hashed.mapInArrow(_fingerprint_batches, "doc_id long, bits long")


@lru_cache(maxsize=1)
def hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: its nearest code word, and all code words within two bits.

    The second table has eight places; words that need fewer repeat the nearest.
    """
    word = np.arange(1 << HAMMING_BITS, dtype=np.int64)
    syndrome = np.zeros_like(word)
    for i in range(HAMMING_BITS):
        syndrome ^= ((word >> i) & 1) * (i + 1)
    flips = np.array([0] + [1 << i for i in range(HAMMING_BITS)], np.int64)
    home = word ^ flips[syndrome]
    near = np.repeat(home[:, None], 8, axis=1)
    for s in range(1, HAMMING_BITS + 1):
        pairs = [(a, a ^ s) for a in range(1, HAMMING_BITS + 1) if a < a ^ s <= HAMMING_BITS]
        rows = np.flatnonzero(syndrome == s)
        for place, (a, b) in enumerate(pairs, 1):
            near[rows, place] = word[rows] ^ flips[a] ^ flips[b]
    return home, near


def visits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors that fingerprints go to: row in ``bits``, anchor, whether it is the home."""
    home_of, near_of = hamming_tables()
    row, anchor, at_home = [], [], []
    index = np.arange(len(bits))
    for k, (first, rest) in enumerate(SEGMENTS):
        part = (bits >> np.uint64(first)).astype(np.int64)
        code = part & ((1 << HAMMING_BITS) - 1)
        other = (part >> HAMMING_BITS) & ((1 << rest) - 1)
        name = lambda c, o, k=k: (k << 22) | (o << HAMMING_BITS) | c
        home = home_of[code]
        row.append(index)
        anchor.append(name(home, other))
        at_home.append(np.ones(len(bits), bool))
        for place in range(1, 8):
            near = near_of[code, place]
            away = np.flatnonzero(near != home)
            row.append(away)
            anchor.append(name(near[away], other[away]))
            at_home.append(np.zeros(len(away), bool))
        for i in range(rest):
            row.append(index)
            anchor.append(name(home, other ^ (1 << i)))
            at_home.append(np.zeros(len(bits), bool))
    return np.concatenate(row), np.concatenate(anchor), np.concatenate(at_home)


def _visit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(0).to_numpy(zero_copy_only=False)
        row, anchor, at_home = visits(bits.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.astype(np.int32)), pa.array(bits[row]), pa.array(at_home)],
            ["anchor", "bits", "at_home"],
        )


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of ``a`` and ``b``; a label is the least index of its set."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def linked(key: np.ndarray, bits: np.ndarray, at_home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Compares homes with visitors per key; fingerprints and the least one they are tied to."""
    order = np.argsort(key, kind="stable")
    key, bits, at_home = key[order], bits[order], at_home[order]
    homes = np.flatnonzero(at_home)
    low = np.searchsorted(key[homes], key, "left")
    count = np.searchsorted(key[homes], key, "right") - low
    names, place = np.unique(bits.view(np.int64), return_inverse=True)
    label = np.arange(len(names))
    ends = np.cumsum(count)
    start = 0
    while start < len(key):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = count[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        right = homes[np.repeat(low[start:stop], n) + step]
        close = np.bitwise_count(bits[left] ^ bits[right]) <= threshold
        label = merge_labels(label, place[left[close]], place[right[close]])
        start = stop
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _link_batches(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            key, bits, at_home = (rows.column(i).to_numpy() for i in range(3))
            u, v = linked(key, bits.view(np.uint64), at_home, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def print_links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Ties (u, v) between distinct fingerprints ``bits`` that span each set of linked ones.

    Within a task the linked fingerprints are joined to sets and one tie per
    fingerprint leaves it, so no group ever emits all its pairs. Homes of a crowded
    anchor are dealt over several tasks, and its visitors go to each of them.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the code covers up to {THRESHOLD} differing bits")
    rows = prints.select("bits").mapInArrow(_visit_batches, "anchor int, bits long, at_home boolean")
    crowded = (
        rows.filter("at_home")
        .groupBy("anchor")
        .agg(F.count("*").alias("homes"))
        .filter(F.col("homes") > HOMES_PER_TASK)
        .select("anchor", F.ceil(F.col("homes") / HOMES_PER_TASK).cast("int").alias("parts"))
    )
    crowded = materialize(crowded, "crowded-anchors")
    n = task_count(prints, prints.count() * 41, ROWS_PER_TASK)
    salted = rows.withColumn("part", F.lit(0))
    if not crowded.isEmpty():
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("bits"), parts).cast("int")
        every = F.sequence(F.lit(0), parts - 1)
        salted = (
            rows.join(crowded, "anchor", "left")
            .withColumn("own", own)
            .withColumn("part", F.explode(every))
            .withColumn("at_home", F.col("at_home") & (F.col("part") == F.col("own")))
        )
    # One number for anchor and part: what a task compares.
    key = (F.shiftleft(F.col("part").cast("long"), 32) + F.col("anchor")).alias("key")
    return (
        salted.select(key, "bits", "at_home")
        .repartition(n, "key")
        .mapInArrow(_link_batches(threshold), "u long, v long")
    )


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the least ``doc_id`` reachable over linked fingerprints, the
    document itself included. Documents without words have fingerprint zero and
    link like any other. Repeated rows stay repeated. A null ``doc_id`` keeps its
    row; it is never a component's id unless the component has no other. An empty
    table gives an empty result, and other columns are left out.
    """
    docs = materialize(fingerprints(documents, words), "fingerprints")
    prints = materialize(docs.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(print_links(prints, threshold))
    named = prints.join(roots.select(F.col("u").alias("bits"), F.col("v").alias("root")), "bits", "left")
    named = named.withColumn("root", F.coalesce("root", "bits"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("bits", "component_id")
    return docs.join(labels, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each component, that with the least id; all columns stay.

    Only for ids that are not null and name one text each: rows that share an id count
    as copies of one document, and one stays. ``near_texts.keep_one`` decides by row.
    """
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.select(F.col("doc_id").alias("_first")).distinct()
    kept = documents.join(first, documents["doc_id"].eqNullSafe(first["_first"]), "left_semi")
    return kept.dropDuplicates(["doc_id"])
