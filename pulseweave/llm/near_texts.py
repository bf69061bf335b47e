"""Near copies among texts: short SimHash fingerprints find them, exact Jaccard similarity confirms them.

Every text has many fingerprints of a few bits, each with a seed of its own and laid
over a covering code: the perfect Hamming code on 15 bits, all words on the rest. A
fingerprint goes to the anchor within the covering radius of one bit (there is always
one, and only one), and texts that come to the same anchor are compared by a sketch of
128 bits. Texts tied by close sketches form candidate groups, and within these all texts
are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseweave.lineage import broadcast_if_small, materialize
from pulseweave.llm.common import blank_words, lower_ascii, task_count
from pulseweave.llm.components import connected_components
from pulseweave.llm.simhash import HAMMING_BITS, PAIRS_AT_ONCE, ROWS_PER_TASK, hamming_tables, majority_bits, merge_labels, shingle_hashes
from pulseweave.llm.textbytes import mixed

SHINGLE_WORDS = 5
#: Jaccard similarity of the shingle sets from which on two texts are near copies.
SIMILAR = 0.8
#: Share of the pairs at just ``SIMILAR`` that some short fingerprint is to bring together.
RECALL = 0.99
#: Bits of an anchor's name at least: 11 tell the code words of 15 bits apart.
LEAST_NAME, CODE_NAME = 14, 11
#: Differing bits of the sketch up to which texts become candidates: 0.8 gives 19, with a deviation of 4; strangers 64.
SKETCH_DISTANCE = 32
#: Texts at one anchor beyond which they are compared by spreading from one to the next.
CROWD = 256


def meeting(differ: float, width: int) -> float:
    """Share of the pairs, with bits that differ at the rate ``differ``, that a fingerprint brings to one anchor.

    Around one anchor, words are two bits apart at most; an eighth of the pairs one bit
    apart are around one anchor, and of those two bits apart.
    """
    n, same = HAMMING_BITS, 1 - differ
    one, two = n * differ * same ** (n - 1), math.comb(n, 2) * differ**2 * same ** (n - 2)
    return (same**n + (one + two) / 8) * same ** (width - n)


def layout(texts: int) -> tuple[int, int]:
    """Width of the short fingerprints and how many: strangers that come to one anchor stay about 1,000."""
    name = max(LEAST_NAME, math.ceil(math.log2(max(texts, 1))) - 10)
    width = HAMMING_BITS + name - CODE_NAME
    turned = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi  # share of bits that differ
    return width, math.ceil(math.log(1 - RECALL) / math.log1p(-meeting(turned, width)))


def prints_needed(width: int, bands: int) -> int:
    return max(2, math.ceil(bands / (64 // width)))


def _print_batches(n: int):
    salts = mixed(np.arange(1, n + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            prints = np.stack([majority_bits(mixed(hashes ^ s), lengths) for s in salts], axis=1)
            ends = pa.array(np.arange(0, prints.size + 1, n), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(prints.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "prints"])

    return run


def anchors(prints: np.ndarray, width: int) -> np.ndarray:
    """The anchor of fingerprints of ``width`` bits: the code word next to their first 15, and the rest."""
    code, rest = prints & np.uint64((1 << HAMMING_BITS) - 1), prints >> np.uint64(HAMMING_BITS)
    home = hamming_tables()[0].astype(np.uint64)[code.astype(np.int64)]
    return (rest & np.uint64((1 << (width - HAMMING_BITS)) - 1)) << np.uint64(HAMMING_BITS) | home


def _anchor_batches(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = 64 // width
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
            a, b = (pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in (0, 1))
            for k in range(bands):
                part = anchors(prints[:, k // each] >> np.uint64(width * (k % each)), width)
                key = (np.uint64(k) << np.uint64(48)) | part
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), a, b], ["key", "a", "b"])

    return run


def close_ties(key: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int = SKETCH_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Sketches (a, b) compared per key; names ``a`` and the least one they are tied to.

    In a crowd, what one sketch reaches is not compared among itself, only with what
    is not yet reached: the same groups, in one pass for a group of near copies.
    """
    order = np.argsort(key, kind="stable")
    key, a, b = key[order], a[order], b[order]
    names, place = np.unique(a.view(np.int64), return_inverse=True)
    label = np.arange(len(names))
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(key)))
    later = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1
    later[np.repeat(sizes > CROWD, sizes)] = 0
    ends, start = np.cumsum(later), 0
    while start < len(key):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, "right")))
        n = later[start:stop]
        left = np.repeat(np.arange(start, stop), n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        close = np.bitwise_count(a[left] ^ a[right]).astype(int) + np.bitwise_count(b[left] ^ b[right]) <= distance
        label = merge_labels(label, place[left[close]], place[right[close]])
        start = stop
    for first, size in zip(starts[sizes > CROWD], sizes[sizes > CROWD]):
        open_rows, reached = np.arange(first + 1, first + size), [first]
        while len(open_rows):
            one = reached.pop() if reached else None
            if one is None:
                reached, open_rows = [open_rows[0]], open_rows[1:]
                continue
            close = np.bitwise_count(a[open_rows] ^ a[one]).astype(int) + np.bitwise_count(b[open_rows] ^ b[one]) <= distance
            if close.any():
                new = open_rows[close]
                label = merge_labels(label, np.full(len(new), place[one]), place[new])
                reached.extend(new)
                open_rows = open_rows[~close]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _tie_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held)
        key, a, b = (rows.column(i).to_numpy() for i in range(3))
        u, v = close_ties(key, a.view(np.uint64), b.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _share_rare(code: np.ndarray, row: np.ndarray, lengths: np.ndarray, least: float) -> np.ndarray:
    """Labels of sets that are tied by codes each of them holds among its rarest.

    Two sets of Jaccard similarity ``least`` or more have a code in common that is in the
    first ``n - ceil(least * n) + 1`` of both, in any one order of all codes. With the
    rarest first, sets that share a common part only are not tied.
    """
    often = np.bincount(code)
    order = np.lexsort((code, often[code], row))
    code, row = code[order], row[order]
    rank = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = rank < (lengths - np.ceil(least * lengths - 1e-9) + 1)[row]
    code, row = code[first], row[first]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    same = code[1:] == code[:-1]
    return merge_labels(np.arange(len(lengths)), row[1:][same], row[:-1][same])


def _spread(code: np.ndarray, row: np.ndarray, whole: np.ndarray, ends: np.ndarray, lengths: np.ndarray, members: np.ndarray, label: np.ndarray, mark: np.ndarray, least: float) -> None:
    """Labels ``members``; each set reached is compared with all of them that are not."""
    for seed in members:
        if label[seed] >= 0:
            continue
        label[seed], reached = seed, [seed]
        while reached:
            one = reached.pop()
            own = whole[ends[one] - lengths[one] : ends[one]]
            mark[own] = True
            hit, common = np.unique(row[mark[code]], return_counts=True)
            mark[own] = False
            near = hit[(label[hit] < 0) & (common >= least * (lengths[one] + lengths[hit] - common) - 1e-9)]
            if len(near):
                label[near] = seed
                reached.extend(near)
                still = label[row] < 0
                code, row = code[still], row[still]


def similar_sets(codes: np.ndarray, lengths: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """Sets of distinct codes, one after the other, to the least index reachable over pairs of Jaccard ``least`` or more.

    Sets are first parted by the rare codes they share, and compared within a part.
    """
    n = len(lengths)
    names, code = np.unique(codes, return_inverse=True)
    row = np.repeat(np.arange(n), lengths)
    ends = np.cumsum(lengths)
    part = _share_rare(code, row, lengths, least)
    label, mark = np.full(n, -1), np.zeros(len(names), bool)
    order = np.argsort(part, kind="stable")
    bounds = np.append(np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))), n)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        members = order[low:high]
        if len(members) == 1:
            label[members] = members
            continue
        taken = np.concatenate([np.arange(ends[m] - lengths[m], ends[m]) for m in members])
        _spread(code[taken], row[taken], code, ends, lengths, members, label, mark, least)
    return label


def _confirm(texts: pa.Table) -> pa.Table:
    ids, lists = texts.column("text_id").combine_chunks(), texts.column("h").combine_chunks()
    order = np.argsort(np.array(ids.to_pylist(), object), kind="stable")
    ids, lists = ids.take(pa.array(order)), lists.take(pa.array(order))
    label = similar_sets(lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64))
    return pa.table([ids, ids.take(pa.array(label))], ["text_id", "copy_of"])


def _words(text: str) -> Column:
    return blank_words(lower_ascii(F.col(text).cast("string")))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each group of near copies: least ``doc_id`` (null last), then text digest; all columns stay.

    Two texts are near copies if they have the same words, ASCII case and white space
    aside, or if their sets of five-word shingles (fewer words make one) have a Jaccard
    similarity of 0.8 or more; groups chain over such pairs. Rows count by their text
    and not by their id: rows that share an id, or have none, stay if their texts differ.
    Texts without words, null ones among them, count as one text.
    """
    width, bands = layout(documents.count())
    count = prints_needed(width, bands)
    slim = documents.select(
        F.struct(*documents.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"),
        F.monotonically_increasing_id().alias("n"), _words("text").alias("tokens"),
    )
    text_id = F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("text_id")
    hashed = slim.select("row", "doc_id", "digest", "n", text_id, F.array_distinct(shingle_hashes("tokens", SHINGLE_WORDS)).alias("h"))
    schema = hashed.drop("h").schema.add("prints", T.ArrayType(T.LongType()))
    rows = materialize(hashed.mapInArrow(_print_batches(count), schema), "text-prints")
    texts = rows.filter(F.size(_words("row.text")) > 0).select("text_id", "prints").distinct()
    prints = texts.select("prints").distinct()
    bits = prints.mapInArrow(_anchor_batches(width, bands), "key long, a long, b long")
    tasks = task_count(documents, prints.count() * bands, ROWS_PER_TASK)
    roots = connected_components(bits.repartition(tasks, "key").mapInArrow(_tie_batches, "u long, v long"))
    named = texts.select("text_id", F.get("prints", F.lit(0)).alias("u")).join(roots, "u", "left")
    named = named.select("text_id", F.coalesce("v", "u").alias("root"))
    several = named.groupBy("root").count().filter("count > 1").select("root")
    candidates = materialize(named.join(several, "root", "left_semi"), "copy-candidates")
    # Candidates and rows that go are few as a rule: their join then moves no text.
    words = rows.select("text_id", F.array_join(_words("row.text"), " ").alias("words")).join(broadcast_if_small(candidates), "text_id").distinct()
    sets = words.select("root", "text_id", F.split("words", " ").alias("tokens"))
    sets = sets.select("root", "text_id", F.array_distinct(shingle_hashes("tokens", SHINGLE_WORDS)).alias("h"))
    copies = materialize(sets.groupBy("root").applyInArrow(lambda t: _confirm(t), "text_id binary, copy_of binary"), "copies")
    group = F.coalesce("copy_of", "text_id").alias("group")
    members = rows.select("text_id", "doc_id", "digest", "n").join(copies, "text_id", "left").select("doc_id", "digest", "n", group)
    first = members.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "digest", "n"))["n"].alias("first"))
    gone = materialize(members.join(first, "group").filter("n <> first").select(F.col("n").alias("gone")), "rows-that-go")
    return rows.join(broadcast_if_small(gone), F.col("n") == F.col("gone"), "left_anti").select("row.*")
