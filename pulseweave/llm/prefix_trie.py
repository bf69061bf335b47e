"""The trie of all conversations' prefixes, by z-fast tries that tasks build and Spark merges.

A prefix is known by a 128-bit hash of its turns, the exclusive or of one hash per turn
and place, so hashes of all prefixes follow from one pass. A task puts the conversations
it is given into a z-fast trie, one Arrow batch after the other: a compacted node, whose
edge covers the depths (lo, hi], is filed under the hash of its prefix at its handle, the
depth in (lo, hi] with most trailing zero bits. A conversation's exit node is found by fat
binary search, which probes handles only; its edge is split where the conversation leaves
it. Counts are then summed up the trie and its edges are expanded into one row per depth,
so each task hands on its distinct prefixes with partial sums, however many conversations
share them. A shuffle by prefix adds up the sums of all tasks.

Sums over distinct nodes of a subtree use that every node has an owner, its smallest
member. The nodes a conversation owns are those from some depth to its end, so their
words are one number per conversation, and a second round of tries sums these numbers.

Long conversations are cut into segments of ``SEGMENT`` turns. A segment is a string of
its own, below the prefix that it continues, so no conversation is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseweave.lineage import materialize
from pulseweave.llm.common import BLANKS
from pulseweave.operators.ordering import with_row_index

SEGMENT = 1024
#: Turns whose strings a task's trie holds; beyond, it hands on its nodes and starts anew.
TURNS_HELD = 1 << 20
PARTIAL_SCHEMA = "depth long, p long, q long, up_p long, up_q long, words long, upto long, least long, first long, second long"
_NODE = ["depth", "p", "q"]


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] with most trailing zero bits."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """Compacted trie of strings given by the hashes of all their prefixes."""

    def __init__(self) -> None:
        self.low: list[int] = []
        self.high: list[int] = []
        self.string: list[int] = []
        self.parent: list[int] = []
        self.strings: list[list[int]] = []
        #: Nodes by the prefix at their handle, and by the first prefix of their edge.
        self.handles: dict[int, int] = {}
        self.edges: dict[int, int] = {}
        self.roots: dict[int, int] = {}

    def _new(self, low: int, high: int, string: int, parent: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.string.append(string)
        self.parent.append(parent)
        return len(self.low) - 1

    def _file(self, node: int) -> None:
        prefixes, low = self.strings[self.string[node]], self.low[node]
        self.handles[prefixes[two_fattest(low, self.high[node])]] = node
        self.edges[prefixes[low + 1]] = node

    def locate(self, prefixes: list[int]) -> int:
        """The exit node: the node at whose end, or on whose edge, the string leaves the trie."""
        node = self.roots[prefixes[0]]
        low, high = 0, len(prefixes) - 1
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(prefixes[middle])
            if found is None:
                high = middle - 1
                continue
            end = self.high[found]
            if end >= len(prefixes) or self.strings[self.string[found]][end] != prefixes[end]:
                return found
            node, low = found, end
        if low + 1 < len(prefixes):
            return self.edges.get(prefixes[low + 1], node)
        return node

    def insert(self, prefixes: list[int]) -> int:
        """The node where the string ends. ``prefixes[0]`` names the root it starts from."""
        length = len(prefixes) - 1
        if prefixes[0] not in self.roots:
            self.strings.append(prefixes)
            self.roots[prefixes[0]] = self._new(0, 0, len(self.strings) - 1, -1)
        node = self.locate(prefixes)
        other = self.strings[self.string[node]]
        # Length of the common prefix, which ends on this node's edge.
        least, most = self.low[node], min(self.high[node], length)
        while least < most:
            middle = (least + most + 1) // 2
            if other[middle] == prefixes[middle]:
                least = middle
            else:
                most = middle - 1
        if least < self.high[node]:
            node = self._split(node, least)
        if least == length:
            return node
        self.strings.append(prefixes)
        leaf = self._new(least, length, len(self.strings) - 1, node)
        self._file(leaf)
        return leaf

    def _split(self, node: int, depth: int) -> int:
        """A new node above ``node`` that ends at ``depth``."""
        prefixes = self.strings[self.string[node]]
        del self.handles[prefixes[two_fattest(self.low[node], self.high[node])]]
        upper = self._new(self.low[node], depth, self.string[node], self.parent[node])
        self.low[node], self.parent[node] = depth, upper
        self._file(upper)
        self._file(node)
        return upper

    def bottom_up(self) -> list[int]:
        """Nodes so that each comes before its parent."""
        return sorted(range(len(self.high)), key=self.high.__getitem__, reverse=True)


class _Partial:
    """A trie with the arrays of its strings, and sums at the nodes where strings end."""

    def __init__(self) -> None:
        self.trie = ZFastTrie()
        self.arrays: list[tuple] = []
        self.ends: dict[int, list[int]] = {}
        self.turns = 0

    def add(self, base: int, p: np.ndarray, q: np.ndarray, words: np.ndarray, upto: np.ndarray, least: int, first: int, second: int) -> None:
        known = len(self.trie.strings)
        prefixes = [(a << 64) | b for a, b in zip(p.tolist(), q.tolist())]
        node = self.trie.insert(prefixes)
        # A string that made nodes stays, once for a new root and once for a new edge.
        for _ in range(len(self.trie.strings) - known):
            self.arrays.append((base, p, q, words, upto))
            self.turns += len(p)
        end = self.ends.setdefault(node, [least, 0, 0])
        end[0] = min(end[0], least)
        end[1] += first
        end[2] += second

    def rows(self) -> pa.RecordBatch:
        """Every depth of every edge, and the root of all where strings start from it."""
        trie = self.trie
        size = len(trie.low)
        top = np.iinfo(np.int64).max
        least, first, second = np.full(size, top), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for node, (a, b, c) in self.ends.items():
            least[node], first[node], second[node] = a, b, c
        for node in trie.bottom_up():
            up = trie.parent[node]
            if up >= 0:
                least[up] = min(least[up], least[node])
                first[up] += first[node]
                second[up] += second[node]
        parts: list[tuple] = []
        nodes, sizes = [], []
        for node in range(size):
            base, p, q, words, upto = self.arrays[trie.string[node]]
            low, high = trie.low[node], trie.high[node]
            if low < high:
                own = slice(low + 1, high + 1)
                parts.append((np.arange(base + low + 1, base + high + 1), p[own], q[own], p[low:high], q[low:high], words[own], upto[own]))
            elif base == 0:
                zero = np.zeros(1, np.uint64)
                parts.append((np.zeros(1, np.int64), p[:1], q[:1], zero, zero, words[:1], upto[:1]))
            else:
                continue
            nodes.append(node)
            sizes.append(max(high - low, 1))
        which = np.repeat(np.array(nodes, np.int64), np.array(sizes, np.int64))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 7
        columns = [c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in columns]
        columns += [least[which], first[which], second[which]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in PARTIAL_SCHEMA.split(", ")])


def _trie_batches(batches: Iterator[pa.RecordBatch], turns_held: int) -> Iterator[pa.RecordBatch]:
    held = _Partial()
    for batch in batches:
        turns = batch.column("turns")
        lengths = turns.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)
        flat = turns.flatten()
        z1, z2, words = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("z1", "z2", "words"))
        get = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("conv_id", "segment", "p0", "q0", "upto0", "first", "second")}
        for i, end in enumerate(ends.tolist()):
            own = slice(end - int(lengths[i]), end)
            start = np.array([get["p0"][i]]), np.array([get["q0"][i]]), np.array([get["upto0"][i]])
            p, q = (np.bitwise_xor.accumulate(np.concatenate((s, z[own]))).view(np.uint64) for s, z in zip(start, (z1, z2)))
            upto = np.cumsum(np.concatenate((start[2], words[own])))
            own_words = np.concatenate(([0], words[own]))
            held.add(int(get["segment"][i]) * SEGMENT, p, q, own_words, upto, int(get["conv_id"][i]), int(get["first"][i]), int(get["second"][i]))
        if held.turns > turns_held:
            yield held.rows()
            held = _Partial()
    yield held.rows()


def word_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(text, F.lit(BLANKS.replace("[", "[^", 1))).cast("long")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Slim rows of all turns: ``conv_id``, ``pos`` (from 1), ``x1``, ``x2`` (hash of role and text), ``words``.

    Turns are ordered by turn number (null first), then role, then hash of the text. A
    null role or text is empty. Rows with a null ``conv_id`` are left out, repeated rows
    are turns each. Positions come from one global order, so that no task sorts a
    conversation alone.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"),
        F.xxhash64(empty("role"), empty("text")).alias("x1"), F.xxhash64(F.lit(1), empty("role"), empty("text")).alias("x2"),
        word_count(empty("text")).alias("words"),
    )
    indexed = with_row_index(turns, ["conv_id", "turn", "role", "x1", "x2"])
    first = indexed.groupBy("conv_id").agg(F.min("row_index").alias("first_index"))
    return indexed.join(first, "conv_id").select("conv_id", (F.col("row_index") - F.col("first_index") + 1).alias("pos"), "x1", "x2", "words")


def _segments(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns of each segment as an array, with the hash and words of all turns before it and up to its end."""
    place = F.col("pos") - 1
    hashed = rows.select(
        "conv_id", F.floor(place / SEGMENT).alias("segment"), "pos", F.xxhash64("x1", "pos").alias("z1"), F.xxhash64("x2", "pos").alias("z2"), "words"
    )
    # A conversation without turns has an empty first segment.
    start = ids.select("conv_id", F.lit(0).cast("long").alias("segment"), *[F.lit(None).cast("long").alias(c) for c in ("pos", "z1", "z2", "words")])
    none = F.lit(0).cast("long")
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "z1", "z2", "words"))
    cut = hashed.unionByName(start).groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.coalesce(F.max("pos"), none).alias("depth"),
        *[F.coalesce(F.bit_xor(z), none).alias(z) for z in ("z1", "z2")], F.coalesce(F.sum("words"), none).alias("words"),
    )
    cut = materialize(cut, "segments")
    order = Window.partitionBy("conv_id").orderBy("segment")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = cut.select(
        "conv_id", "segment", F.coalesce(F.bit_xor("z1").over(before), none).alias("p0"), F.coalesce(F.bit_xor("z2").over(before), none).alias("q0"),
        F.coalesce(F.sum("words").over(before), none).alias("upto0"), F.sum("words").over(whole).alias("total"),
        (F.max("segment").over(whole) == F.col("segment")).alias("is_last"),
    )
    return materialize(cut.join(sums, ["conv_id", "segment"]), "prefix-segments")


def _partial_sums(segments: DataFrame, first: Column, second: Column, turns_held: int) -> DataFrame:
    given = segments.select("conv_id", "segment", "turns", "p0", "q0", "upto0", first.cast("long").alias("first"), second.cast("long").alias("second"))
    return given.mapInArrow(lambda batches: _trie_batches(batches, turns_held), PARTIAL_SCHEMA)


def trie_nodes(rows: DataFrame, ids: DataFrame, turns_held: int = TURNS_HELD) -> DataFrame:
    """Every node of the prefix trie of ``rows`` (as ``turn_rows`` gives them) of the conversations ``ids``.

    A node is a distinct sequence of first turns; its members are the conversations that
    start with it. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in its
    subtree), ``saved_tokens`` (over its subtree, each node's members but one times the
    words of its last turn), ``ends`` (ordered ids of the members that end here). No
    conversations give no nodes. All ids that end at one node meet in one row.
    """
    segments = _segments(rows, ids.select("conv_id").distinct())
    merged = _partial_sums(segments, F.lit(1), F.col("total"), turns_held).groupBy(*_NODE).agg(
        F.min("least").alias("conv_id"), F.sum("first").alias("n_convs"), F.sum("second").alias("total"),
        *[F.min(c).alias(c) for c in ("up_p", "up_q", "words", "upto")],
    )
    merged = materialize(merged.filter("n_convs > 0"), "trie-nodes")
    below = merged.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q"))
    nodes = merged.join(below.agg(F.count("*").alias("n_children")), _NODE, "left").fillna(0, ["n_children"])
    nodes = materialize(nodes, "trie-nodes")
    # A conversation's own nodes reach from some depth to its end.
    owners = nodes.groupBy("conv_id").agg(
        F.min(F.col("upto") - F.col("words")).alias("shared"), F.max("upto").alias("upto"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf")
    )
    owners = materialize(owners.withColumn("own", F.col("upto") - F.col("shared")).drop("upto"), "trie-owners")
    sums = _partial_sums(segments.join(owners, "conv_id"), F.col("leaf"), F.col("own"), turns_held).groupBy(*_NODE)
    sums = sums.agg(F.sum("first").alias("n_leaves"), F.sum("second").alias("own_words"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id"))
    last = segments.filter("is_last").select(
        "conv_id", F.col("depth").alias("depth"), F.col("p0").bitwiseXOR(F.col("z1")).alias("p"), F.col("q0").bitwiseXOR(F.col("z2")).alias("q")
    )
    ends = last.groupBy(*_NODE).agg(F.sort_array(F.collect_list("conv_id")).alias("ends"))
    found = nodes.join(sums, _NODE).join(owners.select("conv_id", "shared"), "conv_id").join(parents, ["depth", "up_p", "up_q"], "left").join(ends, _NODE, "left")
    above = F.col("upto") - F.col("words")
    members = F.col("total") - F.col("n_convs") * above
    distinct = F.col("own_words") + F.col("shared") - above
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (members - distinct).alias("saved_tokens"), F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"),
    )


def conversation_trie(conversations: DataFrame, turns_held: int = TURNS_HELD) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (``conv_id``, ``turn``, ``role``, ``text``); see ``trie_nodes``."""
    rows = materialize(turn_rows(conversations), "turn-rows")
    return trie_nodes(rows, rows.select("conv_id"), turns_held)
