"""Communities of weighted undirected graphs, many graphs at a time.

Every frame carries the graph key ``g`` (the window), so all windows are worked
on in the same jobs. Edges are (g, source, target, weight).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseweave.functions.hashing import string_hash32
from pulseweave.lineage import broadcast_if_small, materialize, plan_bytes
from pulseweave.operators.ordering import with_row_index

MIN_GAIN = 1e-7
#: Rounds from one measurement of the modularity (added up over graphs) to the next, and
#: the gain from one to the next below which a level ends.
MEASURED, MEASURED_GAIN = 4, 5e-4
LINKS_PER_TASK = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Nodes up to which the state of a level is numbers on the driver, and links a block then holds.
NUMBERED_NODES, BLOCK_LINKS = 2_000_000, 250_000
_PRIMES = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered node pair, weights of parallel edges added."""
    return edges.groupBy(
        "g", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).agg(F.sum("weight").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each edge seen from both ends; a self loop is seen once, counting twice."""
    loop = F.col("a") == F.col("b")
    ends = F.when(
        loop, F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m"), (F.col("w") * 2).alias("w")))
    ).otherwise(
        F.array(
            F.struct(F.col("a").alias("n"), F.col("b").alias("m"), F.col("w").alias("w")),
            F.struct(F.col("b").alias("n"), F.col("a").alias("m"), F.col("w").alias("w")),
        )
    )
    return pairs.select("g", F.explode(ends).alias("e")).select("g", "e.n", "e.m", "e.w")


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Modularity per graph of a partition (g, node, community)."""
    seen = both_ways(undirected(edges))
    part_n = partition.select("g", F.col("node").alias("n"), F.col("community").alias("cn"))
    part_m = partition.select("g", F.col("node").alias("m"), F.col("community").alias("cm"))
    placed = seen.join(part_n, ["g", "n"]).join(part_m, ["g", "m"])
    per_community = placed.groupBy("g", "cn").agg(
        F.sum("w").alias("deg"),
        F.sum(F.when(F.col("cn") == F.col("cm"), F.col("w")).otherwise(0.0)).alias("inside"),
    )
    totals = per_community.groupBy("g").agg(
        F.sum("deg").alias("two_m"),
        F.sum("inside").alias("inside"),
        F.sum(F.col("deg") * F.col("deg")).alias("deg_sq"),
    )
    return totals.select(
        "g",
        (F.col("inside") / F.col("two_m") - F.col("deg_sq") / (F.col("two_m") * F.col("two_m"))).alias(
            "modularity"
        ),
    )


def contract_graph(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Graph of communities: edge weights added up, inner edges as self loops."""
    pairs = undirected(edges)
    part = partition.select("g", "node", "community")
    placed = pairs.join(
        part.select("g", F.col("node").alias("a"), F.col("community").alias("ca")), ["g", "a"]
    ).join(part.select("g", F.col("node").alias("b"), F.col("community").alias("cb")), ["g", "b"])
    return placed.groupBy(
        "g", F.least("ca", "cb").alias("source"), F.greatest("ca", "cb").alias("target")
    ).agg(F.sum("w").alias("weight"))


def partition_at_level(levels: Sequence[DataFrame]) -> DataFrame:
    """Node to community through several levels of (g, node, community)."""

    def chain(lower: DataFrame, upper: DataFrame) -> DataFrame:
        step = upper.select("g", F.col("node").alias("community"), F.col("community").alias("_up"))
        return lower.join(step, ["g", "community"]).select(
            "g", "node", F.col("_up").alias("community")
        )

    return reduce(chain, levels)


def renumber(partition: DataFrame) -> DataFrame:
    """Communities of each graph numbered 0, 1, 2, … in id order.

    Only the list of distinct communities is ranked, not the nodes.
    """
    names = partition.select("g", "community").distinct()
    rank = F.row_number().over(Window.partitionBy("g").orderBy("community")) - 1
    numbered = names.withColumn("number", rank)
    return partition.join(numbered, ["g", "community"]).select(
        "g", "node", F.col("number").alias("community")
    )


def community_members(partition: DataFrame) -> DataFrame:
    """Member rows of each community with the community's size."""
    sizes = partition.groupBy("g", "community").agg(F.count("*").alias("n_members"))
    return partition.join(sizes, ["g", "community"]).select("g", "community", "n_members", "node")


def neighbour_partition(edges: DataFrame) -> DataFrame:
    """Start partition: each node with the smallest id among itself and its neighbours."""
    seen = both_ways(undirected(edges))
    return seen.groupBy("g", F.col("n").alias("node")).agg(
        F.min(F.least("m", "n")).alias("community")
    )


def _by_node(links: DataFrame, state: DataFrame) -> tuple[DataFrame, bool]:
    """Links and a weightless one of each node to itself, and whether all of a node's are in one partition.

    They are dealt by node once a level, so that rounds rate a node where its links are
    and shuffle none. If one node has more of them than a task's share, they stay as written.
    """
    own = state.select("g", "n", F.col("n").alias("m"), F.lit(0.0).alias("w"))
    rows = links.select("g", "n", "m", F.col("w").cast("double").alias("w")).unionByName(own)
    count, most = rows.groupBy("g", "n").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(count / LINKS_PER_TASK))
    if most > max(count / tasks, LINKS_PER_TASK / 10):
        return materialize(rows, "graph-options"), False
    fixed = state.select("g", "n", "k", "two_m")
    return rows.join(broadcast_if_small(fixed), ["g", "n"]).repartition(tasks, "g", "n").persist(StorageLevel.MEMORY_AND_DISK), True


def _codes(chunks: list[pa.Array]) -> np.ndarray:
    """Numbers that order and tell apart values as the values do."""
    found = pa.chunked_array(chunks).combine_chunks().dictionary_encode()
    rank = np.empty(len(found.dictionary), np.int64)
    rank[pc.sort_indices(found.dictionary).to_numpy()] = np.arange(len(rank))
    return rank[found.indices.to_numpy()]


def _wish_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best community of each node that would gain; all rows of a node come to one task."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    g, n, c = (_codes(rows.column(x).chunks) for x in ("g", "n", "c"))
    node = n * (g.max() + 1) + g
    order = np.lexsort((c, node))
    node, c = node[order], c[order]
    w, tot, size, k, two_m, own = (rows.column(x).to_numpy()[order] for x in ("w", "tot", "size", "k", "two_m", "own"))
    first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (c[1:] != c[:-1]))))
    w_in, own = np.add.reduceat(w, first), np.logical_or.reduceat(own, first)
    at, node, c, tot, size, k, two_m = order[first], node[first], c[first], tot[first], size[first], k[first], two_m[first]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.round(w_in - (tot - np.where(own, k, 0.0)) * k / two_m, 9)
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    lengths = np.diff(np.append(starts, len(node)))
    mine = np.repeat(np.flatnonzero(own), lengths)
    gain[(size[mine] == 1) & (size == 1) & (c > c[mine])] = -np.inf
    best = np.maximum.reduceat(gain, starts)
    # Highest gain first, smallest community id among equals.
    place = np.where(gain == np.repeat(best, lengths), np.arange(len(gain)), len(gain))
    chosen = np.minimum.reduceat(place, starts)[best > gain[own] + MIN_GAIN]
    yield from rows.select(["g", "n", "c"]).take(pa.array(at[chosen])).rename_columns(["g", "n", "best"]).combine_chunks().to_batches()


def _wishes_in_place(state: DataFrame, active: DataFrame, options: DataFrame) -> DataFrame:
    """What ``_wishes`` gives, for options kept by node and a state that fits a broadcast."""
    totals = state.groupBy("g", "c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    placed = state.select("g", F.col("n").alias("m"), "c").join(F.broadcast(totals), ["g", "c"])
    near = options if active is state else options.join(F.broadcast(active.select("g", "n")), ["g", "n"], "left_semi")
    around = near.join(F.broadcast(placed), ["g", "m"])
    rows = around.select("g", "n", "c", "w", "tot", "size", "k", "two_m", (F.col("n") == F.col("m")).alias("own"))
    return rows.mapInArrow(_wish_batches, state.select("g", "n", F.col("c").alias("best")).schema)


def _wishes(state: DataFrame, active: DataFrame, options: DataFrame) -> DataFrame:
    """The best community (g, n, best) of each of the ``active`` nodes that would gain by moving.

    ``options`` has the links and each node itself: the node's own community is always an
    option, with or without links to it.
    """
    totals = state.groupBy("g", "c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
    near = options.select("g", "n", "m", "w")
    near = near if active is state else near.join(broadcast_if_small(active.select("g", "n")), ["g", "n"], "left_semi")
    around = near.join(broadcast_if_small(state.select("g", F.col("n").alias("m"), "c")), ["g", "m"]).select("g", "n", "c", "w")
    options = around.groupBy("g", "n", "c").agg(F.sum("w").alias("w_in"))
    lone = totals.select("g", F.col("c").alias("c_own"), (F.col("size") == 1).alias("alone"))
    mine = state.select("g", "n", "k", "two_m", F.col("c").alias("c_own")).join(broadcast_if_small(lone), ["g", "c_own"])
    is_own = F.col("c") == F.col("c_own")
    without = F.col("tot") - F.when(is_own, F.col("k")).otherwise(0.0)
    rated = (
        options.join(broadcast_if_small(totals), ["g", "c"])
        .join(broadcast_if_small(mine), ["g", "n"])
        .where(~F.col("alone") | (F.col("size") > 1) | (F.col("c") <= F.col("c_own")))
        .withColumn("gain", F.round(F.col("w_in") - without * F.col("k") / F.col("two_m"), 9))
    )
    best = rated.groupBy("g", "n").agg(
        F.max("gain").alias("best_gain"), F.max(F.when(is_own, F.col("gain"))).alias("own_gain"),
        # Highest gain first, smallest community id among equals.
        F.min_by("c", F.struct(-F.col("gain"), F.col("c"))).alias("best"),
    )
    return best.where(F.col("best_gain") > F.col("own_gain") + MIN_GAIN).select("g", "n", "best")


def _rated(state: DataFrame, active: DataFrame, options: DataFrame, by_node: bool, turn: int) -> DataFrame:
    """The state after a round: ``active`` nodes are rated, and those that gain and whose turn it is move.

    Columns ``wants`` (would gain by moving) and ``moved`` say what came of it.
    """
    in_place = by_node and plan_bytes(state) <= BROADCAST_BYTES
    wishes = (_wishes_in_place if in_place else _wishes)(state, active, options)
    # Not a CRC: that one is linear, so two nodes would stay in step for ever.
    turns = F.pmod(F.xxhash64("n", F.lit(turn // 2)), F.lit(2)) == turn % 2
    wants = F.col("best").isNotNull()
    return state.select("g", "n", "k", "two_m", "c").join(wishes, ["g", "n"], "left").select(
        "g", "n", "k", "two_m", F.when(wants & turns, F.col("best")).otherwise(F.col("c")).alias("c"),
        wants.alias("wants"), (wants & turns).alias("moved"),
    )


def _frontier(state: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes to rate next: neighbours of those that moved, and those that wait for their turn."""
    moved = broadcast_if_small(state.where("moved").select("g", F.col("n").alias("m")))
    beside = links.join(moved, ["g", "m"], "left_semi").select("g", "n")
    return materialize(beside.unionByName(state.where("wants AND NOT moved").select("g", "n")).distinct(), "graph-frontier")


def _state_modularity(state: DataFrame, seen: DataFrame) -> float:
    """Modularity of a state, added up over all graphs."""
    ends = broadcast_if_small(state.select("g", "n", "c"))
    placed = seen.join(ends, ["g", "n"]).join(ends.select("g", F.col("n").alias("m"), F.col("c").alias("c_m")), ["g", "m"])
    inside = placed.where(F.col("c") == F.col("c_m")).groupBy("g").agg(F.sum("w").alias("inside"))
    totals = state.groupBy("g", "c").agg(F.sum("k").alias("tot"), F.first("two_m").alias("two_m"))
    squares = totals.groupBy("g", "two_m").agg(F.sum(F.col("tot") * F.col("tot")).alias("squares"))
    share = F.coalesce("inside", F.lit(0.0)) / F.col("two_m") - F.col("squares") / (F.col("two_m") * F.col("two_m"))
    return squares.join(inside, "g", "left").agg(F.sum(share)).first()[0] or 0.0


def _local_moves(edges: DataFrame, start: DataFrame | None) -> DataFrame:
    """Moves single nodes to neighbouring communities while modularity rises.

    Per round a hash splits the nodes in two halves and one half may move, and
    of two single nodes only the one with the larger id joins the other, so that
    nodes do not swap places for ever. A round rates the frontier only: neighbours of
    the nodes that moved last, and nodes that have yet to wait for their turn. Once the
    frontier is empty, or about as large as the graph, all nodes are rated again, and the
    rounds end when none of them wants to move. They also end when a measurement of the modularity, one every
    ``MEASURED`` rounds, finds next to no gain; the best state measured is kept. Small tables are
    broadcast; larger ones are shuffled on (g, node).
    """
    seen = both_ways(edges)
    nodes = seen.groupBy("g", "n").agg(F.sum("w").alias("k"))
    whole = nodes.groupBy("g").agg(F.sum("k").alias("two_m"))
    state = nodes.join(whole, "g").select("g", "n", "k", "two_m", F.col("n").alias("c"))
    if start is not None:
        given = start.select("g", F.col("node").alias("n"), F.col("community").alias("_c"))
        state = state.join(given, ["g", "n"], "left").withColumn("c", F.coalesce("_c", "c")).drop("_c")
    state = materialize(state, "graph-state")
    seen = materialize(seen, "graph-links")
    links = seen.where(F.col("n") != F.col("m"))
    size = state.count()
    degree = links.count() / max(1, size)
    if size <= NUMBERED_NODES:
        return _moved_in_numbers(state, seen, links, degree)
    options, by_node = _by_node(links, state)
    try:
        return _moved_on(state, seen, links, options, by_node, degree)
    finally:
        options.unpersist()


def _moved_on(state: DataFrame, seen: DataFrame, links: DataFrame, options: DataFrame, by_node: bool, degree: float) -> DataFrame:
    """The rounds of a level, from ``state`` on."""
    turn, everyone, best_q, best_state = 0, True, float("-inf"), state
    while True:
        active = state if everyone else state.join(broadcast_if_small(_frontier(state, links)), ["g", "n"], "left_semi")
        state = materialize(_rated(state, active, options, by_node, turn), "graph-state")
        size, wanted, moved = state.agg(F.count("*"), F.count_if("wants"), F.count_if("moved")).first()
        turn += 1
        if not wanted and everyone:
            break
        # Moves that many nodes are next to leave next to nobody out.
        everyone = not wanted or moved * degree > size
        if turn % MEASURED == 0:
            q = _state_modularity(state, seen)
            if q <= best_q + MEASURED_GAIN:
                best_state = state if q > best_q else best_state
                return best_state.select("g", F.col("n").alias("node"), F.col("c").alias("community"))
            best_q, best_state = q, state
    return state.select("g", F.col("n").alias("node"), F.col("c").alias("community"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (i, j, w) by node in blocks: the nodes, how many links each has, their other ends and weights."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    i, j, w = (rows.column(x).to_numpy() for x in ("i", "j", "w"))
    order = np.lexsort((j, i))
    i, j, w = i[order].astype(np.int32), j[order].astype(np.int32), w[order].astype(np.float64)
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    ends = np.append(first, len(i))
    cut = 0
    while cut < len(first):
        to = max(cut + 1, int(np.searchsorted(ends, ends[cut] + BLOCK_LINKS, "right")) - 1)
        low, high = ends[cut], ends[to]
        values = (i[first[cut:to]], np.diff(ends[cut : to + 1]).astype(np.int32), j[low:high], w[low:high])
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], ["i", "n", "j", "w"])
        cut = to


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The blocks of ``_packed``: nodes, the place of each link's node, other ends, weights."""
    for row in range(batch.num_rows):
        i, n, j = (np.frombuffer(batch.column(x)[row].as_buffer(), np.int32) for x in ("i", "n", "j"))
        yield i, np.repeat(np.arange(len(i)), n), j, np.frombuffer(batch.column("w")[row].as_buffer(), np.float64)


def _wishes_of_block(i, at, j, w, c, k, two_m, tot, size) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """What ``_wish_batches`` gives, for the numbers of a block: nodes that gain, and where to."""
    own_c = c[i].astype(np.int64)
    key = np.concatenate((at.astype(np.int64) << 32 | c[j], np.arange(len(i)) << 32 | own_c))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    w_in = np.add.reduceat(np.append(w, np.zeros(len(i)))[order], first)
    at, to = key[first] >> 32, key[first] & 0xFFFFFFFF
    own, k = to == own_c[at], k[i][at]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.round(w_in - (tot[to] - np.where(own, k, 0.0)) * k / two_m[i][at], 9)
    starts = np.searchsorted(at, np.arange(len(i)))
    # Of two single nodes only the one with the larger id joins the other.
    gain[(size[own_c[at]] == 1) & (size[to] == 1) & (to > own_c[at])] = -np.inf
    best = np.maximum.reduceat(gain, starts)
    # Highest gain first, smallest community id among equals.
    place = np.where(gain == best[at], np.arange(len(gain)), len(gain))
    gains = best > gain[own] + MIN_GAIN
    return i[gains], to[np.minimum.reduceat(place, starts)[gains]].astype(np.int32)


def _turn_bits(hashes: np.ndarray, number: int) -> np.ndarray:
    """The lowest bit of Spark's ``xxhash64(n, number)`` for nodes of given ``xxhash64(n)``."""
    one, two, three, five = _PRIMES
    x = hashes + five + np.uint64(4)
    x ^= np.uint64(number * int(one) % (1 << 64))
    x = (x << np.uint64(23) | x >> np.uint64(41)) * two + three
    x = (x ^ x >> np.uint64(33)) * two
    x = (x ^ x >> np.uint64(29)) * three
    return ((x ^ x >> np.uint64(32)) & np.uint64(1)).astype(np.int64)


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, nulls last."""
    found = column.combine_chunks()
    found = pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found
    if not len(found):
        return np.empty(0, np.int64)
    return pc.rank(found, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64) - 1


def _null_sums(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums as SQL makes them: nulls (NaN) count only where there is nothing else."""
    has = ~np.isnan(values)
    sums = np.bincount(groups[has], values[has], size)
    return np.where(np.bincount(groups[has], minlength=size) > 0, sums, np.nan)


def _moved_in_numbers(state: DataFrame, seen: DataFrame, links: DataFrame, degree: float) -> DataFrame:
    """The rounds of a level whose state the driver holds as numbers: what ``_moved_on`` gives.

    Nodes and communities are numbered in the order of their ids. Links are packed by node once
    a level and stay in their tasks; a round is one job that is sent the communities and gives
    the wishes, so it shuffles nothing and writes nothing.
    """
    spark = state.sparkSession
    sc = spark.sparkContext
    numbered = materialize(with_row_index(state.select("g", "n", "k", "two_m", "c"), ["g", "n"], "i"), "graph-numbers")
    ends = broadcast_if_small(numbered.select("g", "n", "i"))
    rows = seen.join(ends, ["g", "n"]).join(ends.select("g", F.col("n").alias("m"), F.col("i").alias("j")), ["g", "m"])
    rows = rows.select("i", "j", F.col("w").cast("double").alias("w"))
    tasks = max(sc.defaultParallelism, math.ceil(degree * numbered.count() / LINKS_PER_TASK))
    packed = rows.repartitionByRange(tasks, "i").mapInArrow(_packed, "i binary, n binary, j binary, w binary").persist(StorageLevel.MEMORY_AND_DISK)
    held = numbered.select("*", F.xxhash64("n").alias("h")).orderBy("i").toArrow()
    size = held.num_rows
    k, two_m = (held.column(x).cast(pa.float64()).to_numpy() for x in ("k", "two_m"))
    hashes, graph = held.column("h").to_numpy().view(np.uint64), _ranks(held.column("g"))
    wanted = graph * (size + 1) + _ranks(held.column("c"))
    _, holder, c = np.unique(wanted, return_index=True, return_inverse=True)
    c = c.astype(np.int32)
    of_graph = graph[holder]
    fixed = sc.broadcast((k, two_m, graph))

    def told(run, schema: str, *values: np.ndarray | None) -> pa.Table:  # noqa: ANN001
        sent = sc.broadcast(values)
        try:
            return packed.mapInArrow(lambda batches: run(batches, *sent.value), schema).toArrow()
        finally:
            sent.destroy()

    def wishes(batches, c, tot, count, moved, waits):  # noqa: ANN001
        k, two_m, _ = fixed.value
        for batch in batches:
            for i, at, j, w in _blocks(batch):
                links = i[at] != j
                if moved is not None:
                    near = waits[i] | (np.bincount(at[links], moved[j[links]], len(i)) > 0)
                    links &= near[at]
                    at, i = (np.cumsum(near) - 1)[at], i[near]
                if len(i):
                    found = _wishes_of_block(i, at[links], j[links], w[links], c, k, two_m, tot, count)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], ["i", "best"])

    def inside(batches, c):  # noqa: ANN001
        graph = fixed.value[2]
        for batch in batches:
            for i, at, j, w in _blocks(batch):
                same = (c[i][at] == c[j]) & ~np.isnan(w)
                of, place = np.unique(graph[i[at[same]]], return_inverse=True)
                sums = np.bincount(place, w[same], len(of))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(sums, pa.float64())], ["g", "w"])

    def modularity_now() -> float:
        """As ``_state_modularity`` has it."""
        found = told(inside, "g long, w double", c)
        graphs = int(graph.max()) + 1
        within = np.bincount(found.column("g").to_numpy(), found.column("w").to_numpy(), graphs)
        totals = _null_sums(c, k, len(holder))
        used = np.bincount(c, minlength=len(holder)) > 0
        squares = _null_sums(of_graph[used], totals[used] ** 2, graphs)
        whole = np.full(graphs, np.nan)
        whole[graph] = two_m
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.nansum(within / whole - squares / (whole * whole)))

    turn, everyone, best_q, best_c = 0, True, float("-inf"), c
    moved = wants = np.zeros(size, bool)
    try:
        while size:
            frontier = (None, None) if everyone else (moved, wants & ~moved)
            found = told(wishes, "i binary, best binary", c, _null_sums(c, k, len(holder)), np.bincount(c, minlength=len(holder)), *frontier)
            nodes, best = (np.frombuffer(b"".join(found.column(x).to_pylist()), np.int32) for x in ("i", "best"))
            wants, moved, c = np.zeros(size, bool), np.zeros(size, bool), c.copy()
            wants[nodes] = True
            moves = _turn_bits(hashes[nodes], turn // 2) == turn % 2
            moved[nodes[moves]] = True
            c[nodes[moves]] = best[moves]
            turn += 1
            if not len(nodes) and everyone:
                break
            # Moves that many nodes are next to leave next to nobody out.
            everyone = not len(nodes) or np.count_nonzero(moves) * degree > size
            if turn % MEASURED == 0:
                q = modularity_now()
                if q <= best_q + MEASURED_GAIN:
                    c = c if q > best_q else best_c
                    break
                best_q, best_c = q, c
    finally:
        packed.unpersist()
        fixed.destroy()
    # A community bears the id it began with.
    ids = held.column("c").take(pa.array(holder[c]))
    part = pa.table({"g": held.column("g"), "node": held.column("n"), "community": ids})
    fields = [("g", "g"), ("n", "node"), ("c", "community")]
    schema = T.StructType([T.StructField(name, state.schema[x].dataType) for x, name in fields])
    return materialize(spark.createDataFrame(part, schema), "graph-state")


def _best_level(edges: DataFrame, partitions: Sequence[DataFrame]) -> DataFrame:
    """Per graph the partition with the highest modularity, the coarser among equals."""
    if len(partitions) == 1:
        return partitions[0]
    tagged = reduce(
        DataFrame.unionByName,
        [p.withColumn("level", F.lit(i)) for i, p in enumerate(partitions)],
    )
    leveled = F.struct("level", "g").alias("g")
    copies = edges.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(partitions) - 1))))
    q = modularity(
        copies.select(leveled, "source", "target", "weight"),
        tagged.select(leveled, "node", "community"),
    ).select("g.g", "g.level", F.round("modularity", 9).alias("q"))
    best = q.groupBy("g").agg(F.max_by("level", F.struct("q", "level")).alias("level"))
    return tagged.join(best, ["g", "level"]).select("g", "node", "community")


def louvain_communities(edges: DataFrame, init: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Partition (g, node, community) that maximises modularity, level by level.

    Each level moves nodes until the gain ends, contracts the graph and goes on with
    the smaller one, until nothing merges; the best level of each graph is kept.
    ``nodes`` (g, node) may name nodes without an edge: each is a community of its
    own. State between rounds is a table in shared storage; the driver only sees how
    many nodes moved and the modularity.
    """
    level_edges = materialize(undirected(edges), "graph-edges")
    base = level_edges.withColumnsRenamed({"a": "source", "b": "target", "w": "weight"})
    so_far: list[DataFrame] = []
    while True:
        part = _local_moves(level_edges, None if so_far else init)
        n_nodes, merged = part.agg(F.count("*"), F.count_distinct("g", "community")).first()
        if so_far and n_nodes == merged:
            break
        so_far.append(
            materialize(partition_at_level([so_far[-1], part]), "graph-level") if so_far else part
        )
        if n_nodes == merged:
            break
        plain = level_edges.withColumnsRenamed({"a": "source", "b": "target", "w": "weight"})
        level_edges = materialize(
            contract_graph(plain, part).withColumnsRenamed({"source": "a", "target": "b", "weight": "w"}),
            "graph-edges",
        )
    found = _best_level(base, so_far)
    if nodes is None:
        return found
    linked = found.select(F.col("g").alias("_g"), F.col("node").alias("_node"))
    alone = nodes.select("g", "node").distinct().join(
        linked, (F.col("g") == F.col("_g")) & (F.col("node") == F.col("_node")), "left_anti"
    )
    return found.unionByName(alone.select("g", "node", F.col("node").alias("community")))


def event_authors(
    event_clusters: DataFrame, members: DataFrame, posts: DataFrame, author: str = "screen_name"
) -> DataFrame:
    """Distinct authors (event_id, author) of the posts behind each event."""
    event_posts = (
        event_clusters.join(members.select("cluster_id", "post_id"), "cluster_id")
        .select("event_id", "post_id")
        .distinct()
    )
    who = posts.where(F.col(author).isNotNull()).select("post_id", F.col(author).alias("author")).distinct()
    return event_posts.join(who, "post_id").select("event_id", "author").distinct()


def user_network(authors: DataFrame, follows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected links among the authors of each event.

    ``follows`` holds (follower, followed). Authors without a relation to
    another author of the event are left out.
    """
    known = materialize(authors.where("event_id IS NOT NULL AND author IS NOT NULL").select("event_id", "author").distinct(), "known-authors")
    # Authors are numbered in the order of their names and hashed once, so that pairs and relations are numbers.
    names = with_row_index(known.select("author").distinct(), ["author"], "no")
    names = materialize(names.select("author", "no", string_hash32(F.col("author")).alias("id")), "author-numbers")
    events = with_row_index(known.select("event_id").distinct(), ["event_id"], "event")
    n = F.lit(max(1, names.count())).cast("long")
    at = (F.col("event") * n + F.col("no")).alias("at")
    placed = known.join(broadcast_if_small(names), "author").join(broadcast_if_small(events), "event_id")
    placed = materialize(placed.select("event_id", "author", "id", "event", "no", at), "placed-authors")
    follower, followed = (broadcast_if_small(names.select(F.col("author").alias(x), F.col("no").alias(f"{x}_no"))) for x in ("follower", "followed"))
    # Pairs are told apart once and not once per event, and only those of two authors.
    both = follows.select("follower", "followed").where(F.col("follower") != F.col("followed")).join(follower, "follower").join(followed, "followed")
    low, high = F.least("follower_no", "followed_no"), F.greatest("follower_no", "followed_no")
    pairs = both.select((low * n + high).alias("pair")).repartition("pair").distinct()
    a = F.call_function("div", "pair", n)
    pairs = materialize(pairs.select(a.alias("a"), F.pmod("pair", n).alias("b")), "follow-pairs")
    near = broadcast_if_small(placed.select(F.col("no").alias("a"), "event", F.col("id").alias("source")))
    far = broadcast_if_small(placed.select(F.col("at").alias("at_b"), "event_id", F.col("id").alias("target")))
    relations = pairs.join(near, "a").withColumns({"at_a": F.col("event") * n + F.col("a"), "at_b": F.col("event") * n + F.col("b")}).join(far, "at_b")
    links = relations.select("event_id", "source", "target")
    related = relations.select(F.explode(F.array("at_a", "at_b")).alias("at")).distinct()
    nodes = related.join(broadcast_if_small(placed), "at").select("event_id", "id", F.col("author").alias("name"))
    return nodes, links
