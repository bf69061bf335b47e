"""Runs of periodic text found through string synchronising sets.

A run is a stretch of words that repeats itself with smallest period q, at least four
times over, and that no neighbouring word extends. At each dyadic scale t a
synchronising set picks positions by the hashes of the t words from them on: a position
is picked if its own hash, or that t words later, is the least among the t + 1 hashes
between. The pick depends on the next 2t words only, so equal contexts are picked alike,
and any t positions in a row hold a pick unless the text there repeats with a period of
at most t / 4. Within a run of period t < q <= 2t two successive picks with equal contexts
lie exactly q apart; such a pair proposes q, and comparing the words themselves gives the
ends. Positions inside stretches of period up to t / 4 are left out of the choice, else
they would all be picked; those stretches are the runs found at smaller scales, which
start with the periods one and two, compared directly.

The work is O(n log² n) numpy operations on the words of a portion of texts together;
distinct separators keep runs inside their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulseweave.llm.textbytes import Hasher, Words, mixed, portions, split_words

#: Periods a run holds at least. Fewer than four would escape the proposals.
LEAST_PERIODS = 4
#: Words a run holds at least.
LEAST_WORDS = 6
#: Words of kept text copied at once.
WORDS_AT_ONCE = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
RUN_SCHEMA = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``flags`` holds."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _small_periods(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the smallest periods one and two that last four periods."""
    found = []
    for period in (1, 2):
        start, end = stretches(ids[period:] == ids[:-period])
        end = end + period
        long = end - start >= LEAST_PERIODS * period
        if period == 2:
            long &= ids[start] != ids[start + 1]
        found.append((start[long], end[long], np.full(int(long.sum()), period)))
    return tuple(np.concatenate(part) for part in zip(*found))


def _sliding_least(values: np.ndarray, scale: int) -> np.ndarray:
    """Least of each ``scale + 1`` successive values; ``scale`` is a power of two."""
    least, width = values, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:-1], values[scale:])


def synchronising_set(hashes: np.ndarray, left_out: np.ndarray, scale: int) -> np.ndarray:
    """Positions picked at ``scale``, from the hashes of the ``scale`` words at each position."""
    values = np.where(left_out, _NONE, hashes)
    least = _sliding_least(values, scale)
    own, later = values[: len(least)], values[scale:]
    return np.flatnonzero((least != _NONE) & ((own == least) | (later == least)))


def _reach(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` of words equal to those ``period`` later."""
    last = len(ids) - period
    end, step = at, 16
    while end < last:
        stop = min(end + step, last)
        apart = np.flatnonzero(ids[end:stop] != ids[end + period : stop + period])
        if len(apart):
            end += int(apart[0])
            break
        end, step = stop, 2 * step
    start, step = at, 16
    while start > 0:
        stop = max(start - step, 0)
        apart = np.flatnonzero(ids[stop:start] != ids[stop + period : start + period])
        if len(apart):
            start = stop + int(apart[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end


def _proposed(ids: np.ndarray, picks: np.ndarray, contexts: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) that successive picks with equal contexts propose."""
    order = np.argsort(contexts[picks], kind="stable")
    at = picks[order]
    same = contexts[at[1:]] == contexts[at[:-1]]
    apart = at[1:] - at[:-1]
    good = same & (apart > scale) & (apart <= 2 * scale)
    at, period = at[:-1][good], apart[good]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    if not len(at):
        return
    # A pair that lies in the context of the one before belongs to the same run.
    fresh = np.ones(len(at), bool)
    fresh[1:] = (period[1:] != period[:-1]) | (at[1:] > at[:-1] + 2 * scale)
    done = (0, 0)
    for k, q in zip(at[fresh].tolist(), period[fresh].tolist()):
        if done[0] == q and k < done[1]:
            continue
        start, end = _reach(ids, k, q)
        done = (q, end)
        if end + q - start >= LEAST_PERIODS * q:
            yield start, end + q, q


def text_runs(ids: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least four periods: first word and end in ``ids``, and period.

    ``ids`` holds the word hashes of all texts, ``per_row`` the number of words of each.
    Runs are in order of start and period.
    """
    rows = len(per_row)
    # Each text is followed by a separator of its own.
    row = np.repeat(np.arange(rows), per_row)
    place = np.arange(len(ids)) + row
    values = np.empty(len(ids) + rows, np.uint64)
    values[place] = ids
    firsts = np.cumsum(per_row + 1) - per_row - 1
    values[firsts + per_row] = mixed(np.arange(rows, dtype=np.uint64) + _ODD)
    starts, ends, periods = _small_periods(values)
    sizes, origin = per_row.copy(), np.arange(len(values))
    scale = 2
    level = mixed(values[:-1] * _ODD + values[1:]) if len(values) > 1 else values[:0]
    while (sizes >= LEAST_PERIODS * (scale + 1)).any():
        keep = sizes >= LEAST_PERIODS * (scale + 1)
        if not keep.all():
            # Texts too short for periods of this scale take no further part.
            inside = np.repeat(keep, sizes + 1)
            values, origin, sizes = values[inside], origin[inside], sizes[keep]
            level = values
            for width in (1 << b for b in range(scale.bit_length() - 1)):
                level = mixed(level[:-width] * _ODD + level[width:])
        contexts = mixed(level[:-scale] * _ODD + level[scale:])
        left_out = np.zeros(len(level) + 1, np.int32)
        small = (LEAST_PERIODS * periods <= scale) & (ends - starts >= scale)
        here = np.searchsorted(origin, starts[small])
        known = (here < len(origin)) & (origin[np.minimum(here, len(origin) - 1)] == starts[small])
        here, length = here[known], (ends - starts)[small][known]
        np.add.at(left_out, here, 1)
        np.add.at(left_out, here + length - scale + 1, -1)
        picks = synchronising_set(level, np.cumsum(left_out[:-1]) > 0, scale)
        found = list(_proposed(values, picks, contexts, scale))
        if found:
            start, end, period = np.array(found).T
            starts = np.concatenate((starts, origin[start]))
            ends = np.concatenate((ends, origin[start] + end - start))
            periods = np.concatenate((periods, period))
        level, scale = contexts, 2 * scale
    order = np.lexsort((periods, starts))
    starts, ends, periods = starts[order], ends[order], periods[order]
    shift = np.searchsorted(firsts, starts, "right") - 1
    return starts - shift, ends - shift, periods


def _joined(words: Words, kept: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of the kept words, joined by one space in each row."""
    start, end, row = words.start[kept], words.end[kept], words.row[kept]
    more = np.zeros(len(row), np.int64)
    more[:-1] = row[1:] == row[:-1]
    size = end - start + more
    to = np.cumsum(size)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    for first in range(0, len(row), WORDS_AT_ONCE):
        part = slice(first, first + WORDS_AT_ONCE)
        begin, finish = int(to[first] - size[first]), int(to[part][-1])
        source = np.repeat(start[part] - (to[part] - size[part]), size[part]) + np.arange(begin, finish)
        out[begin:finish] = words.data[np.minimum(source, len(words.data) - 1)]
    out[(to - 1)[more == 1]] = 0x20
    offsets = np.zeros(rows + 1, np.int64)
    np.add.at(offsets, row + 1, size)
    return out, np.cumsum(offsets)


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for first, data, offsets in portions(batch.column(1)):
            rows = len(offsets) - 1
            words = split_words(data, offsets, _IN_WORD)
            start, end, period = text_runs(hasher.spans(data, words.start, words.end), words.per_row)
            wanted = end - start >= LEAST_WORDS
            start, end, period = start[wanted], end[wanted], period[wanted]
            dropped = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(dropped, start + period, 1)
            np.add.at(dropped, end, -1)
            text, ends = _joined(words, np.cumsum(dropped[:-1]) == 0, rows)
            row = words.row[start] if len(start) else start
            before = np.cumsum(words.per_row) - words.per_row
            run = pa.StructArray.from_arrays(
                [pa.array(start - before[row]), pa.array(end - start), pa.array(period.astype(np.int64))], fields=list(_RUN)
            )
            run_ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, rows), pa.array(words.per_row.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(run_ends), run),
                    pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(text)).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` and the ``collapsed`` text.

    ``runs`` is an array of (start, length, period), in words from 0, by start and period:
    every run of at least ``LEAST_PERIODS`` periods and ``LEAST_WORDS`` words. ``collapsed``
    joins by one space the words that no run holds after its first period.

    Words lie between ASCII white space and are compared by 64-bit hashes. A null or
    empty text has no words, no runs and an empty collapsed text. Repeated rows and rows
    with a null ``doc_id`` stay, each with its own result; other columns are left out. An
    empty table gives an empty result. A text is searched whole in one task, with about
    a hundred bytes of memory a word.
    """
    rows = documents.selectExpr("cast(doc_id as long) AS doc_id", "text")
    return rows.mapInArrow(_run_batches, f"doc_id long, n_words long, runs {RUN_SCHEMA}, collapsed string")
