"""Words of many texts at once, as spans of their UTF-8 bytes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken in portions of about so many bytes; a longer text goes alone.
PORTION_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of a portion: byte spans, the row of each, and how many each row has."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    per_row: np.ndarray


def portions(texts: pa.Array, most: int = PORTION_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row offsets of each portion of a string array; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, len(texts))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> Words:
    """Runs of bytes that ``in_word`` (256 flags) marks; a run ends with its row."""
    rows = len(offsets) - 1
    inside = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, start, end, row, np.bincount(row, minlength=rows))


class Hasher:
    """64-bit hashes of byte spans from prefix sums; powers are made once and grow as needed."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = 1 << n.bit_length()
            self._up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _BASE))))
            self._down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, _INVERSE))))
        return self._up, self._down

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ``values[start:end]``: equal spans have equal hashes wherever they lie."""
        up, down = self._powers(len(values) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)])))
        return mixed((sums[end] - sums[start]) * down[start])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def row_sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (along the first axis) for runs of ``per_row`` entries, zero for empty ones."""
    out = np.zeros((len(per_row), *values.shape[1:]), values.dtype)
    full = np.flatnonzero(per_row)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(per_row[full])[:-1]))
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out
