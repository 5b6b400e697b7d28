"""Texts of an Arrow column as one array of bytes, and their words as ranges of it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Texts(NamedTuple):
    """A run of rows: the first and the row after the last, their bytes, and where each text starts and the last ends."""

    first: int
    after: int
    data: np.ndarray
    edges: np.ndarray


class Words(NamedTuple):
    """Where each word starts and ends (after its last byte), and where each text's words start and the last's end."""

    starts: np.ndarray
    ends: np.ndarray
    edges: np.ndarray


def texts(column: pa.Array, most: int = CHUNK) -> Iterator[Texts]:
    """The rows in runs of about ``most`` bytes, at least one row each; null texts are empty. Texts are read where they lie, without a copy."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    width = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield Texts(row, to, whole[at[row] : at[to]], at[row : to + 1] - at[row])
        row = to


def words(t: Texts) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text; none crosses texts."""
    solid = ~_SPACE[t.data]
    cuts = t.edges[(t.edges > 0) & (t.edges < len(t.data))]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    starts[cuts] = solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(starts, ends, np.searchsorted(starts, t.edges))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _FOLD[data]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_TABLE = mix(np.arange(1, 65537, dtype=np.uint64)) | np.uint64(1)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes; ranges are not empty, in order, and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = np.cumsum(size)
    inside = np.repeat(starts - (total - size), size) + np.arange(total[-1])
    off = inside - np.repeat(starts, size)
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * (_TABLE[off & 0xFFFF] + (off >> 16).astype(np.uint64) * np.uint64(2))
    return mix(np.add.reduceat(value, total - size) + size.astype(np.uint64) * _ODD)
