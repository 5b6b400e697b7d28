"""The 32-band polyphase filterbank over ordered slots, in chunks that bring the fifteen slots before them along.

A slot's output depends on itself and the fifteen before, so no state is kept: a stream spreads over tasks by chunks, of which
each copies so many slots of the one before. Slots are numbered from 0 without gaps. The
prototype is a parameter of 512 values; ``designed_prototype`` gives one by formula.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from . import ordered

BANDS, TAPS, SLOTS = 32, 512, 16
#: Slots of a chunk: sixty-four granules.
CHUNK = 1152


def designed_prototype() -> np.ndarray:
    """A root-raised-cosine low-pass of 512 taps, signs turned in every other 64, scaled for unit gain of analysis and synthesis."""
    t = (np.arange(TAPS) - TAPS / 2) / (2 * BANDS)
    edge = 1 - (4 * t) ** 2
    h = np.where(np.abs(edge) < 1e-9, np.pi / 4, np.cos(2 * np.pi * t) / np.where(np.abs(edge) < 1e-9, 1.0, edge))
    return 4 / np.pi * h * np.where(np.arange(TAPS) // (2 * BANDS) % 2, -1.0, 1.0)


def load_prototype(path: str) -> np.ndarray:
    """512 values, or the first 257 of them, from a JSON list; ValueError unless the magnitudes are symmetric about the middle.

    Of 257 values the rest follows: the same magnitudes backwards, with the signs turned in every other 64.
    """
    with open(path, encoding="utf-8") as f:
        d = np.array(json.load(f), dtype=float)
    if d.shape not in ((257,), (512,)):
        raise ValueError(f"512 or 257 values, not {d.shape}")
    if len(d) == 257:
        turn = np.where(np.arange(1, 256) // 64 % 2, 1.0, -1.0) * np.where((TAPS - np.arange(1, 256)) // 64 % 2, 1.0, -1.0)
        d = np.r_[d, (d[1:256] * turn)[::-1]]
    if not np.allclose(np.abs(d[1:256]), np.abs(d[:256:-1])):
        raise ValueError("the prototype is not symmetric")
    return d


@lru_cache(maxsize=1)
def _synthesis_matrix() -> np.ndarray:
    i, k = np.arange(64)[:, None], np.arange(BANDS)[None, :]
    return np.cos((16 + i) * (2 * k + 1) * np.pi / 64)


@lru_cache(maxsize=1)
def _analysis_matrix() -> np.ndarray:
    k, i = np.arange(BANDS)[:, None], np.arange(64)[None, :]
    return np.cos((2 * k + 1) * (i - 16) * np.pi / 64)


def shifted(x: np.ndarray, k: int, n: int) -> np.ndarray:
    """The rows k before the last n."""
    return x[len(x) - n - k : len(x) - k]


def synthesise_run(x: np.ndarray, prototype: np.ndarray) -> np.ndarray:
    """Subband slots in a row, the first fifteen of which come before, to the samples of the others. A slot's value does not depend on how many are asked for."""
    n, w = len(x) - SLOTS + 1, prototype.reshape(8, 64)
    v = np.einsum("nk,ik->ni", x, _synthesis_matrix())
    out = np.zeros((n, BANDS))
    for j in range(8):
        out += shifted(v, 2 * j, n)[:, :BANDS] * w[j, :BANDS] + shifted(v, 2 * j + 1, n)[:, BANDS:] * w[j, BANDS:]
    return out


def analyse_run(x: np.ndarray, prototype: np.ndarray) -> np.ndarray:
    """Blocks of samples in a row, the first fifteen of which come before, to the subbands of the others."""
    n, c = len(x) - SLOTS + 1, (prototype / BANDS).reshape(SLOTS, BANDS)
    z = np.zeros((n, 2 * BANDS))
    for j in range(SLOTS):  # newest first
        z[:, j % 2 * BANDS : j % 2 * BANDS + BANDS] += shifted(x, j, n)[:, ::-1] * c[j]
    return np.einsum("ni,ki->nk", z, _analysis_matrix())


def synthesise_slots(history: np.ndarray, prototype: np.ndarray) -> np.ndarray:
    """(n, 16, 32) subband slots, newest last, to (n, 32) samples."""
    return np.concatenate([synthesise_run(h, prototype) for h in history]) if len(history) else np.zeros((0, BANDS))


def analyse_blocks(history: np.ndarray, prototype: np.ndarray) -> np.ndarray:
    """(n, 16, 32) blocks of samples, newest last, to (n, 32) subbands."""
    return np.concatenate([analyse_run(h, prototype) for h in history]) if len(history) else np.zeros((0, BANDS))


def _banked(rows: DataFrame, keys: list[str], by: str, value: str, step, prototype: np.ndarray) -> DataFrame:
    prototype = np.asarray(prototype, dtype=float)
    cut = ordered.with_halo(rows.select(*keys, by, value), keys, by, CHUNK, SLOTS - 1)
    cut = cut.select(*keys, ordered.CHUNK, by, value)
    schema = T.StructType([*(cut.schema[k] for k in (*keys, by)), T.StructField(value, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for b in ordered.runs(batches, n + 1):
            own = int((b.column(n + 1).to_numpy() // CHUNK == b.column(n)[0].as_py()).sum())  # those of the chunk before stand first
            if own:
                x = ordered.matrix(b.column(n + 2), BANDS)
                x = np.r_[np.zeros((max(0, own + SLOTS - 1 - len(x)), BANDS)), x]
                mine = b.slice(b.num_rows - own)
                out = step(x[len(x) - own - SLOTS + 1 :], prototype).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(mine.column(k) for k in range(n)), mine.column(n + 1), ordered.lists(out)], names=[*keys, by, value])

    return cut.mapInArrow(run, schema)


def synthesise(subbands: DataFrame, keys: list[str], by: str, value: str, prototype: np.ndarray) -> DataFrame:
    """(keys, by, value: 32 subbands) to (keys, by, value: 32 samples); slots before the first are silence."""
    return _banked(subbands, keys, by, value, synthesise_run, prototype)


def analyse(blocks: DataFrame, keys: list[str], by: str, value: str, prototype: np.ndarray) -> DataFrame:
    """(keys, by, value: 32 samples) to (keys, by, value: 32 subbands)."""
    return _banked(blocks, keys, by, value, analyse_run, prototype)
