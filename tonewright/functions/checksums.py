"""The two CRC-16s of an audio stream, and FNV-1a, over binary columns.

A fold over bytes has no built-in form; here the bytes of an Arrow batch, as they lie there, go through array operations, CHUNK bytes at a time,
so that neither the rows of a batch nor the length of a value sets the memory or the number of steps.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

FRAME_POLY, ARC_POLY = 0x8005, 0xA001
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211
#: Bytes that are folded together, and bytes of a run whose parts of a CRC are summed.
CHUNK, RUN = 1 << 16, 256


@lru_cache(maxsize=2)
def crc_table(reflected: bool) -> np.ndarray:
    """What eight steps make of each byte: of the reflected polynomial, or most significant bit first."""
    v = np.arange(256, dtype=np.int64) << (0 if reflected else 8)
    for _ in range(8):
        v = np.where(v & 1, v >> 1 ^ ARC_POLY, v >> 1) if reflected else np.where(v & 0x8000, v << 1 ^ FRAME_POLY, v << 1) & 0xFFFF
    return v


def fold(data: pa.Array, start: int, kind: type, pieces) -> np.ndarray:
    """The fold of each value's bytes from start on; nulls as empty.

    pieces(bytes, sizes, states) folds pieces that lie one behind the other. It gets CHUNK bytes at a time, so a value
    may come in many pieces and a piece may be as short as a byte; none is empty.
    """
    wide = pa.types.is_large_binary(data.type)
    _, at, flat = data.buffers()
    state = np.full(len(data), start, kind)
    if not len(data) or flat is None:
        return state
    at = np.frombuffer(at, np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    flat = np.frombuffer(flat, np.uint8)
    for low in range(int(at[0]), int(at[-1]), CHUNK):
        high = min(low + CHUNK, int(at[-1]))
        k = np.arange(np.searchsorted(at[1:], low, side="right"), np.searchsorted(at[:-1], high, side="left"))
        size = np.minimum(at[k + 1], high) - np.maximum(at[k], low)
        k, size = k[size > 0], size[size > 0]
        state[k] = pieces(flat[low:high], size, state[k])
    return state


@lru_cache(maxsize=2)
def _zeros(reflected: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a byte becomes in a register of zero, and each half of a register, once k more zero bytes have gone by, k up to RUN."""
    table = crc_table(reflected)
    step = (lambda c: c >> 8 ^ table[c & 0xFF]) if reflected else (lambda c: c << 8 & 0xFFFF ^ table[c >> 8])
    v = np.arange(256)
    byte, half = [table], [np.stack([v, v << 8])]
    for _ in range(RUN):
        byte.append(step(byte[-1]))
        half.append(step(half[-1]))
    return np.stack(byte).astype(np.int32), np.stack(half).astype(np.int32)


def _crc_pieces(reflected: bool):
    """A CRC is linear: each byte counts by its distance from the end of its run alone, and registers are moved on from run to run."""

    def pieces(b: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        byte, half = _zeros(reflected)
        runs = -(-size // RUN)
        first_run = np.cumsum(runs) - runs
        length = np.full(int(runs.sum()), RUN)
        length[first_run] = size - (runs - 1) * RUN
        ends = np.cumsum(length)
        at = np.repeat(ends - 1, length) - np.arange(len(b))
        sums = np.bitwise_xor.reduceat(byte[at, b], ends - length)
        order = np.argsort(-runs, kind="stable")
        state, live = state.copy(), np.searchsorted(-runs[order], -np.arange(int(runs.max())), side="left")
        for k, n in enumerate(live.tolist()):
            who = order[:n]
            run, c = first_run[who] + k, state[who]
            state[who] = half[length[run], 0, c & 0xFF] ^ half[length[run], 1, c >> 8] ^ sums[run]
        return state

    return pieces


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, FNV_PRIME, np.uint64)], dtype=np.uint64)


def _running_xor(v: np.ndarray) -> None:
    """Each byte becomes the xor of all up to it; eight go as one number."""
    w = v.view("<u8")
    for k in (8, 16, 32):
        w ^= w << np.uint64(k)
    w[1:] ^= np.bitwise_xor.accumulate(w >> np.uint64(56))[:-1] * np.uint64(0x0101010101010101)


def _fnv_pieces(b: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """FNV-1a without a step a byte.

    A byte changes the eight low bits of the state alone, so the end is the sum of these changes times powers of the prime. The low bits
    depend on nothing above them: bit j of a state xor its byte is the byte's bit, the same bit a byte before and what the product carries
    into it from lower ones, so with the lower bits known it is a running xor.
    """
    ends, n = np.cumsum(size), len(b)
    first = ends - size
    x, start = np.zeros(-(-n // 8) * 8, np.uint8), b[first] ^ state.astype(np.uint8)
    for j in range(8):
        v = x * np.uint8(FNV_PRIME & 0xFF)
        v[1:n] = v[: n - 1] ^ b[1:]
        v[first] = start
        v &= np.uint8(1 << j)
        v[first[1:]] ^= np.bitwise_xor.reduceat(v, first)[:-1]  # each piece begins anew
        _running_xor(v)
        x |= v
    x = x[:n]
    change = (x.astype(np.int16) - (x ^ b)).astype(np.int64).view(np.uint64)
    powers = _powers()
    change *= powers[np.repeat(ends, size) - np.arange(n)]
    return state * powers[size] + np.add.reduceat(change, first)


def _result(data: pa.Array, out: pa.Array) -> pa.Array:
    return pc.if_else(data.is_valid(), out, pa.scalar(None, out.type))


@F.arrow_udf(T.IntegerType())
def _arc(data: pa.Array) -> pa.Array:
    return _result(data, pa.array(fold(data, 0, np.int32, _crc_pieces(True))))


@F.arrow_udf(T.IntegerType())
def _frame(data: pa.Array) -> pa.Array:
    return _result(data, pa.array(fold(data, 0xFFFF, np.int32, _crc_pieces(False))))


@F.arrow_udf(T.StringType())
def _fnv(data: pa.Array) -> pa.Array:
    return _result(data, pa.array(fold(data, FNV_START, np.uint64, _fnv_pieces)).cast(pa.string()))


def crc16_arc(data: Column) -> Column:
    """CRC-16/ARC: reflected polynomial, register zero; the checksum of tag frames."""
    return _arc(data)


def frame_crc(data: Column) -> Column:
    """The frame CRC over whole bytes: polynomial 0x8005, register all ones, most significant bit first."""
    return _frame(data)


def fnv1a_64(data: Column) -> Column:
    """FNV-1a over the bytes of a binary column, as an unsigned decimal."""
    return _fnv(data).cast("decimal(20,0)")
