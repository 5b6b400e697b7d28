"""Layer III coding of analysed granules: rate control and frame assembly, one ordered pass per stream.

A stream's frames depend on each other through the reservoir, so they go through one task in
order; streams spread over tasks. Analysis and masks are done before, in parallel over
granules (``operators.analysis``). Memory holds one frame and at most the reservoir.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.encoding import reservoir_limit
from ..functions.tables import BITRATES_LSF, BITRATES_MPEG1, SAMPLE_RATES
from ..sources import sideinfo
from . import ordered
from .analysis import coded_order
from .layer3 import Codes, layout
from .quantiser import Books, Quantiser, granule_bits, packed


class Assembly:
    """Slots of frames in a row, and main data laid over them; a frame leaves when its slot is full."""

    def __init__(self, limit: int):
        self.limit, self.start, self.end = limit, 0, 0  # bytes of slots so far; where main data ends
        self.data = bytearray()
        self.waiting: list[tuple[int, bytes, int]] = []  # (slot start, header and side information, slot bytes)

    @property
    def tail(self) -> int:
        """Free bytes before the next frame's own slot that it may use."""
        return self.start - max(self.end, self.start - self.limit)

    def add(self, head, slot: int, main: bytes) -> list[bytes]:
        """head: function of main_data_begin to header and side information."""
        begin = self.tail
        at = self.start - begin
        self.data += bytes(at - self.end) + main
        self.end = at + len(main)
        self.waiting.append((self.start, head(begin), slot))
        self.start += slot
        return self.leave(final=False)

    def leave(self, final: bool) -> list[bytes]:
        out = []
        while self.waiting and (final or self.waiting[0][0] + self.waiting[0][2] <= max(self.end, self.start - self.limit)):
            at, head, slot = self.waiting.pop(0)
            part = bytes(self.data[:slot])
            out.append(head + part + bytes(slot - len(part)))
            del self.data[:slot]
            if at + slot > self.end:
                self.end = at + slot
        return out


def entropy(parts: list[tuple], rate: int) -> float:
    """Perceptual entropy of granules of a frame: bits that their energies over their allowances ask for."""
    total = 0.0
    for t, x, allowed in parts:
        band, window = layout(rate, int(t == 2))
        cell = band * 3 + np.maximum(window, 0) if t == 2 else band
        e, n = np.bincount(cell, weights=x * x, minlength=len(allowed)), np.bincount(cell, minlength=len(allowed))
        over = e > allowed
        total += float((n[over] * np.log2(1 + np.sqrt(e[over] / np.maximum(allowed[over], 1e-30)))).sum())
    return total


def as_mid_side(parts: list[tuple]) -> list[tuple]:
    """Granules of two channels as sum and difference under the lower of both allowances."""
    out = []
    for (t, l, a), (_, r, b) in zip(parts[::2], parts[1::2]):
        out += [(t, (l + r) / 2**0.5, np.minimum(a, b)), (t, (l - r) / 2**0.5, np.minimum(a, b))]
    return out


class FrameEncoder:
    """Granules of a stream in order to frames; what is kept between them is the assembly and the padding's remainder.

    kbps: the constant rate; None: each frame takes the first rate that, with half the reservoir, holds its bits at the mask.
    joint: frames of two channels go as mid and side where that asks for fewer bits.
    """

    def __init__(self, books: Books, rate: int, kbps: int | None, joint: bool):
        self.books, self.rate, self.kbps, self.joint = books, rate, kbps, joint
        self.lsf = rate < 32000
        self.granules = 1 if self.lsf else 2
        self.version = 3 if rate >= 32000 else 2 if rate >= 16000 else 0
        self.table = (BITRATES_LSF if self.lsf else BITRATES_MPEG1)[2]
        self.assembly, self.remainder = Assembly(255 if self.lsf else 511), 0

    def _target(self, demand: int, slot: int) -> int:
        a = self.assembly
        avail, mean, room = 8 * (a.tail + slot), 8 * slot, 8 * (a.limit - a.tail)
        if self.kbps is None:
            return min(demand, avail)
        return min(min(demand, mean + 8 * a.tail * 6 // 10) if demand > mean else max(demand, mean - room), avail)

    def add(self, parts: list[tuple]) -> list[bytes]:
        """A frame's granules (block_type, lines in bit-stream order, allowance), channel by channel, to the frames that leave."""
        channels, a, padding = len(parts) // self.granules, self.assembly, 0
        sides = as_mid_side(parts) if self.joint and channels == 2 else None
        ms = sides is not None and entropy(sides, self.rate) < entropy(parts, self.rate)
        parts = sides if ms else parts
        side = (9 if channels == 1 else 17) if self.lsf else (17 if channels == 1 else 32)
        whole = lambda k: (72 if self.lsf else 144) * self.table[k] * 1000
        quantiser = Quantiser(parts, self.rate, self.books)
        if self.kbps is None:
            need = sum(q["part2_3_length"] for q in quantiser.fit(lambda n: n))
            index = next((k for k in range(1, 15) if 8 * (whole(k) // self.rate - 4 - side) + 4 * a.tail >= need), 14)
        else:
            index = self.table.index(self.kbps)
            self.remainder += whole(index) % self.rate
            padding = int(self.remainder >= self.rate)
            self.remainder -= self.rate * padding
        a.limit = reservoir_limit(self.lsf, whole(index) // self.rate + padding)
        mode = 3 if channels == 1 else 1 if ms else 0
        word = 2047 << 21 | self.version << 19 | 1 << 17 | 1 << 16 | index << 12 | SAMPLE_RATES.index(self.rate * {3: 1, 2: 2, 0: 4}[self.version]) << 10 | padding << 9 | mode << 6 | (2 << 4 if ms else 0)
        slot = whole(index) // self.rate + padding - 4 - side
        rows, bits = [], []
        for n, ((t, *_), q) in enumerate(zip(parts, quantiser.fit(lambda demand: self._target(demand, slot)))):
            bits.append(granule_bits(q, self.rate, t, self.books))
            rows.append({k: int(q[k]) for k in ("part2_3_length", "big_values", "global_gain", "scalefac_compress", "region0_count", "region1_count", "count1_table", "preflag", "scalefac_scale")})
            rows[-1] |= {"table_select": [int(self.books.numbers[k]) if k >= 0 else 0 for k in q["tables"]], "subblock_gain": q["subblock_gain"].tolist(), "window_switching": int(t > 0), "block_type": int(t), "mixed_block": 0, "scfsi": [0, 0, 0, 0], "granule": n // channels, "channel": n % channels}
        main = packed(*(np.concatenate(c) for c in zip(*bits)))
        return a.add(lambda begin: word.to_bytes(4, "big") + sideinfo.pack([r | {"main_data_begin": begin} for r in rows], self.lsf, channels == 1), slot, main)

    def finish(self) -> list[bytes]:
        return self.assembly.leave(final=True)


def encode(granules: DataFrame, codes: Codes, rate: int, kbps: int | None, joint: bool = False) -> DataFrame:
    """(stream_id, granule, channel, block_type, x: lines in subband order, allowed) to frames (stream_id, frame_no, bytes).

    Every granule has all channels of its stream; an odd last granule of MPEG-1 is dropped.
    """
    shared = granules.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = Books(shared.value)
        stream, held, frames, n, done = None, [], None, 0, []

        def emit(made: list[bytes]) -> None:
            nonlocal n
            for f in made:
                done.append((stream, n, f))
                n += 1

        def close():
            if held and len({g for g, _ in held}) == frames.granules:
                emit(frames.add([p for _, p in held]))
            if frames is not None:
                emit(frames.finish())

        for b in batches:
            lines = [np.asarray(x.values, float) for x in b.column(4)]
            for sid, granule, t, x, allowed in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), lines, b.column(5)):
                if frames is None or sid != stream:
                    close()
                    stream, held, frames, n = sid, [], FrameEncoder(books, rate, kbps, joint), 0
                if held and granule != held[-1][0] and granule % frames.granules == 0:
                    emit(frames.add([p for _, p in held]))
                    held = []
                held.append((granule, (t, coded_order(x, rate, t), np.asarray(allowed.values, float))))
            if len(done) > 256:
                yield _rows(done)
                done.clear()
        close()
        if done:
            yield _rows(done)

    rows = granules.select("stream_id", F.col("granule").cast("bigint"), F.col("channel").cast("int"), F.col("block_type").cast("int"), "x", "allowed")
    return ordered.in_order(rows, ["stream_id"], "granule", "channel").mapInArrow(run, "stream_id string, frame_no bigint, bytes binary")


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["stream_id", "frame_no", "bytes"])
