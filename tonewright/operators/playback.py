"""Layer III frames in order: reservoir, accounting and the two kinds of silence, and what follows in parallel.

    StreamState   what passes from frame to frame of a stream; both forms of the decoder use it
    ordered_rows  frames to granules of lines, a stream's frames in order
    played        granules to samples, in chunks with two granules of look-back

A frame whose main data lies before the stream is silence through the transforms: the tails of what came before play out, and its bytes enter the reservoir. Any other frame that
cannot be read stands outside: its time is exact zeros and neither overlap nor filterbank see it; so granules have a place in the filterbank's sequence (``at``) beside
their time (``time``). Where the number of channels changes both start anew (``part``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.sideinfo import parse
from . import filterbank, ordered
from .huffman import Words, spectra
from .layer3 import RESERVOIR, Codes, crc_holds, header_facts, inverse_hybrid

#: Frames read together.
TOGETHER = 128
LINES = 576
CHUNK, HALO = 64, 2


@dataclass
class Played:
    """A frame's time and place in granules; rows (granule, channel, block_type, mixed, exact, lines) or none where it stands outside."""

    time: int
    granules: int
    channels: int
    part: int
    at: int
    rows: list[tuple]
    concealed: bool
    error: str | None
    bits: int
    exact: bool


@dataclass
class StreamState:
    """Reservoir, unused bytes of the frame before (None before the first), channels, and where in time and in the filterbank's sequence the next frame stands."""

    reservoir: bytes = b""
    unused: int | None = None
    channels: int = 0
    part: int = 0
    at: int = 0
    time: int = 0

    def feed(self, frames: list[bytes], words: Words, check_crc: bool = False, strict: bool = False) -> list[Played]:
        """Frames in order. ``strict`` checks CRCs and raises ValueError for what cannot be read or does not add up."""
        read, asked, order = [], [], []
        for f in frames:
            try:
                side = parse(f)
                if (check_crc or strict) and not crc_holds(f):
                    raise ValueError("the frame CRC does not match")
            except (ValueError, IndexError) as e:
                read.append((f, None, None, str(e)))
                continue
            own, begin = f[header_facts(f)["start"] :], side[0]["main_data_begin"]
            main = self.reservoir[len(self.reservoir) - begin :] + own if begin <= len(self.reservoir) else None
            self.reservoir = (self.reservoir + own)[-RESERVOIR:]
            read.append((f, side, main, None))
            if main is not None:
                order.append(len(read) - 1)
                asked.append((f, side, main))
        got = dict(zip(order, spectra(asked, words)))
        out = []
        for k, (f, side, main, error) in enumerate(read):
            facts, s = header_facts(f), got.get(k)
            n, channels = 1 if facts["lsf"] else 2, facts["channels"]
            error = error or (s.error if s else "main_data_begin points before the start of the stream")
            tails = side is not None and main is None
            rows = s.rows if s and not s.error else [(g, c, 0, 0, False, np.zeros(LINES)) for g in range(n) for c in range(channels)] if tails else []
            doubt = error or self._accounts(side[0]["main_data_begin"], len(f) - facts["start"], s.bits, s.exact)
            if strict and doubt:
                raise ValueError(f"{doubt} (at granule {self.time})")
            if rows and channels != self.channels:
                self.part, self.at, self.channels = self.part + (self.channels > 0), 0, channels
            out.append(Played(self.time, n, channels, self.part, self.at, rows, error is not None, doubt, s.bits if s else 0, bool(s and s.exact)))
            self.time += n
            self.at += n if rows else 0
        return out

    def _accounts(self, begin: int, own: int, bits: int, exact: bool) -> str | None:
        """What does not add up; the unused bytes are kept for the next frame."""
        unused, self.unused = self.unused, (8 * (begin + own) - bits) // 8
        if not exact:
            return "codes do not end at part2_3_length"
        if unused is None and begin:
            return "the first frame's main_data_begin is not 0"
        if unused is not None and begin > unused:
            return f"main_data_begin {begin} reaches into the frame before, of which {unused} bytes are unused"
        return None


_ROWS = "stream_id string, part int, channel int, at bigint, time bigint, block_type int, mixed int, x array<float>, concealed boolean"
_REPORT = "stream_id string, frame_no bigint, concealed boolean, error string, bits bigint, exact boolean"


def _by_stream(batches: Iterator[pa.RecordBatch], words: Words, check_crc: bool, strict: bool) -> Iterator[tuple[str, list[int], list[Played]]]:
    stream, state = None, StreamState()
    for b in batches:
        for part in (b.slice(at, TOGETHER) for at in range(0, b.num_rows, TOGETHER)):
            for run in ordered.runs(iter([part]), 1):
                sid = run.column(0)[0].as_py()
                if sid != stream:
                    stream, state = sid, StreamState()
                yield sid, run.column(1).to_pylist(), state.feed([f.as_py() for f in run.column(2)], words, check_crc, strict)


def _ordered(frames: DataFrame) -> DataFrame:
    return ordered.in_order(frames.select("stream_id", "frame_no", "bytes"), ["stream_id"], "frame_no")


def ordered_rows(frames: DataFrame, codes: Codes, check_crc: bool = False, strict: bool = False) -> DataFrame:
    """(stream_id, frame_no, bytes) of Layer III frames to a row per granule and channel; x is null where a frame stands outside."""
    shared = frames.sparkSession.sparkContext.broadcast(codes)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.bool_()]
    names = [c.split()[0] for c in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for sid, _, done in _by_stream(batches, words, check_crc, strict):
            rows, lines = [], []
            for p in done:
                lines += [r[5] for r in p.rows]
                rows += [(sid, p.part, c, p.at + g, p.time + g, kind, int(mixed), p.concealed) for g, c, kind, mixed, _, _ in p.rows]
            for p in done:
                if not p.rows:
                    rows += [(sid, p.part, c, None, p.time + g, 0, 0, True) for g in range(p.granules) for c in range(p.channels)]
            if not rows:
                continue
            flat = pa.array(np.concatenate(lines).astype(np.float32) if lines else np.zeros(0, np.float32))
            edges = np.minimum(np.arange(len(rows) + 1), len(lines)) * LINES
            held = pa.ListArray.from_arrays(pa.array(np.r_[edges[:-1], edges[-1:]], pa.int32(), mask=np.r_[np.arange(len(rows)) >= len(lines), False]), flat)
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), k) for c, k in zip(cols[:7], kinds)), held, pa.array(list(cols[7]), pa.bool_())], names=names)

    return _ordered(frames).mapInArrow(run, _ROWS)


def report(frames: DataFrame, codes: Codes) -> DataFrame:
    """One row per Layer III frame: whether it is silence, what cannot be read or does not add up (as ``strict`` would raise), its bits, and whether all codes end where they should."""
    shared = frames.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for sid, numbers, done in _by_stream(batches, words, True, False):
            cols = [[sid] * len(done), numbers, [p.concealed for p in done], [p.error for p in done], [p.bits for p in done], [p.exact for p in done]]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _REPORT.split(", ")])

    return _ordered(frames).mapInArrow(run, _REPORT)


_TURN = np.where(np.arange(32)[:, None] % 2 * (np.arange(18) % 2) > 0, -1.0, 1.0)


def slots_of(x: np.ndarray, block_type: np.ndarray, mixed: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 576) lines of one channel's granules in a row to (18 n, 32) subband slots, single precision; before: the half granule that the one ahead left, and the last one's."""
    y = inverse_hybrid(x, block_type, mixed)
    tails = np.concatenate([before[None], y[:, :, 18:]])
    return ((y[:, :, :18] + tails[:-1]) * _TURN).swapaxes(1, 2).reshape(-1, 32).astype(np.float32), tails[-1]


@dataclass
class Voice:
    """What a channel's transforms keep."""

    overlap: np.ndarray = field(default_factory=lambda: np.zeros((32, 18)))
    slots: np.ndarray = field(default_factory=lambda: np.zeros((filterbank.SLOTS - 1, 32), np.float32))

    def play(self, x: np.ndarray, block_type: np.ndarray, mixed: np.ndarray, prototype: np.ndarray) -> np.ndarray:
        s, self.overlap = slots_of(x, block_type, mixed, self.overlap)
        return self.synthesise(s, prototype)

    def synthesise(self, s: np.ndarray, prototype: np.ndarray) -> np.ndarray:
        rows = np.r_[self.slots, s]
        self.slots = rows[len(rows) - filterbank.SLOTS + 1 :]
        return filterbank.synthesise_run(rows.astype(float), prototype).astype(np.float32)


def played(rows: DataFrame, prototype: np.ndarray) -> DataFrame:
    """``ordered_rows`` to (stream_id, channel, slot, s: 32 samples, concealed)."""
    prototype = np.asarray(prototype, float)
    schema = "stream_id string, channel int, slot bigint, s array<float>, concealed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ordered.runs(batches, 4):
            own = int((b.column(4).to_numpy() // CHUNK == b.column(3)[0].as_py()).sum())
            if not own:
                continue
            x = ordered.matrix(b.column(8), LINES)
            pcm = Voice().play(x, b.column(6).to_numpy(), b.column(7).to_numpy(), prototype)[-18 * own :]
            mine = b.slice(b.num_rows - own)
            each = pa.array(np.repeat(np.arange(own), 18))
            slot = (mine.column(5).to_numpy()[:, None] * 18 + np.arange(18)).reshape(-1)
            yield pa.RecordBatch.from_arrays([mine.column(0).take(each), mine.column(2).take(each), pa.array(slot), ordered.lists(pcm), mine.column(9).take(each)], names=["stream_id", "channel", "slot", "s", "concealed"])

    inside = ordered.with_halo(rows.where("at IS NOT NULL"), ["stream_id", "part", "channel"], "at", CHUNK, HALO)
    sound = inside.select("stream_id", "part", "channel", ordered.CHUNK, "at", "time", "block_type", "mixed", "x", "concealed").mapInArrow(run, schema)
    silent = rows.where("at IS NULL").select("stream_id", "channel", F.explode(F.sequence(F.col("time") * 18, F.col("time") * 18 + 17)).alias("slot"))
    return sound.unionByName(silent.withColumns({"s": F.array_repeat(F.lit(0.0).cast("float"), 32), "concealed": F.lit(True)}))
