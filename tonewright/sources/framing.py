"""Framing: encoded bytes to frames.

``Framer`` is the small state machine that both forms share: the batch source
runs one per stream row, the streaming operator keeps its state between micro-batches. It
finds frames and nothing else; what a frame holds is read by expressions and by
``sources.sideinfo``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tables import BITRATES_LSF, BITRATES_MPEG1, SAMPLE_RATES

MAX_FREE = 8192
FRAME_SCHEMA = "stream_id string, frame_no bigint, position bigint, kind string, bytes binary"


@dataclass(frozen=True)
class Head:
    """What framing needs of a header."""

    key: tuple[int, int, int, bool]
    mode: int
    length: int | None
    slot: int
    padding: int
    least: int


def read_head(data: bytes | bytearray, at: int) -> Head | None:
    """The header at a position, or None if it is none or holds reserved values."""
    if at + 4 > len(data):
        return None
    w = int.from_bytes(data[at : at + 4], "big")
    version, layer_code, bitrate, rate = w >> 19 & 3, w >> 17 & 3, w >> 12 & 15, w >> 10 & 3
    if w >> 21 != 2047 or version == 1 or layer_code == 0 or bitrate == 15 or rate == 3 or w & 3 == 2:
        return None
    padding, crc = w >> 9 & 1, not w >> 16 & 1
    bits = (BITRATES_MPEG1 if version == 3 else BITRATES_LSF)[3 - layer_code][bitrate] * 1000
    hertz = SAMPLE_RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    if not bits:
        length = None
    elif layer_code == 3:
        length = (12 * bits // hertz + padding) * 4
    else:
        length = (72 if layer_code == 1 and version != 3 else 144) * bits // hertz + padding
    return Head((version, layer_code, rate, bits == 0), w >> 6 & 3, length, 4 if layer_code == 3 else 1, padding, 6 if crc else 4)


@dataclass
class Framer:
    """Feed bytes, get (position, kind, bytes): kind is audio, or truncated for a last frame padded with zeros."""

    strict: bool = False
    buffer: bytearray = field(default_factory=bytearray)
    base: int = 0
    locked: tuple | None = None
    free: int | None = None
    skipped: int = 0

    def feed(self, data: bytes, last: bool = False) -> list[tuple[int, str, bytes]]:
        self.buffer += data
        found: list[tuple[int, str, bytes]] = []
        at = 0
        while (step := self._step(at, False, found)) is not None:
            at = step
        if last:
            while (step := self._step(at, True, found)) is not None:
                at = step
            self.skipped += len(self.buffer) - at
            at = len(self.buffer)
        del self.buffer[:at]
        self.base += at
        return found

    def _pass(self, at: int, to: int, silently: bool = False) -> int:
        if self.strict and self.locked and to > at and not silently:
            raise ValueError(f"{to - at} bytes between frames at {self.base + at}")
        self.skipped += to - at
        return to

    def _tag_end(self, at: int) -> int | None:
        """Where a leading tag at a position ends; the position where it is none; None while its header is incomplete."""
        head = self.buffer[at : at + 10]
        if not head.startswith(b"ID3"):
            return at
        if len(head) < 10:
            return None
        if max(head[6:10]) >= 128:
            return at
        size = head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]
        return at + 10 + size + (10 if head[5] & 16 else 0)

    def _step(self, at: int, last: bool, found: list) -> int | None:
        """One move from a position: over a tag, over noise, or over a frame; None to wait for more."""
        data = self.buffer
        if data[at : at + 3] == b"ID3":
            end = self._tag_end(at)
            if end is None and not last:
                return None
            if end is None or end == at:
                return self._pass(at, at + 3, silently=True)
            return self._pass(at, end, silently=True) if end <= len(data) else None
        sync = data.find(0xFF, at)
        while 0 <= sync < len(data) - 1 and data[sync + 1] & 0xE0 != 0xE0:
            sync = data.find(0xFF, sync + 1)
        if sync != at:
            stop = len(data) - (data[-1:] == b"\xff") if sync < 0 or sync == len(data) - 1 else sync
            tag = data.find(b"ID3", at + 1, stop)
            stop = tag if tag > 0 else stop
            if stop == len(data) and not last:  # a tag may begin here
                stop -= 2 if data.endswith(b"ID") else data.endswith(b"I")
            if stop <= at:
                return None
            if self.strict and self.locked and sync < 0 and not last:
                return None  # it may be a tag at the end
            trailing = data.startswith((b"TAG", b"APETAGEX", b"LYRICS"), at)
            return self._pass(at, stop, silently=trailing or last and sync < 0)
        head = read_head(data, at)
        if len(data) < at + 4:
            return None
        if head is None or self.locked not in (None, head.key):
            return self._pass(at, at + 1)
        length = self._length(head, at, last)
        if length is None:
            return self._pass(at, at + 1) if len(data) - at > MAX_FREE else None
        if length < head.least + 2:
            return self._pass(at, at + 1)
        if len(data) < at + length:
            if last and self.locked and len(data) - at > head.least + 8:
                found.append((0, "truncated", bytes(data[at:]) + bytes(at + length - len(data))))
                return len(data)
            return None
        if self.locked is None:
            if len(data) < at + length + 4:
                if not last:
                    return None
            else:
                following = read_head(data, at + length)
                if following is None or following.key != head.key:
                    return self._pass(at, at + 1)
        self.locked = head.key
        found.append((self.base + at, "audio", bytes(data[at : at + length])))
        return at + length

    def _length(self, head: Head, at: int, last: bool) -> int | None:
        """A frame's length; of a free-format stream, measured once to the next header of the same stream and mode."""
        if head.length is not None:
            return head.length
        if self.free is not None:
            return self.free + head.padding * head.slot
        data, i = self.buffer, at + head.least + 4
        while 0 <= (i := data.find(0xFF, i)) < min(len(data) - 3, at + MAX_FREE):
            other = read_head(data, i)
            if other and other.key == head.key and other.mode == head.mode and (i - at - head.padding * head.slot) % head.slot == 0:
                self.free = i - at - head.padding * head.slot
                return i - at
            i += 1
        return len(data) - at if last and len(data) - at > head.least + 4 else None


def _frames_of(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream_id", "frame_no", "position", "kind", "bytes"]
        for b in batches:
            for stream, content in zip(b.column(0).to_pylist(), b.column(1)):
                found = Framer(strict).feed(content.as_py() or b"", last=True)
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    cols = [pa.array([stream] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), *(pa.array(list(c)) for c in zip(*part))]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def frames(streams: DataFrame, strict: bool = False) -> DataFrame:
    """(stream_id, content) to one row per frame; streams without frames have none. strict raises on bytes between frames."""
    rows = streams.select(F.col("stream_id").cast("string"), F.col("content").cast("binary"))
    return rows.mapInArrow(_frames_of(strict), FRAME_SCHEMA)


def stream_facts(streams: DataFrame, strict: bool = False) -> DataFrame:
    """(stream_id, content) to one row per stream: frames, bytes in frames, bytes skipped (tags and noise), whether the last frame is cut short, and the frame length of a free-format stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("stream_id", pa.string()), ("frames", pa.int64()), ("audio_bytes", pa.int64()), ("skipped_bytes", pa.int64()), ("truncated", pa.bool_()), ("free_length", pa.int32())]
        for b in batches:
            rows = []
            for stream, content in zip(b.column(0).to_pylist(), b.column(1)):
                framer = Framer(strict)
                found = framer.feed(content.as_py() or b"", last=True)
                cut = bool(found) and found[-1][1] == "truncated"
                rows.append((stream, len(found), sum(len(f[2]) for f in found), framer.skipped, cut, framer.free))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[n for n, _ in kinds])

    rows = streams.select(F.col("stream_id").cast("string"), F.col("content").cast("binary"))
    return rows.mapInArrow(run, "stream_id string, frames bigint, audio_bytes bigint, skipped_bytes bigint, truncated boolean, free_length int")


def read_audio(spark: SparkSession, path: str, pattern: str = "*.{mp1,mp2,mp3,mpa}") -> DataFrame:
    """Streams of a folder: (stream_id, content); path and size filters reach the file listing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("stream_id"), "content")


STATE_SCHEMA = "buffer binary, base bigint, frame_no bigint, locked array<int>, free int, skipped bigint, waiting map<bigint, binary>, next bigint"


def stream_frames(chunks: DataFrame) -> DataFrame:
    """Streaming (stream_id, chunk_no, bytes, last) to frames, whatever the chunking.

    Kept per stream: unconsumed bytes, position, lock, and chunks that came before their
    turn. ``last`` ends a stream. There is no event time, so no watermark.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        framer, frame_no, waiting, turn = Framer(), 0, {}, 0
        if state.exists:
            buffer, base, frame_no, locked, free, skipped, waiting, turn = state.get
            framer = Framer(buffer=bytearray(buffer), base=base, locked=(*locked[:3], bool(locked[3])) if locked else None, free=free, skipped=skipped)
            waiting = dict(waiting)
        end = None
        for p in parts:
            for r in p.itertuples():
                waiting[int(r.chunk_no)] = bytes(r.bytes or b"")
                end = int(r.chunk_no) if r.last else end
        if end is not None:
            waiting[-1] = end.to_bytes(8, "big")
        end = int.from_bytes(waiting[-1], "big") if -1 in waiting else None
        found = []
        while turn in waiting:
            found += framer.feed(waiting.pop(turn), last=turn == end)
            turn += 1
        if end is not None and turn > end:
            state.remove()
        else:
            state.update((bytes(framer.buffer), framer.base, frame_no + len(found), [int(x) for x in framer.locked] if framer.locked else None, framer.free, framer.skipped, waiting, turn))
        if found:
            yield pd.DataFrame({"stream_id": key[0], "frame_no": range(frame_no, frame_no + len(found)), "position": [f[0] for f in found], "kind": [f[1] for f in found], "bytes": [f[2] for f in found]})

    return chunks.groupBy("stream_id").applyInPandasWithState(step, FRAME_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
