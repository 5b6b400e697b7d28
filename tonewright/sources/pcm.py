"""Samples from files: WAV (16, 24 and 32-bit integers, 32-bit floats, extensible) and raw 16-bit little-endian, as slots of 32 samples.

A file is one row of ``binaryFile`` and one task's work; its slots leave in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SLOT = 32
SCHEMA = "stream_id string, rate int, channel int, slot bigint, samples bigint, s array<float>, error string"
_INTEGER, _FLOAT, _EXTENSIBLE = 1, 3, 0xFFFE


def wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (n x channels, full scale 1) of a WAV file; ValueError for what is none. A data chunk cut short gives its whole samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            if len(body) < 16:
                raise ValueError("a format chunk of under 16 bytes")
            kind, channels, rate, bits = (int.from_bytes(body[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
            kind = int.from_bytes(body[24:26], "little") if kind == _EXTENSIBLE and len(body) >= 26 else kind
            form = kind, channels, rate, bits
        elif name == b"data":
            if form is None or not form[1]:
                raise ValueError("no format before the data")
            return form[2], pcm_samples(body, *form[:2], form[3])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pcm_samples(body: bytes, kind: int, channels: int, bits: int) -> np.ndarray:
    """Interleaved samples to (n x channels) floats."""
    width = bits // 8
    body = body[: len(body) // (width * channels) * width * channels] if width else b""
    if kind == _FLOAT and bits == 32:
        x = np.frombuffer(body, "<f4").astype(float)
    elif kind == _INTEGER and bits in (16, 32):
        x = np.frombuffer(body, f"<i{width}") / 2.0 ** (bits - 1)
    elif kind == _INTEGER and bits == 24:
        wide = np.zeros((len(body) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / 2.0**31
    else:
        raise ValueError(f"samples of kind {kind} with {bits} bits")
    return x.reshape(-1, channels)


def _slots(read):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("stream_id", pa.string()), ("rate", pa.int32()), ("channel", pa.int32()), ("slot", pa.int64()), ("samples", pa.int64()), ("s", pa.list_(pa.float32())), ("error", pa.string())])
        for b in batches:
            for stream, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    rate, x = read(content.as_py() or b"")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"stream_id": stream, "error": str(e)}], schema=kinds)
                    continue
                full = np.pad(x, ((0, -len(x) % SLOT), (0, 0))).astype(np.float32)
                for c in range(x.shape[1]):
                    slots = full[:, c].reshape(-1, SLOT)
                    for at in range(0, len(slots), 8192):
                        part = slots[at : at + 8192]
                        n = len(part)
                        cols = [[stream] * n, [rate] * n, [c] * n, np.arange(at, at + n), [len(x)] * n, list(part), [None] * n]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, kinds)], schema=kinds)

    return run


def wav_slots(files: DataFrame) -> DataFrame:
    """(stream_id, content) to (stream_id, rate, channel, slot, samples: of the stream, s: 32 samples, the last slot filled with zeros); a file that is refused has one row with its error."""
    return files.select(F.col("stream_id").cast("string"), F.col("content").cast("binary")).mapInArrow(_slots(wav_samples), SCHEMA)


def raw_slots(files: DataFrame, rate: int, channels: int = 2) -> DataFrame:
    """The same of interleaved 16-bit little-endian samples without a header."""
    read = lambda data: (rate, pcm_samples(data, _INTEGER, channels, 16))
    return files.select(F.col("stream_id").cast("string"), F.col("content").cast("binary")).mapInArrow(_slots(read), SCHEMA)


def mp4_samples(data: bytes) -> bytes:
    """The samples of an MP4 file's first track in one piece, by its sample sizes, chunk offsets and samples per chunk."""

    def boxes(lo: int, hi: int):
        while lo + 8 <= hi:
            size, name, head = int.from_bytes(data[lo : lo + 4], "big"), data[lo + 4 : lo + 8], 8
            if size == 1:
                size, head = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
            size = size or hi - lo
            if size < head:
                return
            yield name, lo + head, min(lo + size, hi)
            lo += size

    def inside(path: list[bytes], lo: int, hi: int) -> tuple[int, int]:
        for name, a, b in boxes(lo, hi):
            if name == path[0]:
                return inside(path[1:], a, b) if path[1:] else (a, b)
        raise ValueError(f"no box {path[0].decode('latin-1')}")

    table = inside([b"moov", b"trak", b"mdia", b"minf", b"stbl"], 0, len(data))
    word = lambda at, n=4: int.from_bytes(data[at : at + n], "big")
    at, _ = inside([b"stsz"], *table)
    sizes = [word(at + 4) or word(at + 12 + 4 * k) for k in range(word(at + 8))]
    names = {name: a for name, a, _ in boxes(*table)}
    if b"stco" not in names and b"co64" not in names:
        raise ValueError("no chunk offsets")
    at, wide = (names[b"stco"], 4) if b"stco" in names else (names[b"co64"], 8)
    offsets = [word(at + 8 + wide * k, wide) for k in range(word(at + 4))]
    at, _ = inside([b"stsc"], *table)
    runs = [(word(at + 8 + 12 * k), word(at + 12 + 12 * k)) for k in range(word(at + 4))]
    out, n = [], 0
    for chunk, start in enumerate(offsets, 1):
        per = next((count for first, count in reversed(runs) if first <= chunk), 0)
        for size in sizes[n : n + per]:
            out.append(data[start : start + size])
            start += size
        n += per
    return b"".join(out)


def mp4_streams(files: DataFrame) -> DataFrame:
    """(stream_id, content) of MP4 files to (stream_id, content) of their first track; a file without one has null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    found = mp4_samples(content.as_py() or b"")
                except ValueError:
                    found = None
                yield pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([found], pa.binary())], names=["stream_id", "content"])

    return files.select(F.col("stream_id").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "stream_id string, content binary")
