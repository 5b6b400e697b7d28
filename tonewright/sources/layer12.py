"""Layer I and II frames to subband samples: one row per slot and channel.

A frame stands alone here (its only memory is the filterbank's, which
``operators.filterbank`` takes care of), so frames are read in any order and partition, and
frames of one layout go together, field by field as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.checksums import crc_table
from ..functions.tables import BITRATES_LSF, BITRATES_MPEG1, SAMPLE_RATES, SUBBANDS, allocation_row

SCHEMA = "stream_id string, frame_no bigint, slot int, channel int, s array<float>, error string"
GROUPED = {3: 5, 5: 7, 9: 10}
#: Which of the factors that were sent each third of a frame uses, and how many are sent, by scfsi.
THIRDS_OF = np.array([(0, 1, 2), (0, 0, 1), (0, 0, 0), (0, 1, 1)])
SENT = THIRDS_OF.max(1).astype(np.int32) + 1
#: The bits of a header that a layout depends on: version, layer, protection, bitrate, rate, mode and extension.
HEAD = 0x1FFCF0
#: Frames that are read together.
BLOCK = 128


@lru_cache(maxsize=None)
def levels(steps: int) -> np.ndarray:
    """The value of each code of a class."""
    full = 1 << (steps - 1).bit_length()
    return full / steps * (np.arange(full) / (full / 2) - 1 + (full - steps + 1) / full)


def scalefactors() -> np.ndarray:
    return 2.0 ** (1 - np.arange(63) / 3)


_FACTORS = scalefactors()


def layer2_table(lsf: bool, rate: int, bitrate: int, channels: int) -> str:
    per = bitrate // channels
    if lsf:
        return "LSF"
    if bitrate and per <= 48000:
        return "D" if rate == 32000 else "C"
    return "A" if bitrate and per <= 80000 or rate == 48000 else "B"


def frame_crc(crc: int, value: int, bits: int) -> int:
    """The frame CRC over ``bits`` bits of a number, most significant first."""
    for k in range(bits - 1, -1, -1):
        top = crc >> 15 ^ value >> k & 1
        crc = crc << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return crc


@lru_cache(maxsize=None)
def scale_levels() -> tuple[dict[int, int], np.ndarray]:
    """Where the values of each class begin, and the values of all classes on end; the first is that of a subband without bits."""
    starts, values = {0: 0}, [np.zeros(1)]
    for steps in sorted({(1 << n) - 1 for n in range(2, 17)} | set(GROUPED)):
        starts[steps] = sum(map(len, values))
        values.append(levels(steps))
    return starts, np.concatenate(values)


class Layout:
    """Where the fields of frames with like headers stand, and what their allocation indexes mean.

    A place is a subband of a channel, a field what is sent for it: above the bound one field stands for both channels.
    """

    def __init__(self, layer: int, channels: int, bound: int, table: str, protected: bool):
        rows = [allocation_row(table, sb) for sb in range(SUBBANDS[table])] if layer == 2 else [tuple((1 << n) - 1 for n in range(2, 16))] * 32
        self.layer, self.channels, self.subbands, self.protected, self.slots = layer, channels, len(rows), protected, 12 if layer == 1 else 36
        fields = [(sb, c) for sb in range(len(rows)) for c in range(channels if sb < bound else 1)]
        known = {at: k for k, at in enumerate(fields)}
        self.field_of = np.array([known[sb, c if sb < bound else 0] for sb in range(len(rows)) for c in range(channels)])
        self.width = np.array([len(rows[sb]).bit_length() for sb, _ in fields], np.int32)
        self.start = 32 + 16 * protected
        self.at = self.start + np.cumsum(self.width) - self.width
        self.end = self.start + int(self.width.sum())
        self.steps = np.zeros((len(fields), 16), np.int32)
        for k, (sb, _) in enumerate(fields):
            self.steps[k, 1 : 1 + len(rows[sb])] = rows[sb]
        starts, self.values = scale_levels()
        self.values_at = np.vectorize(starts.get, otypes=[np.int32])(self.steps)
        self.bits = np.vectorize(lambda s: (s - 1).bit_length() if s else 0, otypes=[np.int32])(self.steps)
        self.grouped = np.vectorize(lambda s: GROUPED.get(s, 0) if layer == 2 else 0, otypes=[np.int32])(self.steps)
        self.most = (self.end + 20 * len(self.field_of) + self.slots * int(self.bits.max(1).sum())) // 8 + 1  # bytes that a frame can use


@lru_cache(maxsize=None)
def layout(head: int) -> Layout:
    """The layout of a header's bits from the version on; ValueError for reserved values."""
    version, layer, mode = head >> 19 & 3, 4 - (head >> 17 & 3), head >> 6 & 3
    channels, bound, table = 1 if mode == 3 else 2, 4 + 4 * (head >> 4 & 3) if mode == 1 else 32, ""
    if layer != 1:
        if version == 1:
            raise ValueError("reserved version")
        try:
            rate = SAMPLE_RATES[head >> 10 & 3] // {3: 1, 2: 2, 0: 4}[version]
            bitrate = (BITRATES_MPEG1 if version == 3 else BITRATES_LSF)[1][head >> 12 & 15] * 1000
        except IndexError as e:
            raise ValueError(str(e)) from None
        table = layer2_table(version != 3, rate, bitrate, channels)
    return shared_layout(1 if layer == 1 else 2, channels, bound, table, not head >> 16 & 1)


shared_layout = lru_cache(maxsize=None)(Layout)


def layout_of(frame: bytes) -> Layout:
    head = int.from_bytes(frame[:4], "big")
    if not head >> 16 & 1 and len(frame) < 6:
        raise ValueError("ran past the end")
    return layout(head & HEAD)


class Block:
    """The bytes of some frames as one array, each with zeros behind."""

    def __init__(self, frames: list[bytes], most: int, least: int):
        self.left = np.array([8 * len(f) for f in frames], np.int64)
        size = max(least, min(most, max(map(len, frames)))) + 3
        b = np.frombuffer(b"".join(f[: size - 3].ljust(size, b"\0") for f in frames), np.uint8).reshape(len(frames), size)
        self.bytes, self.last = b, size - 3
        words = b.astype(np.int32)
        self.words = (words[:, :-2] << 16 | words[:, 1:-1] << 8 | words[:, 2:]).ravel()
        self.row = np.arange(len(frames), dtype=np.int32) * (size - 2)

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """The numbers of up to 16 bits at places (frames x any) in bits; behind the end something."""
        k = np.minimum(at >> 3, self.last) + self.row.reshape(-1, *(1,) * (at.ndim - 1))
        return self.words[k] >> 24 - (at & 7) - width & (1 << width) - 1

    def crc(self, start: int, end: np.ndarray) -> np.ndarray:
        """The frame CRC of each over the second half of its header and the bits from start, a whole byte, to end."""
        table, crc = crc_table(False), np.full(len(end), 0xFFFF, np.int64)
        whole = (end - start) // 8
        for k in range(2 + int(whole.max(initial=0))):
            b = self.bytes[:, min(k + 2 if k < 2 else start // 8 + k - 2, self.last)]
            crc = np.where(k < 2 + whole, (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b], crc)
        for k in range(7):
            at = start + 8 * whole + k
            bit = crc >> 15 ^ self.read(at, 1)
            crc = np.where(at < end, (crc << 1 & 0xFFFF) ^ 0x8005 * bit, crc)
        return crc


def _before(sizes: np.ndarray) -> np.ndarray:
    """What stands before each, along the last axis."""
    return np.cumsum(sizes, -1, dtype=np.int32) - sizes


def decode_alike(frames: list[bytes], lay: Layout, check_crc: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(frames, slots, channels, 32) of frames of one layout, all fields of all frames at once, and the error of each, None if it can be read.

    An error is the first that a reader who goes field by field would meet.
    """
    n, two = len(frames), lay.layer == 2
    b = Block(frames, lay.most, (lay.end + 20 * len(lay.field_of)) // 8 + 1)
    error = np.full(n, None, object)

    def refuse(which: np.ndarray, why: str) -> None:
        error[which & np.equal(error, None)] = why

    index = b.read(np.broadcast_to(lay.at.astype(np.int32), (n, len(lay.at))), lay.width)
    used = (index > 0)[:, lay.field_of].astype(np.int32)
    end = np.full(n, lay.end, np.int32)
    if two:
        how = b.read(end[:, None] + 2 * _before(used), 2)
        end = end + 2 * used.sum(1, dtype=np.int32)
    checked = end
    refuse(end > b.left, "ran past the end")
    if not two:
        refuse((index == 15).any(1), "forbidden allocation")
    sent = used * SENT[how] if two else used
    at = end[:, None] + 6 * _before(sent)
    codes = np.stack([b.read(at + 6 * k, 6) for k in range(3 if two else 1)], -1)
    mine = np.arange(codes.shape[-1]) < sent[..., None]
    refuse(((codes == 63) & mine & ((at + 6 * sent)[..., None] <= b.left[:, None, None])).any((1, 2)), "forbidden scalefactor")
    end = end + 6 * sent.sum(1, dtype=np.int32)
    factor = np.where(mine, _FACTORS[np.minimum(codes, 62)], 0)
    if two:
        factor = np.take_along_axis(factor, THIRDS_OF[how], 2)

    field = np.arange(len(lay.width))
    bits, steps, grouped, values_at = (t[field, index][:, None, :, None] for t in (lay.bits, lay.steps, lay.grouped, lay.values_at))
    per = 3 if two else 1
    size = np.where(grouped > 0, grouped, per * bits)
    step = size.sum(2, dtype=np.int32, keepdims=True)
    at = end[:, None, None, None] + step * np.arange(12, dtype=np.int32)[:, None, None] + _before(size[..., 0])[..., None]
    k = np.arange(per, dtype=np.int32)
    code = b.read(at + np.where(grouped > 0, 0, bits * k), np.where(grouped > 0, grouped, bits))
    if two and grouped.any():
        base = np.where(grouped > 0, steps, 1)
        refuse(((grouped > 0) & (code >= base**3) & (at + size <= b.left[:, None, None, None])).any((1, 2, 3)), "forbidden grouped code")
        code = np.where(grouped > 0, code // base**k % base, code)
    refuse(end + 12 * step.ravel() > b.left, "ran past the end")
    if check_crc and lay.protected:
        refuse(b.read(np.full(n, 32, np.int32), 16) != b.crc(lay.start, checked), "the frame CRC does not match")

    x = lay.values[values_at + code][:, :, lay.field_of]
    x = x * (factor.transpose(0, 2, 1).repeat(4, 1)[..., None] if two else factor[:, None])
    out = np.zeros((n, lay.slots, lay.channels, 32))
    out[..., : lay.subbands] = x.reshape(n, 12, lay.subbands, lay.channels, per).transpose(0, 1, 4, 3, 2).reshape(n, lay.slots, lay.channels, -1)
    return out, error


def decode(frame: bytes, check_crc: bool = False) -> np.ndarray:
    """(slots, channels, 32) of a Layer I or II frame; ValueError for what the standard forbids."""
    out, error = decode_alike([frame], layout_of(frame), check_crc)
    if error[0] is not None:
        raise ValueError(error[0])
    return out[0]


def _rows(check_crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("stream_id", pa.string()), ("frame_no", pa.int64()), ("slot", pa.int32()), ("channel", pa.int32()), ("s", pa.list_(pa.float32())), ("error", pa.string())])

        def refused(b: pa.RecordBatch, which: list[int], why: list[str]) -> pa.RecordBatch:
            none = [pa.nulls(len(which), kinds.field(k).type) for k in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), b.column(1).take(pa.array(which)), *none, pa.array(why, pa.string())], schema=kinds)

        for b in (x.slice(k, BLOCK) for x in batches for k in range(0, x.num_rows, BLOCK)):
            alike: dict[Layout, list[int]] = {}
            frames, bad = [v or b"" for v in b.column(2).to_pylist()], []
            for k, frame in enumerate(frames):
                try:
                    alike.setdefault(layout_of(frame), []).append(k)
                except ValueError as e:
                    bad.append((k, str(e)))
            for lay, which in alike.items():
                out, error = decode_alike([frames[k] for k in which], lay, check_crc)
                good = np.equal(error, None)
                bad += [(which[k], error[k]) for k in np.flatnonzero(~good)]
                s = out[good].astype(np.float32)
                n, (slots, channels) = int(good.sum()), s.shape[1:3]
                of = pa.array(np.array(which)[good].repeat(slots * channels))
                places = [pa.array(np.tile(v.ravel(), n), pa.int32()) for v in np.indices((slots, channels), np.int32)]
                lists = pa.ListArray.from_arrays(np.arange(n * slots * channels + 1, dtype=np.int32) * 32, s.ravel())
                if n:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *places, lists, pa.nulls(len(of), pa.string())], schema=kinds)
            if bad:
                yield refused(b, *map(list, zip(*bad)))

    return run


def subbands(frames: DataFrame, check_crc: bool = False) -> DataFrame:
    """(stream_id, frame_no, bytes) of Layer I and II frames to slots; a frame that is refused has one row with its error."""
    code = F.conv(F.hex(F.substring("bytes", 2, 1)), 16, 10).cast("int").bitwiseAND(F.lit(6))
    return frames.where(code.isin(4, 6)).select("stream_id", "frame_no", "bytes").mapInArrow(_rows(check_crc), SCHEMA)
