"""Side information of Layer III frames: a bit layout per version, read into one row per granule and channel.

The layout is data (names and widths in order); the reader walks it over each frame of
an Arrow batch. What follows from the fields is left to expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD = (("part2_3_length", 12), ("big_values", 9), ("global_gain", 8))
SWITCHED = (("block_type", 2), ("mixed_block", 1), ("table0", 5), ("table1", 5), ("gain0", 3), ("gain1", 3), ("gain2", 3))
PLAIN = (("table0", 5), ("table1", 5), ("table2", 5), ("region0_count", 4), ("region1_count", 3))
INTS = ("main_data_begin", "part2_3_length", "big_values", "global_gain", "scalefac_compress", "window_switching", "block_type", "mixed_block", "region0_count", "region1_count", "preflag", "scalefac_scale", "count1_table")
SCHEMA = "stream_id string, frame_no bigint, granule int, channel int, " + ", ".join(f"{k} int" for k in INTS) + ", table_select array<int>, subblock_gain array<int>, scfsi array<int>, error string"


class Bits:
    """A most-significant-bit-first cursor over bytes."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("ran past the end")
        return self.value >> self.left & ((1 << n) - 1)


def parse(frame: bytes) -> list[dict]:
    """One dict per granule and channel of a Layer III frame; ValueError for what the standard refuses."""
    word = int.from_bytes(frame[:4], "big")
    lsf, mono = word >> 19 & 3 != 3, word >> 6 & 3 == 3
    channels, granules = (1, 2)[not mono], 1 if lsf else 2
    size = (9 if mono else 17) if lsf else (17 if mono else 32)
    bits = Bits(frame[4 if word >> 16 & 1 else 6 :][:size])
    begin = bits.take(8 if lsf else 9)
    bits.take((1 if mono else 2) if lsf else (5 if mono else 3))
    scfsi = [[] if lsf else [bits.take(1) for _ in range(4)] for _ in range(channels)]
    rows = []
    for g in range(granules):
        for c in range(channels):
            r = {"granule": g, "channel": c, "main_data_begin": begin, "scfsi": scfsi[c]} | {k: bits.take(n) for k, n in HEAD}
            r["scalefac_compress"] = bits.take(9 if lsf else 4)
            r["window_switching"] = bits.take(1)
            part = {k: bits.take(n) for k, n in (SWITCHED if r["window_switching"] else PLAIN)}
            short = part.get("block_type") == 2 and not part["mixed_block"]
            r |= {"block_type": part.get("block_type", 0), "mixed_block": part.get("mixed_block", 0), "table_select": [part[k] for k in ("table0", "table1", "table2") if k in part], "subblock_gain": [part.get(f"gain{k}", 0) for k in range(3)]}
            r["region0_count"] = part.get("region0_count", 8 if short else 7)
            r["region1_count"] = part.get("region1_count", 36)
            r["preflag"] = 0 if lsf else bits.take(1)
            r["scalefac_scale"], r["count1_table"] = bits.take(1), bits.take(1)
            if r["big_values"] > 288 or r["window_switching"] and not r["block_type"] or {4, 14} & set(r["table_select"]):
                raise ValueError(f"refused values in granule {g}, channel {c}")
            rows.append(r)
    return rows


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = ("table_select", "subblock_gain", "scfsi")
    kinds = [("stream_id", pa.string()), ("frame_no", pa.int64()), ("granule", pa.int32()), ("channel", pa.int32()), *((k, pa.int32()) for k in INTS), *((k, pa.list_(pa.int32())) for k in lists), ("error", pa.string())]
    for b in batches:
        out = []
        for stream, frame_no, data in zip(*(b.column(k).to_pylist() for k in range(3))):
            key = {"stream_id": stream, "frame_no": frame_no}
            try:
                out += [key | r for r in parse(data or b"")]
            except ValueError as e:
                out.append(key | {"error": str(e)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))


def side_info(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_no, bytes) of Layer III frames to side information; a frame that is refused has one row with its error."""
    layer3 = F.conv(F.hex(F.substring("bytes", 2, 1)), 16, 10).cast("int").bitwiseAND(F.lit(6)) == 2
    return frames.where(layer3).select("stream_id", "frame_no", "bytes").mapInArrow(_rows, SCHEMA)


def pack(rows: list[dict], lsf: bool, mono: bool) -> bytes:
    """The inverse: side information bytes of one frame's rows, in granule and channel order."""
    channels = 1 if mono else 2
    parts = [(rows[0]["main_data_begin"], 8 if lsf else 9), (0, (1 if mono else 2) if lsf else (5 if mono else 3))]
    parts += [] if lsf else [(b, 1) for c in range(channels) for b in rows[c]["scfsi"]]
    for r in rows:
        flat = r | {f"table{k}": v for k, v in enumerate(r["table_select"])} | {f"gain{k}": v for k, v in enumerate(r["subblock_gain"])}
        layout = [*HEAD, ("scalefac_compress", 9 if lsf else 4), ("window_switching", 1), *(SWITCHED if r["window_switching"] else PLAIN)]
        layout += [] if lsf else [("preflag", 1)]
        parts += [(flat[k], n) for k, n in (*layout, ("scalefac_scale", 1), ("count1_table", 1))]
    value, size = 0, sum(n for _, n in parts)
    for v, n in parts:
        value = value << n | v
    return value.to_bytes(size // 8, "big")
