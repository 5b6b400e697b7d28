"""Info headers of streams (Xing, Info and VBRI) as expressions over first frames, and the tag frame as an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import header as H
from ..functions.checksums import ARC_POLY, crc16_arc
from ..functions.encoding import DECODER_DELAY
from ..operators import streams

VBRI_AT = 36


_FIELDS = {"kind": pa.string(), "frames": pa.int64(), "size": pa.int64(), "quality": pa.int64(), "toc": pa.binary(), "encoder": pa.string(), "lowpass": pa.int64(), "delay": pa.int64(), "padding": pa.int64(), "music_length": pa.int64(), "music_crc": pa.int64(), "crc_holds": pa.bool_(), "samples": pa.int32()}
_INFO = "stream_id string, kind string, frames bigint, size bigint, quality bigint, toc binary, encoder string, lowpass bigint, delay bigint, padding bigint, music_length bigint, music_crc bigint, crc_holds boolean, samples int"


def read_tag(frame: bytes) -> dict:
    """Kind (None without a tag) and fields of a Layer III frame's info header; what it does not tell is left out.

    The block behind the flagged fields is taken as an encoder's when its name begins with four printable characters.
    """
    word, out = int.from_bytes(frame[:4], "big"), {}
    lsf, mono = word >> 19 & 3 != 3, word >> 6 & 3 == 3
    at = (4 if word >> 16 & 1 else 6) + ((9 if mono else 17) if lsf else (17 if mono else 32))
    out["samples"] = 576 if lsf else 1152
    number = lambda p, n=4: int.from_bytes(frame[p : p + n], "big") if p + n <= len(frame) else None
    mark = frame[at : at + 4]
    if mark not in (b"Xing", b"Info"):
        if frame[VBRI_AT : VBRI_AT + 4] != b"VBRI":
            return out
        v = VBRI_AT
        return out | {"kind": "VBRI", "frames": number(v + 14), "size": number(v + 10), "quality": number(v + 8, 2), "delay": number(v + 6, 2), "padding": 0}
    out["kind"], flags, p = mark.decode(), number(at + 4) or 0, at + 8
    for name, bit, size in (("frames", 1, 4), ("size", 2, 4), ("toc", 4, 100), ("quality", 8, 4)):
        if flags & bit:
            out[name] = frame[p : p + size] if name == "toc" else number(p)
            p += size
    name = frame[p : p + 9]
    if len(frame) >= p + 36 and all(32 <= c <= 126 for c in name[:4]):
        pair = number(p + 21, 3)
        out |= {"encoder": name.decode("ISO-8859-1").rstrip("\0").rstrip(" "), "lowpass": 100 * frame[p + 10], "delay": pair >> 12, "padding": pair & 4095}
        out |= {"music_length": number(p + 28), "music_crc": number(p + 32, 2), "crc_holds": arc(frame[: p + 34]) == number(p + 34, 2)}
    return out


def info_headers(frames: DataFrame) -> DataFrame:
    """One row per stream that begins with a Layer III frame: kind (null without a tag) and its fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_tag(f.as_py()) for f in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.get(k) for r in rows], t) for k, t in _FIELDS.items())], names=["stream_id", *_FIELDS])

    first = frames.groupBy("stream_id").agg(F.min_by("bytes", "frame_no").alias("b"))
    return first.where(H.layer(H.word_of(F.col("b"))) == 3).select("stream_id", "b").mapInArrow(run, _INFO)


def gapless(info: DataFrame) -> DataFrame:
    """stream_id, skip and length in samples, of streams whose tag tells the encoder's delay."""
    length = F.greatest(F.col("frames") * F.col("samples") - F.col("delay") - F.col("padding"), F.lit(0))
    return info.where("delay IS NOT NULL").select("stream_id", (F.col("delay") + DECODER_DELAY).alias("skip"), length.alias("length"))


def gapless_of(frame: bytes) -> tuple[int, int | None] | None:
    """The same of one tag frame, for streams: skip, and length where frames are counted; None where it tells no delay."""
    t = read_tag(frame)
    if t.get("delay") is None:
        return None
    return t["delay"] + DECODER_DELAY, None if t.get("frames") is None else max(t["frames"] * t["samples"] - t["delay"] - t["padding"], 0)


def _crc_step(crc: int, byte: int) -> int:
    crc ^= byte
    for _ in range(8):
        crc = crc >> 1 ^ (ARC_POLY if crc & 1 else 0)
    return crc


_CRC = [_crc_step(0, b) for b in range(256)]


def arc(data: bytes) -> int:
    """CRC-16/ARC of some bytes."""
    crc = 0
    for b in data:
        crc = crc >> 8 ^ _CRC[(crc ^ b) & 0xFF]
    return crc


def music_crc(frames: DataFrame) -> DataFrame:
    """(stream_id, crc): CRC-16/ARC over a stream's frames in order; frames stream through, nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, crc, done = None, 0, []
        for b in batches:
            for sid, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if sid != stream:
                    if stream is not None:
                        done.append((stream, crc))
                    stream, crc = sid, 0
                for x in data:
                    crc = crc >> 8 ^ _CRC[(crc ^ x) & 255]
        if stream is not None:
            done.append((stream, crc))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done)], names=["stream_id", "crc"])

    rows = frames.select("stream_id", "frame_no", "bytes").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    return rows.select("stream_id", "bytes").mapInArrow(run, "stream_id string, crc bigint")


def tag_frames(frames: DataFrame, quality: int, lowpass: int, delay: int, samples: Column, encoder: str = "tonewrig ", vbr: bool = False) -> DataFrame:
    """(stream_id, frame_no -1, bytes): the tag frame of each stream, in the smallest frame of its kind that holds it.

    ``samples``: the stream's input length (a column over stream_id's rows). Frames and bytes are
    counted, the seek table drawn and the CRCs run by aggregates; both counts take in the tag's own bytes as the layout asks.
    """
    word = H.word_of(F.col("bytes"))
    first = frames.groupBy("stream_id").agg(F.min_by(word, F.col("frame_no")).alias("w"), F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).alias("music"), F.max(samples).alias("pcm"))
    spf = H.samples(F.col("w"))
    need = 4 + H.side_info_length(F.col("w")) + 8 + 4 + 4 + 100 + 4 + 36
    clean = F.col("w").bitwiseAND(F.lit(0xFFFFFFFF ^ (0xF << 12) ^ (1 << 9) ^ (3 << 4))).bitwiseOR(F.lit(1 << 16))
    options = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.struct(H.frame_length(clean.bitwiseOR(F.shiftleft(i.cast("bigint"), 12))).alias("len"), clean.bitwiseOR(F.shiftleft(i.cast("bigint"), 12)).alias("w")))
    t = first.withColumn("pick", F.array_min(F.filter(options, lambda o: o["len"] >= need)))
    t = t.withColumn("tag", F.col("pick.w")).withColumn("len", F.col("pick.len")).withColumn("side", H.side_info_length(F.col("w")))
    sized = frames.select("stream_id", "frame_no", F.length("bytes").alias("_len")).join(t.select("stream_id", F.col("len").alias("_tag")), "stream_id")
    points = streams.seek_points(sized, ["stream_id"], "frame_no", "_len", 0).select("stream_id", "entry", "_at", "_total", "_tag")
    value = F.least(F.floor((F.col("_at") + F.col("_tag")) * 256 / (F.col("_total") + F.col("_tag"))), F.lit(255))
    toc = points.withColumn("v", value).groupBy("stream_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("entry", "v"))), lambda x: F.lpad(F.hex(x["v"]), 2, "0"))).alias("toc"))
    t = t.join(toc, "stream_id").join(music_crc(frames), "stream_id")
    hexed = lambda c, n: F.lpad(F.hex(c.cast("bigint")), 2 * n, "0")
    text = lambda s: F.lit(s.encode("latin-1").hex())
    padding = F.col("n") * spf - delay - F.col("pcm")
    total = F.col("music") + F.col("len")
    body = F.concat(
        hexed(F.col("tag"), 4), F.repeat(F.lit("00"), F.col("side")), text("Xing" if vbr else "Info"), F.lit("0000000f"), hexed(F.col("n"), 4), hexed(total, 4), F.col("toc"), hexed(F.lit(quality), 4),
        text((encoder + " " * 9)[:9]), F.lit("04" if vbr else "01"), hexed(F.lit(lowpass // 100), 1), F.lit("00" * 10), hexed(F.lit(delay) * 4096 + F.least(F.greatest(padding, F.lit(0)), F.lit(4095)), 3), F.lit("00" * 4),
        hexed(total, 4), hexed(F.col("crc"), 2),
    )
    t = t.withColumn("body", F.unhex(body))
    whole = F.concat(F.col("body"), F.unhex(hexed(crc16_arc(F.col("body")), 2)))
    pad = F.unhex(F.repeat(F.lit("00"), F.greatest((F.col("len") - F.length(whole)).cast("int"), F.lit(0))))
    return t.select("stream_id", F.lit(-1).cast("bigint").alias("frame_no"), F.concat(whole, pad).alias("bytes"))
