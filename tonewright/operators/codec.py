"""Whole chains: streams to samples, and samples to frames."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import encoding as E, header as H
from ..functions.tables import BITRATES_LSF, BITRATES_MPEG1, SAMPLE_RATES
from ..sources import framing, layer12, tags
from . import analysis, encoder, filterbank, ordered, playback, psychoacoustics as P
from .layer3 import Codes


def decode_streams(streams: DataFrame, codes: Codes, prototype: np.ndarray, trim: bool = True, strict: bool = False, check_crc: bool = False) -> DataFrame:
    """(stream_id, content) to (stream_id, channel, slot, s: 32 samples, concealed, keep_from, keep_to), all layers.

    A tag frame is not played. A frame that is refused (or whose CRC fails, with ``check_crc``) is silence of its own length that the filterbank does not see; a Layer III
    frame whose main data lies before the stream is silence through the filterbank. ``strict`` checks CRCs and raises on bytes between frames, on refused frames and
    where the bits of Layer III do not add up (``playback.report`` tells without raising). keep_from and keep_to bound the samples of a slot that
    remain after gapless trimming (0 and 32 where there is no tag, or trim is off). Frames are found once and held on disk until the session drops them.
    """
    frames = framing.frames(streams, strict).persist(StorageLevel.DISK_ONLY)
    info = tags.info_headers(frames)
    tagged = info.where("kind IS NOT NULL").select(F.col("stream_id").alias("_s"), F.col("kind").alias("_tag"))
    tag_frame = F.col("_tag").isNotNull() & (F.col("frame_no") == 0)
    audio = frames.join(tagged, F.col("stream_id") == F.col("_s"), "left").where(~tag_frame).drop("_s", "_tag")
    rows = playback.ordered_rows(audio.where(H.layer(H.word_of(F.col("bytes"))) == 3), codes, check_crc, strict)
    pcm = playback.played(rows, prototype).unionByName(played12(audio, prototype, check_crc or strict, strict))
    if not trim:
        return pcm.withColumns({"keep_from": F.lit(0), "keep_to": F.lit(32)})
    cuts = tags.gapless(info).withColumnRenamed("stream_id", "_s")
    t = pcm.join(cuts, F.col("stream_id") == F.col("_s"), "left").drop("_s")
    inside = lambda at: F.least(F.greatest(at - F.col("slot") * 32, F.lit(0)), F.lit(32)).cast("int")
    t = t.withColumn("keep_from", F.when(F.col("skip").isNull(), 0).otherwise(inside(F.col("skip")))).withColumn("keep_to", F.when(F.col("length").isNull(), 32).otherwise(inside(F.col("skip") + F.col("length"))))
    return t.drop("skip", "length")


def played12(frames: DataFrame, prototype: np.ndarray, check_crc: bool = False, strict: bool = False) -> DataFrame:
    """Layer I and II frames to (stream_id, channel, slot, s, concealed): the filterbank runs over the frames that can be read, and silence stands where the others were."""
    word = H.word_of(F.col("bytes"))
    place = frames.where(H.layer(word) < 3).select("stream_id", "frame_no", F.when(H.layer(word) == 1, 12).otherwise(36).alias("n"), H.channels(word).alias("channels"))
    before = Window.partitionBy("stream_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    place = place.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))
    read = layer12.subbands(frames, check_crc)
    if strict:
        read = read.withColumn("s", F.when(F.col("error").isNull(), F.col("s")).otherwise(F.raise_error(F.col("error")).cast(read.schema["s"].dataType)))
    o = Window.partitionBy("stream_id", "channel").orderBy("frame_no", "slot")
    good = read.where("error IS NULL").withColumn("at", (F.row_number().over(o) - 1).cast("bigint"))
    played = filterbank.synthesise(good.select("stream_id", "channel", "at", "s"), ["stream_id", "channel"], "at", "s", prototype)
    where = good.select("stream_id", "channel", "at", "frame_no", "slot").join(place.select("stream_id", "frame_no", "first"), ["stream_id", "frame_no"])
    played = played.join(where, ["stream_id", "channel", "at"]).select("stream_id", "channel", (F.col("first") + F.col("slot")).alias("slot"), "s", F.lit(False).alias("concealed"))
    bad = place.join(read.where("error IS NOT NULL").select("stream_id", "frame_no"), ["stream_id", "frame_no"])
    bad = bad.select("stream_id", "first", "n", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)).alias("channel"))
    bad = bad.select("stream_id", F.col("channel").cast("int"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    return played.unionByName(bad.withColumns({"s": F.array_repeat(F.lit(0.0).cast("float"), 32), "concealed": F.lit(True)}))


def block_types_of(blocks: DataFrame) -> DataFrame:
    """(stream_id, channel, slot, s) to (stream_id, granule, block_type): attacks of either channel through the automaton.

    The last granule has no region behind it and takes none for an attack to come.
    """
    kinds = P.block_type_scan(analysis.attack_flags(blocks), ["stream_id"], "granule", "attack")
    return kinds.select("stream_id", "granule", F.col("kind").alias("block_type"))


def padded(blocks: DataFrame, rate: int) -> DataFrame:
    """The slots of each stream with silence behind, up to the whole frames that hold its samples and both delays."""
    per = 1152 if rate >= 32000 else 576
    ends = blocks.groupBy("stream_id").agg((F.max("slot") + 1).alias("slots"), F.collect_set("channel").alias("channels"))
    frames, _ = E.extent(F.col("slots") * 32, F.lit(per))
    more = ends.select("stream_id", F.explode("channels").alias("channel"), "slots", frames.alias("frames"))
    more = more.select("stream_id", "channel", F.explode(F.sequence(F.col("slots"), (F.col("frames") * (per // 32) - 1).cast("bigint"))).alias("slot"))
    silence = F.array_repeat(F.lit(0.0), 32).cast(blocks.schema["s"].dataType)
    return blocks.select("stream_id", "channel", "slot", "s").unionByName(more.withColumn("s", silence))


def check_settings(rate: int, channels: int, kbps: int | None, quality: int | None = None) -> None:
    """Raise ValueError for what Layer III cannot carry."""
    if rate not in {r // k for k in (1, 2, 4) for r in SAMPLE_RATES}:
        raise ValueError(f"{rate} Hz is no sampling rate of Layer III")
    if channels not in (1, 2):
        raise ValueError(f"one or two channels, not {channels}")
    if kbps is not None and kbps not in (BITRATES_LSF if rate < 32000 else BITRATES_MPEG1)[2][1:]:
        raise ValueError(f"{kbps} kb/s is no bit rate at {rate} Hz")
    if kbps is None and (quality is None or not 0 <= quality <= 9):
        raise ValueError(f"a quality from 0 to 9, not {quality}")


def full_scale(prototype: np.ndarray) -> tuple[float, float]:
    """Energy of the lines that a sine of full scale gives in a long block, and in one window of a short block; measured through the filterbank."""
    x = np.sin(2 * np.pi / 64 * 2.5 * np.arange(576 * 8)).reshape(-1, 32)
    history = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros((15, 32)), x], 16, axis=0).swapaxes(1, 2)
    bands = filterbank.analyse_blocks(history, np.asarray(prototype, dtype=float)).T  # subband, slot
    bands[1::2, 1::2] *= -1
    before, now = (bands[:, 18 * g : 18 * g + 18].reshape(1, -1) for g in (4, 5))
    long, short = (float((analysis.forward_lines(before, now, np.array([t])) ** 2).sum()) for t in (0, 2))
    return long, short / 3


class Settings:
    """What an encoder is set to, checked; the model and the low-pass follow."""

    def __init__(self, prototype: np.ndarray, rate: int, kbps: int | None, lowpass: float | None = None, joint: bool = True, quality: int | None = None, channels: int = 2):
        check_settings(rate, channels, kbps, quality)
        self.rate, self.kbps, self.joint, self.channels, self.prototype = rate, kbps, joint, channels, np.asarray(prototype, float)
        offset = 0.0
        if kbps is None:
            offset, lowpass = -4.0 + 1.6 * quality, lowpass or 20000.0 - 700.0 * quality
        self.lowpass = lowpass or E.lowpass_of(kbps / channels * (1.15 if joint and channels == 2 else 1.0))
        self.model = P.Model(rate, full_scale(prototype), offset)


def held_down(last: list[float] | None, allowed: list[float], floor: list[float]) -> list[float]:
    """The allowed noise of a long block, at most twice that of the granule before (itself held), but not below ``floor``; ``last`` None is no such memory."""
    return allowed if last is None else [max(min(a, 2 * p), f) for a, p, f in zip(allowed, last, floor)]


def pre_echo(masks: DataFrame, floor: list[float], size: int = 512) -> DataFrame:
    """``allowed`` of long blocks held to twice that of the granule before, itself held, but not below ``floor`` (per band); a short block clears the memory.

    A parallel prefix over chunks of granules numbered from 0: without a short block a chunk is the map p -> max(min(a, 2^k p), f) of each band, which
    compositions keep; behind a short block nothing of the state is left. Powers of two are exact, so chunks change no bit of the result.
    """

    def follow(state, kinds: list[int], allowed: list[list[float]]) -> list[list[float]]:
        out = []
        for kind, a in zip(kinds, allowed):
            held = a if kind == 2 else held_down(state, a, floor)
            state = None if kind == 2 else held
            out.append(held)
        return out

    def function(kinds: list[int], allowed: list[list[float]]) -> dict:
        """State behind a chunk that starts without memory, and unless a short block cuts it the map of a state: a, the factor, f."""
        out = {"none": None if kinds[-1] == 2 else follow(None, kinds, allowed)[-1]}
        if 2 not in kinds:
            top, factor, low = [float("inf")] * len(floor), 1.0, [0.0] * len(floor)
            for a in allowed:
                top, low, factor = [min(x, 2 * t) for x, t in zip(a, top)], [max(min(x, 2 * p), f) for x, p, f in zip(a, low, floor)], 2 * factor
            out |= {"top": top, "factor": factor, "low": low}
        return out

    def behind(state, f: dict):
        return f["none"] if state is None or "top" not in f else [max(min(t, f["factor"] * p), low) for t, p, low in zip(f["top"], state, f["low"])]

    t = masks.select("stream_id", "channel", "granule", "block_type", "x", "allowed")
    out = T.StructField("_held", t.schema["allowed"].dataType)
    done = ordered.scan(t.drop("x"), ["stream_id", "channel"], "granule", ["block_type", "allowed"], size, None, function, behind, follow, out)
    done = done.select("stream_id", "channel", "granule", F.col("_held").alias("allowed"))
    return t.drop("allowed").join(done, ["stream_id", "channel", "granule"]).select(t.columns)


def encode_pcm(blocks: DataFrame, codes: Codes, prototype: np.ndarray, rate: int, kbps: int | None, lowpass: float | None = None, joint: bool = True, quality: int | None = None, channels: int = 2) -> DataFrame:
    """(stream_id, channel, slot, s: 32 samples) to frames (stream_id, frame_no, bytes): constant rate, or variable by quality 0-9.

    Silence fills each stream up to whole frames behind the delays. ``lowpass`` follows from rate or quality where it is not given; ``channels`` is
    what the settings are checked and the low-pass chosen for.
    """
    use = Settings(prototype, rate, kbps, lowpass, joint, quality, channels)
    blocks = padded(blocks, rate)
    parts = analysis.subband_granules(blocks, use.prototype).join(block_types_of(blocks), ["stream_id", "granule"])
    return encoder.encode(pre_echo(analysis.lines_and_masks(parts, use.model, use.lowpass), use.model.floor), codes, rate, kbps, joint)
