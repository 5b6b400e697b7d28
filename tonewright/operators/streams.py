"""Operators over ordered frames of streams: offsets, padding, trimming, seek points, segments, reservoir.

All are windows partitioned by stream; a stream's frames are ordered by a frame number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import ordered


def _order(keys: list[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def big_endian(data: Column, at: int, n: int) -> Column:
    """The unsigned number in ``n`` bytes from byte ``at`` (from 1)."""
    return F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("bigint")


def channel_segments(frames: DataFrame, keys: list[str], by: str, channels: str) -> DataFrame:
    """segment: how many channel changes came before; filterbank state never crosses one."""
    o = _order(keys, by)
    change = F.coalesce((F.col(channels) != F.lag(channels).over(o)).cast("int"), F.lit(0))
    return frames.withColumn("_change", change).withColumn("segment", F.sum("_change").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def offsets(frames: DataFrame, keys: list[str], by: str, length: str, samples: str) -> DataFrame:
    """frame_no from 0, byte position and first sample of each frame."""
    o = _order(keys, by)
    before = o.rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumns({
        "frame_no": (F.row_number().over(o) - 1).cast("bigint"), "position": F.coalesce(F.sum(length).over(before), F.lit(0)), "first_sample": F.coalesce(F.sum(samples).over(before), F.lit(0)),
    })


def gapless(frames: DataFrame, keys: list[str], by: str, samples: str, delay: str, padding: str) -> DataFrame:
    """skip, length, keep_from and keep_to (in the frame's samples): encoder delay plus 529, and the tag's length."""
    o = _order(keys, by)
    t = frames.withColumn("_start", F.coalesce(F.sum(samples).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_all", F.sum(samples).over(Window.partitionBy(*keys)))
    t = t.withColumn("skip", (F.col(delay) + 529).cast("bigint")).withColumn("length", F.greatest(F.col("_all") - F.col(delay) - F.col(padding), F.lit(0)))
    end = F.col("_start") + F.col(samples)
    inside = lambda x: F.greatest(F.least(x, end), F.col("_start")) - F.col("_start")
    t = t.withColumn("keep_from", inside(F.col("skip")).cast("bigint"))
    return t.withColumn("keep_to", F.greatest(inside(F.col("skip") + F.col("length")), F.col("keep_from")).cast("bigint")).drop("_start", "_all")


def seek_points(frames: DataFrame, keys: list[str], by: str, length: str, tag_bytes: int) -> DataFrame:
    """A hundred rows per stream: in 256ths of the stream, where the frame at each hundredth starts, behind a tag frame."""
    o, whole = _order(keys, by), Window.partitionBy(*keys)
    t = frames.withColumn("_at", F.coalesce(F.sum(length).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_no", F.row_number().over(o) - 1)
    t = t.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_total", F.sum(length).over(whole))
    first, last = F.ceil(F.col("_no") * 100 / F.col("_n")), F.ceil((F.col("_no") + 1) * 100 / F.col("_n")) - 1
    t = t.where(first <= last).withColumn("entry", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return t.withColumn("value", F.least(F.floor((F.col("_at") + tag_bytes) * 256 / (F.col("_total") + tag_bytes)), F.lit(255)).cast("int"))


def padding(frames: DataFrame, keys: list[str], by: str, samples: Column, bitrate: Column, rate: Column) -> DataFrame:
    """padding (0 or 1) and frame_length that keep the average rate exact: the difference of floor(n rest / rate)."""
    eighth = (samples / 8).cast("bigint")
    t = frames.withColumn("_n", F.row_number().over(_order(keys, by)).cast("bigint")).withColumn("_rest", eighth * bitrate % rate)
    carry = F.floor(F.col("_n") * F.col("_rest") / rate) - F.floor((F.col("_n") - 1) * F.col("_rest") / rate)
    t = t.withColumn("padding", carry.cast("int"))
    return t.withColumn("frame_length", (F.floor(eighth * bitrate / rate) + F.col("padding")).cast("bigint")).drop("_n", "_rest")


def reservoir(frames: DataFrame, keys: list[str], by: str, main_bytes: str, begin: str, limit: int = 511) -> DataFrame:
    """Where a frame's main data starts in the stream's main data, and whether all of it is there.

    available: bytes of earlier frames that the reservoir still holds.
    """
    before = _order(keys, by).rowsBetween(Window.unboundedPreceding, -1)
    t = frames.withColumn("_sum", F.coalesce(F.sum(main_bytes).over(before), F.lit(0)))
    t = t.withColumn("available", F.least(F.col("_sum"), F.lit(limit))).withColumn("main_start", F.col("_sum") - F.col(begin))
    return t.withColumn("decodable", F.col(begin) <= F.col("available")).drop("_sum")


def accounting(frames: DataFrame, keys: list[str], by: str, main_bytes: str, begin: str, bits: str) -> DataFrame:
    """unused: whole bytes of main data a frame leaves; consistent: it starts within what the one before left (0 at first) and has its bits."""
    avail = 8 * (F.col(begin) + F.col(main_bytes))
    left = F.floor(F.greatest(avail - F.col(bits), F.lit(0)) / 8)
    t = frames.withColumn("unused", left).withColumn("_before", F.lag(left).over(_order(keys, by)))
    reach = F.when(F.col("_before").isNull(), F.col(begin) == 0).otherwise(F.col(begin) <= F.col("_before"))
    return t.withColumn("consistent", (F.col(bits) <= avail) & reach).drop("_before")


def emitted(frames: DataFrame) -> DataFrame:
    """``gapless`` rows with samples, those of a channel that a frame gives out, and empty: a frame that trimming leaves nothing of is still there."""
    left = F.col("keep_to") - F.col("keep_from")
    return frames.withColumn("samples", left).withColumn("empty", left == 0)


def reservoir_levels(frames: DataFrame, keys: list[str], by: str, change: str, limit: int = 511, size: int = 4096) -> DataFrame:
    """(keys, by: numbered without gaps, change: bytes of a frame's slot less those it uses) with ``level``, the free bytes behind each frame: from 0, never below 0 or above the limit.

    A recursion as a parallel prefix: frames in a row are x -> max(lo, min(x + a, hi)), and such maps compose.
    """

    def levels(x: int, changes: list[int]) -> list[int]:
        out = []
        for a in changes:
            x = max(0, min(x + a, limit))
            out.append(x)
        return out

    def function(changes: list[int]) -> list[int]:
        total, lo, hi = 0, 0, limit
        for k, a in enumerate(changes):
            total = total + a
            lo, hi = (max(0, min(v + a, limit)) for v in (lo, hi)) if k else (0, limit)
        return [total, lo, hi]

    return ordered.scan(frames, keys, by, [change], size, 0, function, lambda x, f: max(f[1], min(x + f[0], f[2])), levels, T.StructField("level", T.LongType()))
