"""Excerpts by time: only the frames that a stretch of samples needs are decoded, each excerpt as a stream of its own that starts anew.

What stands before a frame that it needs: main data of at most 511 bytes, the half granule of overlap, and fifteen slots of the filterbank. So an excerpt begins two frames
before its first sample, and before these with as many frames as hold 511 bytes of main data. Frames are found by number, not by a scan of the stream: all joins are on
(stream, number).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import header as H
from . import playback
from .layer3 import RESERVOIR, Codes

PRE_ROLL = 2


def numbered(frames: DataFrame) -> DataFrame:
    """Layer III frames (stream_id, frame_no, bytes; without a tag frame) to (stream_id, n, bytes, samples, main_end): numbers from 0, samples of a frame, and where its own main data ends in that of the stream."""
    word = H.word_of(F.col("bytes"))
    own = F.length("bytes") - H.header_length(word) - H.side_info_length(word)
    o = Window.partitionBy("stream_id").orderBy("frame_no")
    place = frames.select("stream_id", "frame_no", H.samples(word).alias("samples"), own.alias("own"))
    place = place.select("stream_id", "frame_no", "samples", (F.row_number().over(o) - 1).cast("bigint").alias("n"), F.sum("own").over(o).cast("bigint").alias("main_end"))
    return frames.select("stream_id", "frame_no", "bytes").join(place, ["stream_id", "frame_no"]).drop("frame_no")


def needed(places: DataFrame, asked: DataFrame) -> DataFrame:
    """(stream_id, excerpt_id, start, stop: samples) to the same with first and last, the numbers of the frames that are needed; ``places`` as ``numbered`` gives them. Streams that are not there drop out."""
    per = places.groupBy("stream_id").agg(F.max("samples").alias("samples"), F.max("n").alias("most"))
    a = asked.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("excerpt_id").cast("string").alias("excerpt_id"), F.greatest(F.col("start"), F.lit(0)).cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop")).join(per, "stream_id")
    a = a.withColumn("last", F.least(F.floor((F.col("stop") - 1) / F.col("samples")), F.col("most"))).withColumn("at", F.greatest(F.floor(F.col("start") / F.col("samples")) - PRE_ROLL, F.lit(0)))
    a = a.where((F.col("stop") > F.col("start")) & (F.col("at") <= F.col("most")))
    # a frame that holds main data holds a byte of it, so 511 frames reach back far enough
    back = a.select("stream_id", "excerpt_id", "at", F.explode(F.sequence(F.greatest(F.col("at") - RESERVOIR - 1, F.lit(0)), F.col("at"))).alias("n"))
    ends = back.join(places.select("stream_id", "n", "main_end"), ["stream_id", "n"])
    own = F.max(F.when(F.col("n") == F.col("at") - 1, F.col("main_end")))
    firsts = ends.groupBy("stream_id", "excerpt_id").agg(F.coalesce(own, F.lit(0)).alias("begin"), F.collect_list(F.struct("n", "main_end")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["main_end"] > F.col("begin") - RESERVOIR), lambda x: x["n"]))
    return a.join(firsts.select("stream_id", "excerpt_id", first.alias("first")), ["stream_id", "excerpt_id"]).select("stream_id", "excerpt_id", "start", "stop", "samples", "first", "last")


def excerpts(frames: DataFrame, asked: DataFrame, codes: Codes, prototype: np.ndarray) -> DataFrame:
    """Frames (stream_id, frame_no, bytes; Layer III, without a tag frame) and asked stretches (stream_id, excerpt_id, start, stop: samples) to (excerpt_id, channel, slot, s, concealed, keep_from, keep_to).

    Slots count from the stream's start; keep_from and keep_to bound what lies inside the stretch. Equal to that part of the whole stream, unless one of the two frames before it cannot be read.
    """
    all_of = numbered(frames)
    want = needed(all_of.select("stream_id", "n", "samples", "main_end"), asked)
    each = want.select("stream_id", "excerpt_id", F.explode(F.sequence("first", "last")).alias("n"))
    parts = each.join(all_of.select("stream_id", "n", "bytes"), ["stream_id", "n"]).select(F.col("excerpt_id").alias("stream_id"), F.col("n").alias("frame_no"), "bytes")
    sound = playback.played(playback.ordered_rows(parts, codes), prototype)
    sound = sound.withColumnRenamed("stream_id", "excerpt_id").join(want.select("excerpt_id", "start", "stop", "first", "samples"), "excerpt_id")
    sound = sound.withColumn("slot", F.col("slot") + F.col("first") * F.col("samples") / 32).withColumn("slot", F.col("slot").cast("bigint"))
    inside = lambda at: F.least(F.greatest(at - F.col("slot") * 32, F.lit(0)), F.lit(32)).cast("int")
    sound = sound.where((F.col("slot") * 32 + 32 > F.col("start")) & (F.col("slot") * 32 < F.col("stop")))
    return sound.select("excerpt_id", "channel", "slot", "s", "concealed", inside(F.col("start")).alias("keep_from"), inside(F.col("stop")).alias("keep_to"))
