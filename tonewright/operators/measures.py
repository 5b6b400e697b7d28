"""Measurements of decoded against reference signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import header as H

FULL_RMS, FULL_MAX, LIMITED_RMS = 2.0**-15 / 12**0.5, 2.0**-14, 2.0**-11 / 12**0.5


def judge(t: DataFrame, keys: list[str], got: str, want: str, scale: int) -> DataFrame:
    """(keys, n, rms, worst, snr, verdict) of whole-number samples in units of 1/scale."""
    e = F.col(got) - F.col(want)
    s = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_err"), F.max(F.abs(e)).alias("_worst"), F.sum(F.col(got) * F.col(got)).alias("_power"))
    rms, worst = F.sqrt(F.col("_err") / F.col("n")) / scale, F.col("_worst") / scale
    verdict = F.when((rms < FULL_RMS) & (worst <= FULL_MAX), "full").when(rms < LIMITED_RMS, "limited").otherwise("FAIL")
    snr = F.when(F.col("_err") > 0, 10 * F.log10(F.col("_power") / F.col("_err")))
    return s.select(*keys, "n", F.round(rms, 12).alias("rms"), worst.alias("worst"), F.round(snr, 6).alias("snr"), verdict.alias("verdict"))


def noise_to_mask(t: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, noise, threshold) to mean, 95th percentile by rank and share over the mask, in dB.

    Ranks come from one sort per key; the percentile is the element at n * 95 div 100.
    """
    nmr = t.select(*keys, (10 * F.log10(F.col("noise") / F.col("threshold"))).alias("nmr"))
    w = Window.partitionBy(*keys)
    nmr = nmr.withColumn("_rank", F.row_number().over(w.orderBy("nmr"))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = F.max(F.when(F.col("_rank") == F.floor(F.col("_n") * 95 / 100) + 1, F.col("nmr")))
    return nmr.groupBy(*keys).agg(F.max("_n").alias("n"), F.round(F.avg("nmr"), 6).alias("mean_db"), F.round(at, 6).alias("p95_db"), F.round(F.avg((F.col("nmr") > 0).cast("double")), 6).alias("share_over"))


def best_variants(t: DataFrame, keys: list[str], variant: str, got: str, want: str) -> DataFrame:
    """(keys, variant, got, want: whole samples) to each key's variant of least squared error (the least of equal ones), and that error."""
    e = F.col(got) - F.col(want)
    sums = t.groupBy(*keys, variant).agg(F.sum(e * e).alias("err"))
    return sums.groupBy(*keys).agg(F.min(F.struct("err", variant)).alias("_least")).select(*keys, f"_least.{variant}", "_least.err")


def coding_counts(frames: DataFrame, side: DataFrame) -> DataFrame:
    """Per stream: granules of a channel, short blocks and bits of main data by the side information, frames and mid/side frames by the headers; frames that were refused do not count."""
    read = side.where("error IS NULL")
    mode = H.word_of(F.col("bytes"))
    joint = (F.shiftright(mode, 6).bitwiseAND(F.lit(3)) == 1) & (F.shiftright(mode, 5).bitwiseAND(F.lit(1)) == 1)
    good = frames.join(read.select("stream_id", "frame_no").distinct(), ["stream_id", "frame_no"], "left_semi")
    heads = good.groupBy("stream_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(joint.cast("bigint")).alias("mid_side"))
    rows = read.groupBy("stream_id").agg(F.count(F.lit(1)).alias("granules"), F.sum((F.col("block_type") == 2).cast("bigint")).alias("short_blocks"), F.sum(F.col("part2_3_length").cast("bigint")).alias("bits"))
    return rows.join(heads, "stream_id")
