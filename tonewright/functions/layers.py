"""Dequantisation, stereo and scalefactor rules of the three layers, as column expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .tables import SUBBANDS, allocation_row


def scalefactor(index: Column) -> Column:
    """2^(1 - index/3)"""
    return F.pow(F.lit(2.0), 1 - index / 3.0)


def sample_bits(steps: Column) -> Column:
    """Bits of a code before grouping: ceil(log2(steps))."""
    return F.length(F.bin(steps - 1))


def dequantised(code: Column, steps: Column, bits: Column) -> Column:
    """C (v / 2^(bits-1) - 1 + D) with C = 2^bits / steps, D = (2^bits - steps + 1) / 2^bits."""
    full = F.pow(F.lit(2.0), bits)
    return full / steps * (code / (full / 2.0) - 1.0 + (full - steps + 1.0) / full)


def grouped_digits(code: Column, steps: Column) -> tuple[Column, Column, Column]:
    """The three samples of a grouped code, least significant digit first."""
    return code % steps, F.floor(code / steps) % steps, F.floor(code / (steps * steps)) % steps


def allocation_table(lsf: Column, rate: Column, bitrate: Column, channels: Column) -> Column:
    """A, B, C, D or LSF by rate and bit rate per channel; free format (0) counts as a high rate."""
    per = F.floor(bitrate / channels)
    low = F.when(rate == 32000, "D").otherwise("C")
    return F.when(lsf, "LSF").when((bitrate != 0) & (per <= 48000), low).when(((bitrate != 0) & (per <= 80000)) | (rate == 48000), "A").otherwise("B")


def allocation_dimension(spark: SparkSession) -> DataFrame:
    """(alloc, subband, nbal, steps): 107 rows in all."""
    rows = [(t, sb, (len(allocation_row(t, sb)) + 1).bit_length() - 1, list(allocation_row(t, sb))) for t, n in SUBBANDS.items() for sb in range(n)]
    return spark.createDataFrame(rows, "alloc string, subband int, nbal int, steps array<int>")


def mid_side(m: Column, s: Column) -> tuple[Column, Column]:
    return (m + s) / sqrt(2.0), (m - s) / sqrt(2.0)


def intensity_mpeg1(pos: Column) -> tuple[Column, Column]:
    """Factors of a position: tan(pos pi/12) left to right; 6 is all left, from 7 not coded (null)."""
    ratio = F.tan(pos * pi / 12.0)
    left = F.when(pos >= 7, None).when(pos == 6, 1.0).otherwise(ratio / (1 + ratio))
    return left, F.when(pos >= 7, None).when(pos == 6, 0.0).otherwise(1 / (1 + ratio))


def intensity_lsf(pos: Column, most: Column, low_bit: Column) -> tuple[Column, Column]:
    """Factors of the lower rates: powers of 2^-1/2 or 2^-1/4; odd positions scale left, even ones right; the greatest is not coded."""
    io = F.when(low_bit, sqrt(0.5)).otherwise(sqrt(sqrt(0.5)))
    left = F.when(pos == most, None).when(pos % 2 == 1, F.pow(io, (pos + 1) / 2)).otherwise(1.0)
    return left, F.when(pos == most, None).when((pos > 0) & (pos % 2 == 0), F.pow(io, pos / 2)).otherwise(1.0)


def lsf_lengths(s: Column, right: Column) -> tuple[list[Column], Column, Column]:
    """Four scalefactor lengths, the row of band counts, and preflag, from scalefac_compress of the lower rates."""
    div = lambda a, b: F.floor(a / b)
    v = div(s, 2)
    normal = [(s < 400, (div(div(s, 16), 5), div(s, 16) % 5, div(s % 16, 4), s % 4)), (s < 500, (div(div(s - 400, 4), 5), div(s - 400, 4) % 5, (s - 400) % 4, F.lit(0))), (F.lit(True), (div(s - 500, 3), (s - 500) % 3, F.lit(0), F.lit(0)))]
    inten = [(v < 180, (div(v, 36), div(v % 36, 6), v % 6, F.lit(0))), (v < 244, (div((v - 180) % 64, 16), div((v - 180) % 16, 4), (v - 180) % 4, F.lit(0))), (F.lit(True), (div(v - 244, 3), (v - 244) % 3, F.lit(0), F.lit(0)))]
    pick = lambda rules, get: F.when(rules[0][0], get(0)).when(rules[1][0], get(1)).otherwise(get(2))
    lengths = [F.when(right, pick(inten, lambda r: inten[r][1][k])).otherwise(pick(normal, lambda r: normal[r][1][k])) for k in range(4)]
    row = F.when(right, pick(inten, lambda r: F.lit(3 + r))).otherwise(pick(normal, lambda r: F.lit(r)))
    return lengths, row.cast("int"), ~right & (s >= 500)


def permuted(order: list[int], at: Column) -> Column:
    """A permutation given as a list, at a position."""
    return F.get(F.array(*map(F.lit, order)), at)


def overlapped(halves: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, by, now, tail: lists): v = now + the tail of the granule before, if that is the neighbour."""
    o = Window.partitionBy(*keys).orderBy(by)
    last = F.when(F.lag(by).over(o) == F.col(by) - 1, F.lag("tail").over(o))
    t = halves.withColumn("_last", last)
    return t.withColumn("v", F.when(F.col("_last").isNull(), F.col("now")).otherwise(F.zip_with("now", "_last", lambda a, b: a + b))).drop("_last")
