"""The masking model's formulas as column expressions, and as numbers for dimension tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession, DataFrame, functions as F


def bark(f: float) -> float:
    return 13.0 * math.atan(0.00076 * f) + 3.5 * math.atan((f / 7500.0) ** 2)


def spreading(dz: float) -> float:
    """Linear power that a masker ``dz`` Bark below spreads; zero under -60 dB."""
    t = dz + 0.474
    db = 15.81 + 7.5 * t - 17.5 * math.sqrt(1.0 + t * t)
    return 0.0 if db < -60.0 else 10.0 ** (db / 10.0)


def bark_column(f: Column) -> Column:
    return 13.0 * F.atan(0.00076 * f) + 3.5 * F.atan(F.pow(f / 7500.0, F.lit(2.0)))


def quiet_db_column(f: Column) -> Column:
    """Threshold in quiet, dB, at most 110."""
    k = F.greatest(f, F.lit(20.0)) / 1000.0
    db = 3.64 * F.pow(k, F.lit(-0.8)) - 6.5 * F.exp(-0.6 * F.pow(k - 3.3, F.lit(2.0))) + 0.001 * F.pow(k, F.lit(4.0))
    return F.least(db, F.lit(110.0))


def band_dimension(spark: SparkSession, edges: tuple[int, ...], line_hz: float) -> DataFrame:
    """(band, lo, hi, z): a table of at most 22 rows."""
    rows = [(b, lo, hi, bark((lo + hi) * 0.5 * line_hz)) for b, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "band int, lo int, hi int, z double")


def spreading_matrix(edges: tuple[int, ...], line_hz: float) -> tuple[list[float], list[list[float]]]:
    """Bark centres of the bands, and how much each band's energy counts in each band's threshold, normalised."""
    z = [bark((lo + hi) * 0.5 * line_hz) for lo, hi in zip(edges, edges[1:])]
    width = [hi - lo for lo, hi in zip(edges, edges[1:])]
    rows = []
    for b in range(len(z)):
        raw = [spreading(z[b] - z[j]) for j in range(len(z))]
        norm = sum(r * w for r, w in zip(raw, width)) / width[b]
        rows.append([r / norm for r in raw])
    return z, rows


def spreading_dimension(spark: SparkSession, edges: tuple[int, ...], line_hz: float) -> DataFrame:
    """(band, masker, weight): how much a masker band's energy counts in a band's threshold, normalised; at most 22 x 22 rows."""
    _, weights = spreading_matrix(edges, line_hz)
    return spark.createDataFrame([(b, j, w) for b, row in enumerate(weights) for j, w in enumerate(row) if w], "band int, masker int, weight double")


def tonality(geometric: Column, arithmetic: Column) -> Column:
    """0 (noise) to 1 (tone) from the flatness of a band."""
    db = 10.0 * F.log10(geometric / arithmetic)
    return F.least(F.greatest(db / -25.0, F.lit(0.0)), F.lit(1.0))


def masking_offset(tonal: Column, z: Column) -> Column:
    return tonal * (14.5 + z) + (1.0 - tonal) * 5.5
