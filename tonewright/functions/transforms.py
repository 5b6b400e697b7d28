"""Block transforms over rows with a list of lines or samples: a batch of rows times a matrix of formulas; and what else is row by row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


@lru_cache(maxsize=8)
def imdct_matrix(n: int) -> np.ndarray:
    """(n, n/2): the inverse transform of n/2 lines to n windowed samples."""
    i, k = np.arange(n)[:, None], np.arange(n // 2)
    return np.cos(np.pi / (2 * n) * (2 * i + 1 + n // 2) * (2 * k + 1)) * np.sin(np.pi / n * (i + 0.5))


def _times(rows: DataFrame, keys: list[str], column: str, matrix: np.ndarray) -> DataFrame:
    """Each row's list times a matrix, a batch at a time: no row leaves its place, so nothing is shuffled."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(column, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = np.asarray(b.column(len(keys)).flatten(), float).reshape(b.num_rows, -1) @ matrix.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), lists], names=[*keys, column])

    return rows.select(*keys, column).mapInArrow(run, schema)


def inverse_mdct(blocks: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """(keys, list of n/2 lines) to (keys, list of n windowed samples)."""
    return _times(blocks, keys, column, imdct_matrix(n))


def forward_mdct(blocks: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """(keys, list of n samples) to (keys, list of n/2 lines), scaled by 4/n."""
    return _times(blocks, keys, column, imdct_matrix(n).T * (4 / n))


def short_order(edges: tuple[int, ...]) -> list[int]:
    """Where each of 576 coded lines of a short block (band, window, line) goes: line f of window w to (f div 6) * 18 + 6 w + f mod 6."""
    return [(f // 6) * 18 + 6 * w + f % 6 for a, b in zip(edges, edges[1:]) for w in range(3) for f in range(a, b)]


def power_43(x: Column) -> Column:
    """sign(x) |x|^(4/3)"""
    return F.signum(x) * F.pow(F.abs(x).cast("double"), F.lit(4.0 / 3.0))


def step_gain(global_gain: Column, scalefactor: Column, coarse: Column, pretab: Column, subblock: Column) -> Column:
    """2^((gain - 210)/4 - 2 subblock - (1/2 or 1)(scalefactor + pretab))"""
    return F.pow(F.lit(2.0), (global_gain - 210) / 4.0 - 2.0 * subblock - F.when(coarse, 1.0).otherwise(0.5) * (scalefactor + pretab))


def quantised(x: Column, step: Column) -> Column:
    """floor(|x|^(3/4) 2^(-3 step / 16) + 0.4054)"""
    return F.floor(F.pow(F.abs(x), F.lit(0.75)) * F.pow(F.lit(2.0), -3.0 * step / 16.0) + F.lit(0.4054))
