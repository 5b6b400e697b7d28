"""Ordered rows in chunks: what lets one long stream spread over many tasks.

    with_halo   chunks of a sequence, each with copies of the few rows before it: for sums and transforms with a bounded look-back
    runs        the rows of one chunk at a time, whatever the Arrow batches
    scan        a recursion without bound as a parallel prefix: each chunk is summed up as a function of the state before it,
                the functions are composed in order (a row a chunk), and every chunk runs from its own state
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = "_chunk"


def with_halo(rows: DataFrame, keys: list[str], by: str, size: int, halo: int) -> DataFrame:
    """The rows in chunks of ``size`` of the whole number ``by``, and before each chunk copies of the ``halo`` (at most ``size``) rows ahead of it; a chunk in one task, in order."""
    mine = F.floor(F.col(by) / size).cast("bigint")
    chunks = F.when(F.pmod(F.col(by), F.lit(size)) >= size - halo, F.array(mine, mine + 1)).otherwise(F.array(mine))
    return in_order(rows.withColumn(CHUNK, F.explode(chunks)), [*keys, CHUNK], by)


def in_order(rows: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Rows by keys, sorted. Spark may merge small partitions; four times the cores made encoding of eight streams slower by a fifth."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *by)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut where one of the first ``keys`` columns changes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in range(keys):
            c = b.column(k)
            none = c.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
        if held:
            new[0] = any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in range(keys))
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                if held and new[lo]:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one width as rows of an array."""
    return np.asarray(column.flatten(), float).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of an array as a column of lists."""
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1), kind or pa.from_numpy_dtype(rows.dtype))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)


def scan(rows: DataFrame, keys: list[str], by: str, columns: list[str], size: int, start, summarise: Callable, compose: Callable, apply: Callable, out: T.StructField) -> DataFrame:
    """``rows`` (keys, by, columns) with a column more, of a recursion over each sequence in the order of ``by``.

    ``by`` counts from 0 or 1 without gaps beyond ``size``. ``start`` is the state before the first row. ``summarise(columns as lists)`` gives a chunk's function of the state,
    ``compose(state, function)`` the state behind it, ``apply(state, columns as lists)`` a chunk's results. States and functions travel as
    JSON, one row a chunk; the pass over these is in order, all else is parallel over chunks.
    """
    import json

    mine = F.floor(F.col(by) / size).cast("bigint").alias(CHUNK)
    cut = in_order(rows.select(*keys, mine, by, *columns), [*keys, CHUNK], by)
    n, at = len(keys), len(keys) + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, n + 1):
            said = json.dumps(summarise(*(b.column(k).to_pylist() for k in range(at, at + len(columns)))))
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(0, 1) for k in range(n + 1)), pa.array([said])], names=[*keys, CHUNK, "function"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start
        for b in batches:
            said, names = [], b.schema.names
            for row in zip(*(b.column(k).to_pylist() for k in range(n + 2))):
                if row[:n] != last:
                    last, state = row[:n], start
                said.append(json.dumps(state))
                state = compose(state, json.loads(row[-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(n + 1)), pa.array(said, pa.string())], names=[*names[: n + 1], "state"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, n + 1):
            got = apply(json.loads(b.column(b.num_columns - 1)[0].as_py()), *(b.column(k).to_pylist() for k in range(at, at + len(columns))))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1) if k != n), pa.array(got, kind)], names=[*(x for k, x in enumerate(b.schema.names[:-1]) if k != n), out.name])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(out.dataType)
    key_fields = [rows.schema[k] for k in keys]
    functions = cut.mapInArrow(sums, T.StructType([*key_fields, T.StructField(CHUNK, T.LongType()), T.StructField("function", T.StringType())]))
    before = in_order(functions, keys, CHUNK).mapInArrow(states, T.StructType([*key_fields, T.StructField(CHUNK, T.LongType()), T.StructField("state", T.StringType())]))
    same = [cut[k].eqNullSafe(before[k]) for k in (*keys, CHUNK)]
    joined = cut.join(before, [*same], "inner").select(*(cut[c] for c in cut.columns), before["state"])
    joined = in_order(joined, [*keys, CHUNK], by)
    return joined.mapInArrow(results, T.StructType([*(f for f in cut.schema if f.name != CHUNK), out]))
