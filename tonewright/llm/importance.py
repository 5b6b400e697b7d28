"""Importance resampling towards a target distribution.

Documents become a sparse matrix of documents by hashed features, kept as blocks in compressed sparse row form and written
once. Column sums of the corpus and of the target texts give two distributions over the buckets; the gain of a bucket
is the logarithm of their smoothed ratio. The matrix times the gains gives every document's weight, a Gumbel
variate drawn from its id is added, and the highest scores are drawn without replacement.

Words are runs of 0-9, letters with A-Z folded, and all beyond ASCII; features are runs of up to ``longest`` words joined by one space, repeats
counted; a bucket is the unsigned CRC-32 of a feature's UTF-8 bytes modulo ``buckets``.

Null and empty texts have no features, weigh 0 and are never drawn, as are all of fewer than ``least_words`` words. A row without
an id has the variate of an empty id and ranks after rows with ids. Repeated rows are rows of their own: ties go to the smaller id, then to more features, and rows equal in both are
told apart in no other way. With an empty target its counts are 0; an empty table gives an empty result. Extra columns are ignored.

At scale: one pass over the texts; what leaves it is a few bytes a distinct feature. Of each task at most ``buckets`` sums are shuffled. The gains
(``buckets`` numbers) go with the task. Scores are whole numbers between about -70 000 and 70 000 whatever the corpus, so their counts fit on
the driver; only rows at or above the score where the draw ends are sorted, in ranges, and their ranks are offsets of the ranges.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytewise
from .bytewise import Texts
from .common import materialize

#: Entries of a block of the matrix, beyond which it is closed; a document is never cut, and has at most ``buckets``.
BLOCK = 1 << 17
LOCKSTEP = 48
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x30:0x3A] = np.arange(0x30, 0x3A)
_KEEP[0x41:0x5B] = np.arange(0x61, 0x7B)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)

CSR = "doc_ids array<bigint>, n_words array<int>, indptr array<int>, columns array<int>, counts array<int>"


class Csr(NamedTuple):
    """Rows of the matrix: row r has the entries ``indptr[r]:indptr[r + 1]`` of columns and counts."""

    n_words: np.ndarray
    indptr: np.ndarray
    columns: np.ndarray
    counts: np.ndarray


def alphanumeric(t: Texts) -> Texts:
    """The texts with A-Z folded and all that stands in no word as spaces."""
    return t._replace(data=_KEEP[t.data])


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each range of bytes: all ranges one byte forward at a time, long ones by themselves."""
    size = ends - starts
    short = np.flatnonzero(size <= LOCKSTEP)
    order = short[np.argsort(-size[short].astype(np.int16), kind="stable")]
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.cumsum(np.bincount(size[order], minlength=LOCKSTEP + 1)[::-1])[::-1]  # of each size or more
    for k in range(LOCKSTEP):
        n = live[k + 1] if k < LOCKSTEP else 0
        if not n:
            break
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out = np.zeros(len(size), np.uint32)
    out[order] = ~crc
    for k in np.flatnonzero(size > LOCKSTEP):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes())
    return out


def _joined(data: np.ndarray, w: bytewise.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one space apart: bytes, starts, ends."""
    size = w.ends - w.starts
    starts = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    off = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(starts, size) + off] = data[np.repeat(w.starts, size) + off]
    return out, starts, starts + size


def csr(t: Texts, buckets: int, longest: int = 1) -> Csr:
    """The matrix of some texts."""
    t = alphanumeric(t)
    w = bytewise.words(t)
    n_words = np.diff(w.edges)
    data, starts, ends = (t.data, w.starts, w.ends) if longest == 1 else _joined(t.data, w)
    row = np.repeat(np.arange(len(n_words)), n_words)
    rows, found = [], []
    for n in range(1, longest + 1):
        inside = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else row[:0]
        rows.append(row[inside])
        found.append(crc32_ranges(data, starts[inside], ends[inside + n - 1]))
    cell = np.concatenate(rows) * buckets + np.concatenate(found) % np.uint32(buckets)
    cell, counts = np.unique(cell, return_counts=True)
    return Csr(n_words, np.searchsorted(cell, np.arange(len(n_words) + 1) * buckets), cell % buckets, counts)


def _stacked(parts: list[tuple[pa.Array, Csr]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(c.columns) for _, c in parts)])
    indptr = np.concatenate([np.zeros(1, np.int64), *(c.indptr[1:] + e for (_, c), e in zip(parts, ends))])
    lists = [np.concatenate([c.n_words for _, c in parts]), indptr, np.concatenate([c.columns for _, c in parts]), np.concatenate([c.counts for _, c in parts])]
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    arrays = [one(pa.concat_arrays([i for i, _ in parts])), *(one(pa.array(x, pa.int32())) for x in lists)]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_ids", "n_words", "indptr", "columns", "counts"])


def _blocks(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for t in bytewise.texts(b.column(1)):
                c = csr(t, buckets, longest)
                parts.append((b.column(0).slice(t.first, t.after - t.first), c))
                held += len(c.columns) + len(c.n_words)
                if held >= BLOCK:
                    yield _stacked(parts)
                    parts, held = [], 0
        if parts:
            yield _stacked(parts)

    return run


def feature_matrix(docs: DataFrame, id_column: str = "doc_id", buckets: int = 10000, longest: int = 1) -> DataFrame:
    """The documents by buckets as blocks of compressed sparse rows, one block a row of the table, written to the shared folder."""
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_blocks(buckets, longest), CSR), "csr")


def _read(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, Csr]]:
    lists = [b.column(b.schema.get_field_index(n)) for n in ("doc_ids", "n_words", "indptr", "columns", "counts")]
    for k in range(b.num_rows):
        ids, *rest = (x[k].values for x in lists)
        yield ids, Csr(*(np.asarray(x, np.int64) for x in rest))


def column_sums(matrix: DataFrame, buckets: int = 10000) -> np.ndarray:
    """The features of all documents in each bucket. Every task sends its own sums; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, c in _read(b):
                total += np.bincount(c.columns, c.counts, buckets).astype(np.int64)  # a block's sums are far below 2^53
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("doc_ids", "n_words", "indptr", "columns", "counts").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of the corpus, each count one higher."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def variate(seed: str, doc_id: int | None) -> int:
    """A Gumbel variate in thousandths that depends on the seed and the id alone."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(c: Csr, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each row, and the floored mean of their gains: the matrix times the gains over its row sums."""
    sums = [np.diff(np.r_[0, np.cumsum(x)][c.indptr]) for x in (c.counts, c.counts * gain[c.columns])]
    return sums[0], sums[1] // np.maximum(sums[0], 1)


_SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def scored_documents(matrix: DataFrame, gain: np.ndarray, seed: str = "2024") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, c in _read(b):
                n, weight = weights(c, gain)
                score = weight + np.array([variate(seed, i) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (c.n_words, n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return materialize(matrix.select("doc_ids", "n_words", "indptr", "columns", "counts").mapInArrow(run, _SCORED), "scored")


def draw_highest(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """The scored documents with rank: 1, 2, 3... of the drawn by score, null of the rest."""
    spark = scored.sparkSession
    may = F.col("n_words") >= least_words
    counts = sorted(((r.score, r["count"]) for r in scored.where(may).groupBy("score").count().collect()), reverse=True)
    most = percent * sum(n for _, n in counts) // 100
    seen, last = 0, None
    for last, n in counts:
        seen += n
        if seen >= most:
            break
    if not most:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    near = may & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    dealt = scored.where(near).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(dealt.withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    ranges = sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a shuffle partition
    before = np.cumsum([0, *(n for _, n in ranges)]).tolist()
    offsets = spark.createDataFrame([(p, n) for (p, _), n in zip(ranges, before)], "part bigint, before bigint")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank", F.when(rank <= most, rank)).select(*scored.columns, "rank")
    return scored.where(~near).withColumn("rank", F.lit(None).cast("bigint")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, target_id: str = "item_id", buckets: int = 10000, longest: int = 1, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null if not drawn)."""
    matrix = feature_matrix(docs, "doc_id", buckets, longest)
    # an id of the target plays no part
    wanted = feature_matrix(target.select(F.lit(None).cast("bigint").alias(target_id), "text"), target_id, buckets, longest)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    return draw_highest(scored_documents(matrix, gain, seed), percent, least_words)


#: crc32 by a table made in SQL, over the distinct words only.
ORACLE_SQL = r"""
WITH bits AS (SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END) AS v FROM range(256) r(n)),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits),
texts AS (
  SELECT 0 AS part, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT part, id, unnest(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
counted AS (SELECT part, id, w, count(*) AS n FROM words GROUP BY ALL),
hashed AS (
  SELECT w, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1)::UBIGINT * 16 + (strpos('0123456789ABCDEF', h[i + 1]) - 1)::UBIGINT)),
    lambda a, b: xor(t[(xor(a, b) % 256 + 1)::BIGINT], a // 256)), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM counted)), crc),
cells AS (SELECT part, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (w) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (part = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (part = 1), 0)::BIGINT AS t FROM cells GROUP BY bucket),
wholes AS (SELECT sum(s)::BIGINT AS s_all, sum(t)::BIGINT AS t_all FROM sums),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS g FROM sums, wholes),
weighed AS (SELECT id, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM cells JOIN gain USING (bucket) WHERE part = 0 GROUP BY id),
drawn AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, substr(sha256('2024:' || doc_id), 1, 8) AS h FROM documents LEFT JOIN weighed ON doc_id = id),
scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', h[i]) - 1) * 16 ** (8 - i)))::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM drawn),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS m FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * m // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
