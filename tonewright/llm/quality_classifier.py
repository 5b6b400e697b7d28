"""Quality classifier: logistic regression on hashed word uni- and bigrams, trained with FTRL-proximal updates.

Training takes a bounded sample of the labelled documents (``max_rows``, by hash
of the id; a documented parameter) in ``SHARDS`` shards: each runs FTRL over its
documents, and the shards' weights are averaged. Every text is then scored whole
as a sparse dot product with a model of fixed size.

Null and empty texts get the score of the bias alone. Repeated rows are scored
alike; rows without an id are scored and never learnt from; labels that are null are not learnt from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


BITS = 18
MAX_ROWS = 20_000
SHARDS = 8
SHARD_BYTES = 1 << 25
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.5
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.3
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 other marks. A word is a run of one kind.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[np.r_[48:58, 65:91, 97:123, 128:256]] = 1
_PRIME = np.uint64(0x100000001B3)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def hashed_features(data: np.ndarray, ends: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of lower-cased word uni- and bigrams, and the document of each.

    data: the texts' bytes, one after another; ends: where each text ends.
    """
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    kind = _KIND[data]
    solid = kind > 0
    first = np.r_[True, kind[1:] != kind[:-1]]
    cuts = ends[ends < len(data)]
    first[cuts] = True
    begin = np.flatnonzero(solid & first)
    if not len(begin):
        return none, none
    where = np.flatnonzero(solid)
    word = np.cumsum((solid & first)[where]) - 1
    place = where - begin[word]
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), _PRIME, np.uint64)])
    h = np.add.reduceat((_LOWER[data[where]].astype(np.uint64) + np.uint64(1)) * powers[place], np.flatnonzero(place == 0))
    h = _mix(h)
    doc = np.searchsorted(ends, begin, side="right")
    same = doc[1:] == doc[:-1]
    two = _mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    two = np.where(h[1:] == h[:-1], np.uint64(0x9E3779B97F4A7C15), two)[same]  # a word and itself: one bigram for all words
    index = np.r_[h, two] >> np.uint64(64 - bits)
    return index.astype(np.int64), np.r_[doc, doc[1:][same]]


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about a megabyte: first row, bytes, ends within them."""
    column = pa.array(column.to_pylist(), pa.large_string()) if column.offset else column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, data[offsets[row] : offsets[to]], (offsets[row + 1 : to + 1] - offsets[row])
        row = to


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, doc_id, label, text) to (shard, doc_id, label, features)."""
    for b in batches:
        found: list[np.ndarray] = []
        for _, data, ends in _chunks(b.column(3)):
            index, doc = hashed_features(data, ends)
            order = np.argsort(doc, kind="stable")
            found += np.split(index[order].astype(np.int32), np.cumsum(np.bincount(doc, minlength=len(ends)))[:-1])
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(found, pa.list_(pa.int32()))], names=["shard", "doc_id", "label", "features"])


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (2^bits, and the bias last) after FTRL-proximal updates over (indexes, values, label, importance)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    bias, rng = 1 << bits, np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            i, x, y, c = examples[k]
            i, x = np.r_[i, bias], np.r_[x, 1.0]
            w = weight(i)
            g = c * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weight(np.arange(len(z)))


def _values(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, c = np.unique(features, return_counts=True)
    return i, c / max(len(features), 1) ** 0.5


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id", kind="stable")
    ones = rows["label"].mean()
    importance = {1: 0.5 / max(ones, 0.02), 0: 0.5 / max(1 - ones, 0.02)}  # either class counts alike
    examples = [(*_values(np.asarray(f)), int(y), importance[int(y)]) for f, y in zip(rows["features"], rows["label"])]
    return pd.DataFrame({"weights": [train_ftrl(examples).astype(np.float32).tobytes()], "n": [len(rows)]})


def in_fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Averaged weights of the shards; zeros where there is nothing to learn from."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    usable = labels.where((in_fold(F.col("doc_id")) != HELD_FOLD) & F.col("label").isin(0, 1))
    # of labels that disagree about a document the more frequent one counts, and none where both are as frequent
    usable = usable.groupBy("doc_id").agg(F.avg("label").alias("mean")).where("mean <> 0.5").select("doc_id", (F.col("mean") > 0.5).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows pairs of numbers
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id")
    total = joined.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-total // SHARD_BYTES))  # what one task learns from is bounded in bytes
    joined = joined.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"), "doc_id", "label", "text")
    features = joined.mapInArrow(_features_of, "shard bigint, doc_id bigint, label int, features array<int>")
    models = features.groupBy("shard").applyInPandas(_train_shard, "weights binary, n bigint").collect()  # SHARDS models of fixed size
    if not models:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.average([np.frombuffer(m["weights"], np.float32) for m in models], axis=0, weights=[m["n"] for m in models]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score: probability of label 1, as a sparse dot product over each whole text."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            out = np.zeros(b.num_rows)
            for row, data, ends in _chunks(b.column(1)):
                index, doc = hashed_features(data, ends)
                total = np.bincount(doc, weights=w[index], minlength=len(ends))
                count = np.bincount(doc, minlength=len(ends))
                out[row : row + len(ends)] = total / np.sqrt(np.maximum(count, 1))
            p = 1 / (1 + np.exp(-np.clip(out + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, max_rows))
    return scored.select(
        "doc_id", F.coalesce(in_fold(F.col("doc_id")) == HELD_FOLD, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
