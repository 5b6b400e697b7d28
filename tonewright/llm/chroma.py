"""Chroma fingerprints of media columns, and their alignment.

A recording's spectrum is folded into twelve pitch classes per frame; sixteen
integral-image filters over that picture, two bits each, pack into one 32-bit
integer per frame. Recordings may align where integers meet that differ in at most one bit. The meetings of two recordings make a histogram of
offsets; a pair is one row with its histogram and both sequences, and every offset that has a meeting, the most frequent first, is judged by the share of differing bits over its
overlap; the best of those that pass is the link. Where an integer stands still for more than ``STILL`` frames (silence, a held chord) the first ``STILL`` are looked up.

Recordings with equal fingerprints form a class, and classes are compared by
their first member, so a group of copies costs one comparison. Null, empty and too
short recordings have no integers and align with nothing; they form one class.
Repeated rows are members of one class. Extra columns are ignored. Queries are all
rows whose id is divisible by ``QUERY_STEP``, against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

FRAME, HOP = 1024, 256
LOWEST, HIGHEST = 55.0, 1760.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
CLASSES = 12
THRESHOLDS = (-0.3, 0.0, 0.3)
STILL = 4
LEAST_OVERLAP = 16
MOST_ERRORS = 0.15  # unlike tunes differ in a quarter of their bits or more, wherever they are laid
QUERY_STEP = 50
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters: each kind at several places and widths."""
    return [(k % 4, (5 * k) % 7, 4 + k % 3, (3, 6, 10, 15)[(k // 4 + k) % 4]) for k in range(16)]


@lru_cache(maxsize=8)
def _fold(rate: int) -> np.ndarray:
    """Spectrum bins to pitch classes."""
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    table = np.zeros((len(f), CLASSES))
    used = np.flatnonzero((f >= LOWEST) & (f <= min(HIGHEST, rate / 2)))
    table[used, np.round(12 * np.log2(f[used] / 440.0)).astype(int) % CLASSES] = 1.0
    return table


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Pitch-class frames (frames x 12), smoothed over time and scaled to unit length."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    window = np.hanning(FRAME)
    out = []
    views = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, len(views), 256):  # bounded memory for long recordings
        out.append((np.abs(np.fft.rfft(views[at : at + 256] * window)) ** 2) @ _fold(rate))
    image = np.concatenate(out)
    if len(image) < len(SMOOTH):
        return np.zeros((0, CLASSES))
    image = sum(w * image[k : len(image) - len(SMOOTH) + 1 + k] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, image / np.maximum(norm, 1e-6), 0.0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer per frame that has all filters' frames ahead of it."""
    widest = max(w for *_, w in filters())
    n = len(image) - widest + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    start = np.arange(n)

    def area(t0, t1, p0, p1):
        return total[start + t1, p1] - total[start + t0, p1] - total[start + t1, p0] + total[start + t0, p0]

    codes = np.zeros(n, np.uint32)
    for kind, p, h, w in filters():
        top, half, mid, third = p + h, w // 2, p + h // 2, w // 3
        if kind == 0:  # later against earlier
            parts = [(half, w, p, top)]
        elif kind == 1:  # higher against lower
            parts = [(0, w, mid, top)]
        elif kind == 2:  # the diagonal quarters against the others
            parts = [(0, half, p, mid), (half, w, mid, top)]
        else:  # the middle third of the frames against the outer ones
            parts = [(third, w - third, p, top)]
        size = sum((t1 - t0) * (p1 - p0) for t0, t1, p0, p1 in parts)
        a = sum(area(*x) for x in parts)
        value = np.log((0.02 + a / size) / (0.02 + (area(0, w, p, top) - a) / (w * h - size)))
        codes = codes << np.uint32(2) | GRAY[np.digitize(value, THRESHOLDS)]
    return codes


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for rate, pcm in zip(b.column(1).to_pylist(), b.column(2)):
            raw = pcm.as_py() or b""
            samples = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64) / 32768
            found.append(fingerprint(chroma(samples, rate)).view(np.int32) if rate else np.zeros(0, np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["media_id", "codes"])


def fingerprint_media(media: DataFrame) -> DataFrame:
    """(media_id, rate, pcm: 16-bit little-endian mono) to (media_id, codes)."""
    rows = media.select(F.col("media_id").cast("bigint"), F.col("rate").cast("int"), F.col("pcm").cast("binary"))
    return rows.mapInArrow(_fingerprints, "media_id bigint, codes array<int>")


def align(mine: np.ndarray, other: np.ndarray, offsets: list[int]) -> tuple[int, int, float] | None:
    """The best of the offsets that pass, as (offset, overlap, share of differing bits): fewest errors, then longest overlap, then nearest to no offset, then the smaller."""
    best = None
    for off in offsets:
        a, b = max(off, 0), max(-off, 0)
        n = min(len(mine) - a, len(other) - b)
        if n < LEAST_OVERLAP:
            continue
        wrong = int(np.bitwise_count(mine[a : a + n] ^ other[b : b + n]).sum())
        if wrong <= MOST_ERRORS * 32 * n:
            found = (wrong / (32 * n), -n, abs(off), off)
            best = found if best is None or found < best else best
    return best and (best[3], -best[1], best[0])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(asker, class_id, offsets of the histogram, codes of both), a row a pair, to the pairs that align."""
    for b in batches:
        rows = []
        for k, (asker, other_id) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            offsets, mine, other = (np.asarray(b.column(c)[k].values) for c in (2, 3, 4))
            found = align(mine.view(np.uint32), other.view(np.uint32), offsets.tolist())
            if found:
                rows.append((asker, other_id, *found))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["asker", "class_id", "offset", "overlap", "bit_errors"])


def match_media(prints: DataFrame) -> DataFrame:
    """One row per recording: media_id, class_id, n_codes, codes_sha256, n_links and links of its class.

    links: (class_id, offset, overlap, bit_errors) of each class that aligns with it, for classes
    that hold a query; offset is how many frames later the query's code stands.
    """
    prints = materialize(prints.withColumn("codes_sha256", F.sha2(F.to_json("codes").cast("binary"), 256)), "prints")
    query = (F.pmod("media_id", F.lit(QUERY_STEP)) == 0).cast("int")
    classes = prints.groupBy("codes_sha256").agg(F.min("media_id").alias("class_id"), F.max(query).alias("query"), F.first("codes").alias("codes"))
    classes = materialize(classes, "classes")
    still = " AND ".join(f"codes[i - 1] = codes[i - {1 + k}]" for k in range(1, STILL + 1))
    run = F.expr(f"filter(transform(sequence(1, size(codes)), i -> struct(i AS at, codes[i - 1] AS key, i > {STILL} AND {still} AS still)), p -> NOT p.still)")
    posts = classes.where(F.size("codes") > 0).select("class_id", "query", F.explode(run).alias("p"))
    posts = posts.select("class_id", "query", F.col("p.key").alias("key"), F.col("p.at").alias("at"))
    near = F.explode(F.expr("transform(sequence(-1, 31), k -> IF(k < 0, key, key ^ shiftleft(1, k)))"))
    asked = posts.where("query = 1").select(F.col("class_id").alias("asker"), near.alias("key"), F.col("at").alias("asked_at"))
    meetings = posts.drop("query").join(asked, "key").where("class_id <> asker")
    counted = meetings.groupBy("asker", "class_id", (F.col("asked_at") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    histograms = counted.groupBy("asker", "class_id").agg(F.sort_array(F.collect_list(F.struct("n", "offset")), asc=False).alias("histogram"))
    codes = classes.select("class_id", "codes")
    pairs = histograms.join(codes.select(F.col("class_id").alias("asker"), F.col("codes").alias("mine")), "asker").join(codes.withColumnRenamed("codes", "other"), "class_id")
    best = pairs.select("asker", "class_id", "histogram.offset", "mine", "other").mapInArrow(_aligned, "asker bigint, class_id bigint, offset int, overlap int, bit_errors double")
    links = best.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", "overlap", "bit_errors"))).alias("links"))
    members = prints.select("media_id", F.size("codes").alias("n_codes"), "codes_sha256").join(classes.select("codes_sha256", "class_id"), "codes_sha256")
    done = members.join(links, members["class_id"] == links["asker"], "left")
    return done.select("media_id", "class_id", "n_codes", "codes_sha256", F.coalesce(F.size("links"), F.lit(0)).alias("n_links"), "links")


RATE, NOTE = 4000, 256


def melody(vector: np.ndarray, rate: int = RATE, note: int = NOTE) -> np.ndarray:
    """A vector as a tune: each component, against the largest, is a note of two octaves and a second part a fifth above every fourth."""
    top = np.abs(vector).max(initial=0)
    if not top:
        return np.zeros(0, np.int16)
    steps = np.repeat(np.round(12 * vector / top), note)
    phase = np.cumsum(2 * np.pi * 220.0 * 2 ** (steps / 12) / rate)
    loud = np.where(np.arange(len(steps)) // note % 4 == 0, 0.3, 0.0)
    return np.round(12000 * (np.sin(phase) + loud * np.sin(1.5 * phase))).astype("<i2")


#: Every so manieth vector is played a second time, from its eighth to a fifth-last note, quieter and with noise.
EXCERPT_STEP = 25


def excerpt(tune: np.ndarray, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    part = tune[8 * NOTE + int(r.integers(NOTE)) : -5 * NOTE]
    return np.clip(np.round(part * r.uniform(0.5, 0.9) + r.normal(0, 700, len(part))), -32768, 32767).astype("<i2")


def render_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) to a media table (media_id, rate, pcm): each vector as a tune, and under -1 - vec_id an excerpt of those whose id is divisible by ``EXCERPT_STEP``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                tunes = [melody(np.nan_to_num(np.array([x or 0.0 for x in v], dtype=np.float64))) if v else None for v in part.column(1).to_pylist()]
                rows = list(zip(part.column(0).to_pylist(), tunes))
                rows += [(-1 - k, excerpt(t, k)) for k, t in rows if k is not None and t is not None and k >= 0 and k % EXCERPT_STEP == 0]
                pcm = [None if t is None else t.tobytes() for _, t in rows]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([RATE] * len(pcm), pa.int32()), pa.array(pcm, pa.binary())], names=["media_id", "rate", "pcm"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "media_id bigint, rate int, pcm binary")
