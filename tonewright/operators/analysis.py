"""The encoder's analysis as steps: samples to subbands and attacks, subbands to lines and masks, lines to whole numbers.

    subband_granules, attack_flags   chunks of samples with a halo, any of them in any task
    lines_and_masks                  a granule with the one before it to 576 lines by block type, low-passed, and its allowed noise
    granules, forward_hybrid         the same transforms over rows of subbands
    quantise_lines                   lines and allowed noise per band to whole numbers, scalefactors and a global gain

What a granule gives depends on its own samples and a fixed number before them, so it is the same in a batch and in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tables import PRETAB
from . import filterbank, ordered
from .layer3 import Codes, _transforms, layout, order
from .psychoacoustics import Model, attack, segment_energies
from .quantiser import MOST_VALUE, VARIANTS_LONG, Books, Rows, cells  # noqa: F401

SLOTS, LINES = 18, 576
#: Slots that a granule needs before its own: the granule before, and the filterbank's look-back.
HALO = SLOTS + filterbank.SLOTS - 1
#: Samples that the energies of a granule need: 225 and two segments before it, and one for the first difference.
BEFORE, AHEAD = 225 + 128 + 1, 351
CHUNK = SLOTS * 32


def inverted(bands: np.ndarray) -> np.ndarray:
    """(18 n, 32) subband slots to (n, 576), subband by subband, odd samples of odd subbands with their signs turned."""
    x = bands.reshape(-1, SLOTS, 32).swapaxes(1, 2).copy()
    x[:, 1::2, 1::2] *= -1
    return x.reshape(-1, LINES)


def subbands_of(samples: np.ndarray, prototype: np.ndarray) -> np.ndarray:
    """Samples of whole granules with 480 before them to (n, 576) subbands in single precision."""
    return inverted(filterbank.analyse_run(samples.reshape(-1, 32), prototype).astype(np.float32))


def energies_of(samples: np.ndarray) -> np.ndarray:
    """(n, 9) segment energies of granules, of samples from ``BEFORE`` ahead of the first to ``AHEAD`` into the last."""
    n = (len(samples) - BEFORE - AHEAD) // LINES + 1
    return segment_energies(np.lib.stride_tricks.sliding_window_view(samples, BEFORE + AHEAD)[::LINES][:n])


def _chunks(blocks: DataFrame) -> DataFrame:
    return ordered.with_halo(blocks.select("stream_id", F.col("channel").cast("int").alias("channel"), F.col("slot").cast("bigint").alias("slot"), "s"), ["stream_id", "channel"], "slot", CHUNK, HALO)


def _per_chunk(chunks: DataFrame, schema: str, step) -> DataFrame:
    """step(samples with the halo before them, first granule) to the columns behind stream_id, channel and granule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in ordered.runs(batches, 3):
            chunk = b.column(2)[0].as_py()
            own = int((b.column(3).to_numpy() // CHUNK == chunk).sum())
            n, first = own // SLOTS, chunk * CHUNK // SLOTS
            if n:
                x = ordered.matrix(b.column(4), 32)
                x = np.r_[np.zeros((max(0, own + HALO - len(x)), 32)), x][: HALO + n * SLOTS]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(0, 1).take(pa.array(np.zeros(n, int))) for k in (0, 1)), pa.array(first + np.arange(n)), *step(x.reshape(-1), first)], names=[c.split()[0] for c in schema.split(", ")])

    return chunks.select("stream_id", "channel", ordered.CHUNK, "slot", "s").mapInArrow(run, schema)


def subband_granules(blocks: DataFrame, prototype: np.ndarray) -> DataFrame:
    """(stream_id, channel, slot, s: 32 samples) to (stream_id, channel, granule, v): the subbands of the granule before and of its own, 576 each."""
    prototype = np.asarray(prototype, float)

    def step(x: np.ndarray, first: int) -> list[pa.Array]:
        v = subbands_of(x, prototype)
        return [ordered.lists(np.c_[v[:-1], v[1:]])]

    return _per_chunk(_chunks(blocks), "stream_id string, channel int, granule bigint, v array<float>", step)


def attack_flags(blocks: DataFrame) -> DataFrame:
    """(stream_id, channel, slot, s: samples) to (stream_id, granule, attack): of either channel."""

    def step(x: np.ndarray, first: int) -> list[pa.Array]:
        at = HALO * 32 - LINES - BEFORE
        e = energies_of(x[at : len(x) - LINES + AHEAD])
        return [pa.array(attack(e[:-1], e[1:], first + np.arange(len(e) - 1)))]

    flags = _per_chunk(_chunks(blocks), "stream_id string, channel int, granule bigint, attack boolean", step)
    return flags.groupBy("stream_id", "granule").agg(F.max("attack").alias("attack"))


def low_pass(x: np.ndarray, block_type: int, rate: int, hertz: float) -> np.ndarray:
    """Lines (n, 576) with those from ``hertz`` on set to zero, by line in long blocks and by line of a window in short ones."""
    share, p = hertz / (rate / 2), np.arange(LINES)
    place, stop = (p // 18 * 6 + p % 6, round(share * 192)) if block_type == 2 else (p, round(share * 576))
    return np.where(place < stop, x, np.float32(0))


def lines_of(v: np.ndarray, block_type: np.ndarray, model: Model, lowpass: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(n, 1152) subbands and block types to (n, 576) lines in subband order, single precision, and each granule's allowed noise."""
    x = forward_lines(v[:, :LINES].astype(float), v[:, LINES:].astype(float), block_type).astype(np.float32)
    if lowpass < model.rate / 2:
        for t in np.unique(block_type):
            x[block_type == t] = low_pass(x[block_type == t], t, model.rate, lowpass)
    allowed: list = [None] * len(x)
    for short in (False, True):
        at = np.flatnonzero((block_type == 2) == short)
        if len(at):
            for i, a in zip(at, model.allowed(x[at].astype(float), short)):
                allowed[i] = a
    return x, allowed


def lines_and_masks(parts: DataFrame, model: Model, lowpass: float) -> DataFrame:
    """(stream_id, channel, granule, block_type, v) to (stream_id, channel, granule, block_type, x, allowed): a granule alone, any partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, allowed = lines_of(ordered.matrix(b.column(4), 2 * LINES).astype(np.float32), b.column(3).to_numpy(), model, lowpass)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), ordered.lists(x), pa.array(allowed, pa.list_(pa.float64()))], names=["stream_id", "channel", "granule", "block_type", "x", "allowed"])

    rows = parts.select("stream_id", "channel", "granule", F.col("block_type").cast("int").alias("block_type"), "v")
    return rows.mapInArrow(run, "stream_id string, channel int, granule bigint, block_type int, x array<float>, allowed array<double>")


def granules(subbands: DataFrame) -> DataFrame:
    """(stream_id, channel, slot, s) to (stream_id, channel, granule, v): 576 values, subband by subband, of the granules that have all their slots."""
    g = subbands.withColumn("granule", F.floor(F.col("slot") / 18)).groupBy("stream_id", "channel", "granule")
    t = g.agg(F.array_sort(F.collect_list(F.struct("slot", "s"))).alias("all")).where(F.size("all") == 18)
    turn = lambda sb, i: F.when((sb % 2 == 1) & (i % 2 == 1), -1.0).otherwise(1.0)
    value = F.transform(F.sequence(F.lit(0), F.lit(575)), lambda k: F.get(F.get("all", (k % 18).cast("int"))["s"], (k / 18).cast("int")) * turn((k / 18).cast("int"), k % 18))
    return t.select("stream_id", "channel", "granule", value.alias("v"))


def forward_lines(before: np.ndarray, now: np.ndarray, block_type: np.ndarray) -> np.ndarray:
    """(n, 576) of two granules in a row to (n, 576) lines: per subband 36 samples to 18, then the butterflies with signs reversed."""
    matrices, (cs, ca) = _transforms()
    x = np.concatenate([before.reshape(-1, 32, 18), now.reshape(-1, 32, 18)], axis=2)
    out = np.zeros((len(x), 32, 18))
    for t in range(4):
        at = block_type == t
        if at.any():
            rows = np.ascontiguousarray(x[at]).reshape(-1, 36)
            out[at] = np.einsum("nk,ik->ni", rows, np.ascontiguousarray(matrices[t].T)).reshape(-1, 32, 18) / (3 if t == 2 else 9)
    long = block_type != 2
    for sb in range(1, 32):
        up, down = out[long, sb - 1, 17:9:-1].copy(), out[long, sb, :8].copy()
        out[long, sb - 1, 17:9:-1], out[long, sb, :8] = up * cs + down * ca, down * cs - up * ca
    return out.reshape(-1, 576)


def forward_hybrid(rows: DataFrame) -> DataFrame:
    """(stream_id, channel, granule, block_type, v) to (stream_id, channel, granule, block_type, x): lines in subband order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = forward_lines(*(np.array(b.column(k).to_pylist(), dtype=float) for k in ("before", "v")), b.column("block_type").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["stream_id", "channel", "granule", "block_type", "x"])

    o = Window.partitionBy("stream_id", "channel").orderBy("granule")
    silence = F.array_repeat(F.lit(0.0), 576)
    t = rows.select("stream_id", "channel", "granule", F.col("block_type").cast("int").alias("block_type"), "v", F.coalesce(F.lag("v").over(o), silence).alias("before"))
    return t.mapInArrow(run, "stream_id string, channel int, granule bigint, block_type int, x array<float>")


def coded_order(x: np.ndarray, rate: int, block_type: int) -> np.ndarray:
    """Lines in the order of the bit stream."""
    return x[order(rate, 1)] if block_type == 2 else x


def quantise_lines(masks: DataFrame, rate: int, codes: Codes | None = None) -> DataFrame:
    """(stream_id, channel, granule, block_type, x, allowed) to whole numbers in bit-stream order, gains and scalefactors: a granule alone, any partition.

    With code tables each granule gets its best variant of scale and preflag; without, the fine scale and no preflag.
    """
    schema = "stream_id string, channel int, granule bigint, block_type int, ix array<int>, global_gain int, scalefactors array<int>, subblock_gain array<int>, scalefac_scale int, preflag int, clipped int"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = codes and Books(codes)
        for b in batches:
            out = []
            for x, allowed, t in zip(b.column("x").to_pylist(), b.column("allowed").to_pylist(), b.column("block_type").to_pylist()):
                rows = Rows(t if t in (0, 2) else 1, coded_order(np.array(x, float), rate, t)[None], np.array([allowed], float), rate)
                q = rows.attempt(0.0, books)[0] if books else {k: v[0] for k, v in rows.variants(*rows.required(rows.allowed), VARIANTS_LONG[:1]).items()}
                out.append([q["ix"].tolist(), int(q["global_gain"]), q["scalefactors"].tolist(), q["subblock_gain"].tolist(), int(q["scalefac_scale"]), int(q["preflag"]), int(q["clipped"])])
            if out:
                kinds = [pa.list_(pa.int32()) if k in ("ix", "scalefactors", "subblock_gain") else pa.int32() for k in names[4:]]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], names=names)

    return masks.select("stream_id", "channel", "granule", "block_type", "x", "allowed").mapInArrow(run, schema)


def band_allowance(rate: int, block_type: int, x: np.ndarray, share: float) -> np.ndarray:
    """A noise allowance of a share of each band's energy, for tests and simple uses."""
    kind = 1 if block_type == 2 else 0
    band, window = layout(rate, kind)
    y = coded_order(x, rate, block_type)
    return share * np.bincount(band * 3 + np.maximum(window, 0) if kind else band, weights=y**2, minlength=39 if kind else 22)


def dequantised(q: dict | object, rate: int, block_type: int) -> np.ndarray:
    """Lines (bit-stream order) that a decoder gives for a quantised granule."""
    cell, _, _, window = cells(rate, block_type == 2)
    ix, sf = np.array(q["ix"]), np.array(q["scalefactors"])
    pre = np.array(PRETAB) * q["preflag"] if block_type != 2 else 0
    step = q["global_gain"] - 210 - (4 if q["scalefac_scale"] else 2) * (sf + pre) - (8 * np.array(q["subblock_gain"])[window] if block_type == 2 else 0)
    return np.sign(ix) * np.abs(ix) ** (4 / 3) * 2.0 ** (step[cell] / 4)
