"""The masking model over (keys, k, x) spectra: bands, thresholds, entropy, transients, block types.

The band dimensions have at most 22 and 22 x 22 rows, whatever the data, so
Spark broadcasts them by their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import psychoacoustics as S
from ..functions.layers import mid_side
from ..functions.tables import band_edges
from . import ordered


def banded(lines: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """The scalefactor band of each line, by counting the edges at or below it; no join."""
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("k"))) - 1
    return lines.where(F.col("k") < edges[-1]).withColumn("band", at)


def band_statistics(lines: DataFrame, keys: list[str], edges: tuple[int, ...], line_hz: float) -> DataFrame:
    """Per band: width, z, energy and tonality (spectral flatness, 0 for silence)."""
    square = F.col("x") * F.col("x")
    t = banded(lines, edges).groupBy(*keys, "band").agg(F.sum(square).alias("energy"), F.exp(F.avg(F.log(square + 1e-30))).alias("geo"))
    dim = S.band_dimension(lines.sparkSession, edges, line_hz).select("band", (F.col("hi") - F.col("lo")).alias("width"), "z")
    t = t.join(dim, "band")
    tonal = F.when(F.col("energy") <= 1e-30, 0.0).otherwise(S.tonality(F.col("geo"), F.col("energy") / F.col("width")))
    return t.withColumn("tonality", tonal).drop("geo")


def thresholds(bands: DataFrame, keys: list[str], edges: tuple[int, ...], line_hz: float, quiet: Column) -> DataFrame:
    """The allowed noise of each band: spread energy under its masking offset, not below ``quiet``.

    The bands of one spectrum are gathered as one array (at most 22 structs), so the spread
    sum needs no second shuffle.
    """
    dim = S.spreading_dimension(bands.sparkSession, edges, line_hz)
    weights = dim.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct("masker", "weight"))).alias("weights")).withColumnRenamed("band", "b")
    t = bands.groupBy(*keys).agg(F.collect_list(F.struct("band", "width", "z", "energy", "tonality")).alias("all"))
    t = t.select(*keys, "all", F.explode("all").alias("one")).select(*keys, "all", "one.*").join(weights, F.col("band") == F.col("b"))
    spread = F.aggregate(F.array_sort("all"), F.lit(0.0), lambda s, e: s + e["energy"] * F.coalesce(F.element_at("weights", e["band"]), F.lit(0.0)))
    offset = S.masking_offset(F.col("tonality"), F.col("z"))
    t = t.withColumn("threshold", F.greatest(spread * F.pow(F.lit(10.0), -offset / 10.0), quiet))
    return t.select(*keys, "band", "width", "energy", "tonality", "threshold")


def entropy_term(width: Column, energy: Column, threshold: Column) -> Column:
    return F.when(energy > threshold, width * F.log2(1.0 + F.sqrt(energy / threshold))).otherwise(0.0)


def entropy(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Bits that a spectrum asks for."""
    return masks.groupBy(*keys).agg(F.sum(entropy_term(F.col("width"), F.col("energy"), F.col("threshold"))).alias("entropy"))


def mid_side_choice(lines: DataFrame, keys: list[str], channel: str, edges: tuple[int, ...], line_hz: float, quiet: Column) -> DataFrame:
    """(keys, k, channel 0 or 1, x): entropies of both forms, and whether mid/side is the cheaper."""
    masks = thresholds(band_statistics(lines, [*keys, channel], edges, line_hz), [*keys, channel], edges, line_hz, quiet)
    both = masks.groupBy(*keys, "band").agg(F.min("threshold").alias("threshold"), F.sum(entropy_term(F.col("width"), F.col("energy"), F.col("threshold"))).alias("pe_lr"))
    sides = banded(lines, edges).groupBy(*keys, "band", "k").agg(F.max(F.when(F.col(channel) == 0, F.col("x"))).alias("l"), F.max(F.when(F.col(channel) == 1, F.col("x"))).alias("r"))
    m, s = mid_side(F.col("l"), F.col("r"))
    energy = sides.groupBy(*keys, "band").agg(F.sum(m * m).alias("em"), F.sum(s * s).alias("es"), F.count(F.lit(1)).alias("width"))
    t = both.join(energy, [*keys, "band"])
    pe = entropy_term(F.col("width"), F.col("em"), F.col("threshold")) + entropy_term(F.col("width"), F.col("es"), F.col("threshold"))
    t = t.where("em IS NOT NULL").groupBy(*keys).agg(F.sum(pe).alias("pe_ms"), F.sum("pe_lr").alias("pe_lr"))
    return t.withColumn("mid_side", F.col("pe_ms") < F.col("pe_lr"))


def transients(samples: DataFrame, factor: tuple[int, int], floor: int, history: int = 9) -> DataFrame:
    """(stream, seg, event_id, v whole): energy of differences per segment, the sum of those before, and attacks.

    attack: energy above the floor and above factor times the mean of the past.
    """
    inside = Window.partitionBy("stream", "seg").orderBy("event_id")
    h = F.col("v") - F.coalesce(F.lag("v").over(inside), F.lit(0))
    t = samples.withColumn("h", h).groupBy("stream", "seg").agg(F.sum(F.col("h") * F.col("h")).alias("energy"))
    past = Window.partitionBy("stream").orderBy("seg").rowsBetween(-history, -1)
    t = t.withColumn("_sum", F.sum("energy").over(past)).withColumn("_n", F.greatest(F.count(F.lit(1)).over(past), F.lit(1)))
    t = t.withColumn("past_sum", F.coalesce("_sum", "energy"))
    over = factor[1] * F.col("energy") * F.col("_n") > factor[0] * F.greatest(F.col("past_sum"), F.lit(floor // 10) * F.col("_n"))
    return t.withColumn("attack", (F.col("energy") > floor) & over).drop("_sum", "_n")


SEGMENT, LEAK, BEFORE = 64, 0.6, 225
FULL_SCALE_DB = 96.0


def segment_energies(x: np.ndarray) -> np.ndarray:
    """(n, 705) samples to (n, 9): energies of leaky differences in segments of 64. Two segments before them fill the leak, of which 1e-28 is older."""
    d = np.diff(x, axis=1).reshape(len(x), -1, SEGMENT)
    k = np.arange(SEGMENT)
    leak = np.where(k <= k[:, None], LEAK ** np.maximum(k[:, None] - k, 0), 0.0)
    high = np.einsum("nk,jk->nj", np.ascontiguousarray(d).reshape(-1, SEGMENT), leak).reshape(d.shape)
    state, out = np.zeros(len(x)), []
    for s in range(d.shape[1]):
        row = high[:, s] + LEAK ** (k + 1) * state[:, None]
        state = row[:, -1]
        out.append(np.einsum("nk,nk->n", row, row))
    return np.stack(out[2:], axis=1)


def attack(before: np.ndarray, now: np.ndarray, granule: np.ndarray) -> np.ndarray:
    """Whether granules have an attack, of their segments' energies and those of the granule before: one that passes the floor and ten times the mean of the nine before it.

    The region of a granule starts ``BEFORE`` samples ahead of it. Segments before the stream do not count.
    """
    both, floor = np.concatenate([before, now], axis=1), 1e-6 * SEGMENT
    hit = np.zeros(len(now), bool)
    for j in range(9):
        held = np.minimum(9 * granule + j, 9)
        past = np.where(held > 0, both[:, j : j + 9].sum(axis=1) / np.maximum(held, 1), now[:, j])
        hit |= (now[:, j] > floor) & (now[:, j] > 10 * np.maximum(past, floor / 10))
    return hit


def quiet_energies(edges: tuple[int, ...], hertz: float, full: float) -> list[float]:
    """The threshold in quiet of each band as noise energy, a full-scale tone (energy ``full``) standing at 96 dB."""
    values = []
    for lo, hi in zip(edges, edges[1:]):
        k = np.maximum((np.arange(lo, hi) + 0.5) * hertz, 20.0) / 1000
        db = np.minimum(3.64 * k**-0.8 - 6.5 * np.exp(-0.6 * (k - 3.3) ** 2) + 1e-3 * k**4, 110.0)
        values.append(float(full * 10 ** ((db.min() - FULL_SCALE_DB) / 10)))
    return values


class Model:
    """The masking model of a rate over arrays of spectra; the same rule as ``thresholds``. full: energies of a full-scale sine in long blocks and in a window of short ones."""

    def __init__(self, rate: int, full: tuple[float, float], offset_db: float = 0.0):
        self.rate, self.scale, self.parts = rate, 10 ** (offset_db / 10), []
        for edges, hertz, most in zip(band_edges(rate), (rate / 1152, rate / 384), full):
            z, weights = S.spreading_matrix(edges, hertz)
            self.parts.append((np.array(edges), np.array(z), np.array(weights), np.array(quiet_energies(edges, hertz, most))))

    @property
    def floor(self) -> list[float]:
        """The least noise of long blocks."""
        return (self.parts[0][3] * self.scale).tolist()

    def _thresholds(self, x: np.ndarray, short: bool) -> np.ndarray:
        edges, z, weights, quiet = self.parts[short]
        square, width = x * x, np.diff(edges)
        energy = np.add.reduceat(square, edges[:-1], axis=1)
        flat = np.exp(np.add.reduceat(np.log(square + 1e-30), edges[:-1], axis=1) / width) / np.maximum(energy / width, 1e-300)
        tonal = np.where(energy <= 1e-30, 0.0, np.clip(10 * np.log10(flat) / -25, 0, 1))
        offset = tonal * (14.5 + z) + (1 - tonal) * 5.5
        return np.maximum(np.einsum("nj,bj->nb", energy, weights) * 10 ** (-offset / 10), quiet) * self.scale

    def allowed(self, x: np.ndarray, short: bool) -> np.ndarray:
        """(n, 576) lines in subband order to the allowed noise per band, in short blocks per band and window."""
        if not short:
            return self._thresholds(x, False)
        windows = x.reshape(-1, 32, 3, 6).swapaxes(1, 2).reshape(-1, 192)
        return self._thresholds(windows, True).reshape(len(x), 3, -1).swapaxes(1, 2).reshape(len(x), -1)


def next_kind(last: int, now: bool, following: bool) -> int:
    """The window kind of a granule: normal 0, start 1, short 2, stop 3."""
    if last == 1 or (last == 2 and (now or following)):
        return 2
    return 3 if last == 2 else int(now or following)


def block_types(attacks: DataFrame, keys: list[str], by: str, attack: str) -> DataFrame:
    """(keys, n, kind): the window kinds of a stream's granules in order over its attack flags, from 1.

    A stream's flags go through one task; it keeps the row before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, n = None, 0, 0
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                key = row[:-2]
                if held is not None:
                    same = held[:-2] == key
                    last, n = next_kind(last, held[-1], same and row[-1]), n + 1
                    out.append((*held[:-2], n, last))
                    if not same:
                        last, n = 0, 0
                held = row
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=[*keys, "n", "kind"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*held[:-2], n + 1, next_kind(last, held[-1], False)), kinds)], names=[*keys, "n", "kind"])

    rows = attacks.select(*keys, by, F.col(attack).alias("_attack")).repartition(*keys).sortWithinPartitions(*keys, by)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("n", T.IntegerType()), T.StructField("kind", T.IntegerType())])
    kinds = [f.type for f in to_arrow_schema(schema)]
    return rows.mapInArrow(run, schema)


def block_type_scan(attacks: DataFrame, keys: list[str], by: str, attack: str, size: int = 4096) -> DataFrame:
    """(keys, by, kind): the same of granules numbered from 0 without gaps, as a parallel prefix.

    A chunk of granules is a map of the four kinds to kinds, and such maps compose; so one stream spreads over many tasks.
    """
    flags = attacks.select(*keys, by, F.col(attack).alias("_now"))
    ahead = flags.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col(by) - 1).alias("_at"), F.col("_now").alias("_next"))
    both = flags.join(ahead, [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col(by) == F.col("_at")], "left")
    rows = both.select(*keys, by, "_now", F.coalesce("_next", F.lit(False)).alias("_next"))

    def kinds(last: int, now: list[bool], following: list[bool]) -> list[int]:
        out = []
        for n, f in zip(now, following):
            last = next_kind(last, n, f)
            out.append(last)
        return out

    done = ordered.scan(rows, keys, by, ["_now", "_next"], size, 0, lambda now, ahead: [kinds(k, now, ahead)[-1] for k in range(4)], lambda state, f: f[state], kinds, T.StructField("kind", T.IntegerType()))
    return done.select(*keys, by, "kind")
