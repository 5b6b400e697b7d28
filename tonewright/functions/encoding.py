"""Encoder decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .tables import LOWPASS, SAMPLE_RATES, SLEN1, SLEN2

ENCODER_DELAY, DECODER_DELAY = 528, 529


def cbr_target(demand: Column, slot: Column, tail: Column, most: Column) -> Column:
    """Bits: up to 60 % of the reservoir above the mean on demand, else save while there is room; never more than there are."""
    mean, avail = 8 * slot, 8 * (tail + slot)
    room = 8 * F.greatest(most - tail, F.lit(0))
    target = F.when(demand > mean, F.least(demand, mean + F.floor(8 * tail * 6 / 10))).otherwise(F.greatest(demand, F.greatest(mean - room, F.lit(0))))
    return F.least(target, avail)


def vbr_pick(need: Column, tail: Column, slots: list[int]) -> Column:
    """The first index (from 1) whose slot and half the tail hold ``need`` bits, else the last."""
    fits = [F.when(8 * s + F.floor(8 * tail / 2) >= need, i) for i, s in enumerate(slots, 1)]
    return F.coalesce(*fits, F.lit(len(slots)))


def lowpass(kbps: Column) -> Column:
    """Piecewise linear over the fixed points; 20 500 Hz above the last."""
    rule = F.when(kbps <= LOWPASS[0][0], float(LOWPASS[0][1]))
    for (x0, y0), (x1, y1) in zip(LOWPASS, LOWPASS[1:]):
        rule = rule.when(kbps <= x1, y0 + (kbps - x0) / (x1 - x0) * (y1 - y0))
    return rule.otherwise(20500.0)


def lowpass_of(kbps: float) -> float:
    """The same of one number."""
    (first, low), (last, _) = LOWPASS[0], LOWPASS[-1]
    if kbps > last:
        return 20500.0
    return float(low) if kbps <= first else next(y0 + (kbps - x0) / (x1 - x0) * (y1 - y0) for (x0, y0), (x1, y1) in zip(LOWPASS, LOWPASS[1:]) if kbps <= x1)


def coding_rate(rate: Column) -> Column:
    """The nearest of the nine sampling rates, the first of equals."""
    every = [r // k for k in (1, 2, 4) for r in SAMPLE_RATES]
    ranked = F.array_sort(F.array(*(F.struct(F.abs(rate - r).alias("d"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(every))))
    return ranked[0]["r"]


def vbr_setting(quality: Column) -> tuple[Column, Column]:
    """Noise-to-mask offset (dB) and low-pass of a quality 0-9."""
    return -4.0 + 1.6 * quality, 20000.0 - 700.0 * quality


def scalefac_compress(longest1: Column, longest2: Column) -> Column:
    """{bits, i} of the cheapest length pair for long blocks (11 and 10 bands), null if none is long enough."""
    options = [F.when((longest1 <= a) & (longest2 <= b), F.struct(F.lit(11 * a + 10 * b).alias("bits"), F.lit(i).alias("i"))) for i, (a, b) in enumerate(zip(SLEN1, SLEN2))]
    return F.array_min(F.array_compact(F.array(*options)))


def extent(n: Column, spf: Column) -> tuple[Column, Column]:
    """Frames that hold n samples behind the delays, and the padding at the end."""
    frames = F.ceil((n + ENCODER_DELAY + DECODER_DELAY) / spf)
    return frames, frames * spf - ENCODER_DELAY - n


def reservoir_most(lsf: Column, frame_bytes: Column) -> Column:
    """min(511 or 255, 960 - frame bytes), not under zero."""
    return F.greatest(F.least(F.when(lsf, 255).otherwise(511), 960 - frame_bytes), F.lit(0))


def reservoir_limit(lsf: bool, frame_bytes: int) -> int:
    """The same of one frame."""
    return max(0, min(255 if lsf else 511, 960 - frame_bytes))
