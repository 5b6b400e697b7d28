"""Which bits of main data are which scalefactors: counts and lengths as column expressions, the bits by one small reader."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .tables import SLEN1, SLEN2

# Fixed values (13818-3 2.4.3.2): scalefactors per length, for six rows of lengths, in long, short and mixed blocks.
GROUPS_LSF = (
    ((6, 5, 5, 5), (9, 9, 9, 9), (6, 9, 9, 9)),
    ((6, 5, 7, 3), (9, 9, 12, 6), (6, 9, 12, 6)),
    ((11, 10, 0, 0), (18, 18, 0, 0), (15, 18, 0, 0)),
    ((7, 7, 7, 0), (12, 12, 12, 0), (6, 15, 12, 0)),
    ((6, 6, 6, 3), (12, 9, 9, 6), (6, 12, 9, 6)),
    ((8, 8, 5, 0), (15, 12, 9, 0), (6, 18, 9, 0)),
)
SCFSI_GROUPS = ((0, 6), (6, 11), (11, 16), (16, 21))


def block_kind(block_type: Column, mixed: Column) -> Column:
    """0 long, 1 short, 2 mixed."""
    return F.when(block_type != 2, 0).when(mixed == 1, 2).otherwise(1)


def mpeg1_lengths(compress: Column) -> tuple[Column, Column]:
    return tuple(F.get(F.array(*map(F.lit, t)), compress) for t in (SLEN1, SLEN2))


def mpeg1_bits(compress: Column, kind: Column) -> Column:
    """Bits of a granule's scalefactors without scfsi: 11 and 10 long bands, 18 and 18 short ones, or 17 and 18 mixed."""
    a, b = mpeg1_lengths(compress)
    first, second = F.when(kind == 0, 11).when(kind == 1, 18).otherwise(17), F.when(kind == 0, 10).otherwise(18)
    return a * first + b * second


def lsf_bits(lengths: list[Column], row: Column, kind: Column) -> Column:
    """Bits of a granule's scalefactors at the lower rates."""
    flat = F.array(*(F.lit(n) for r in GROUPS_LSF for k in r for n in k))
    at = row * 12 + kind * 4
    return sum((lengths[k] * F.get(flat, (at + k).cast("int")) for k in range(4)), F.lit(0))


def shared_bands(granule: Column, scfsi: Column) -> Column:
    """The bands whose scalefactors granule 1 takes from granule 0, by the four scfsi flags."""
    groups = F.array(*(F.sequence(F.lit(a), F.lit(b - 1)) for a, b in SCFSI_GROUPS))
    picked = F.flatten(F.transform(F.filter(F.arrays_zip(groups.alias("g"), scfsi.alias("f")), lambda x: x["f"] == 1), lambda x: x["g"]))
    return F.when(granule == 1, picked).otherwise(F.array().cast("array<int>"))


def region_bounds(switched: Column, block_type: Column, mixed: Column, region0: Column, region1: Column, long_edges: tuple[int, ...], short_edges: tuple[int, ...]) -> tuple[Column, Column]:
    """Where the second and third Huffman regions start, in lines."""
    edges = F.array(*map(F.lit, long_edges))
    last = len(long_edges) - 1
    one = F.get(edges, F.least(region0 + 1, F.lit(last)).cast("int"))
    two = F.get(edges, F.least(region0 + region1 + 2, F.lit(last)).cast("int"))
    pure = (block_type == 2) & (mixed == 0)
    return F.when(switched == 1, F.when(pure, 3 * short_edges[3]).otherwise(long_edges[8])).otherwise(one), F.when(switched == 1, long_edges[-1]).otherwise(two)
