"""Rate control, reservoir and configuration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import encoding as E
from ..operators import streams
from ..functions import scalefactors as S
from ..functions.tables import BITRATES_MPEG1, LONG_44, LOWPASS, SHORT_44, SLEN1, SLEN2
from .registry import SQL, query, sql_list, table
from . import spectra  # noqa: F401  (the SQL of one query here holds one of its)


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey * 3 % 9000 AS demand, 100 + l_suppkey % 900 AS slot, l_linenumber * 37 % 512 AS tail, 511 AS most FROM lineitem),
    t AS (SELECT *, 8 * slot AS mean, 8 * (tail + slot) AS avail, 8 * greatest(most - tail, 0) AS room FROM p)
    SELECT l_orderkey, l_linenumber, CAST(least(CASE WHEN demand > mean THEN least(demand, mean + 8 * tail * 6 // 10) ELSE greatest(demand, greatest(mean - room, 0)) END, avail) AS BIGINT) AS target FROM t"""
)
def cbr_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits for a frame from its demand, the mean, and what the reservoir holds or has room for."""
    t = table(spark, sf_dir, "lineitem")
    target = E.cbr_target(F.col("l_partkey") * 3 % 9000, 100 + F.col("l_suppkey") % 900, F.col("l_linenumber") * 37 % 512, F.lit(511))
    return t.select("l_orderkey", "l_linenumber", target.cast("bigint").alias("target"))


_L3 = BITRATES_MPEG1[2][1:]


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey * 5 % 12000 AS need, l_linenumber * 61 % 512 AS tail FROM lineitem),
    r AS (SELECT unnest(range(1, 15)) AS i, unnest({sql_list(_L3)}) * 144000 // 44100 - 36 AS slot)
    SELECT l_orderkey, l_linenumber, CAST(coalesce((SELECT min(i) FROM r WHERE 8 * slot + 8 * tail // 2 >= need), 14) AS INTEGER) AS pick FROM p"""
)
def vbr_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bit rate whose frame and half the reservoir hold the bits, else the greatest."""
    t = table(spark, sf_dir, "lineitem")
    slots = [k * 144000 // 44100 - 36 for k in _L3]
    return t.select("l_orderkey", "l_linenumber", E.vbr_pick(F.col("l_partkey") * 5 % 12000, F.col("l_linenumber") * 61 % 512, slots).alias("pick"))


_POINTS = f"points AS (SELECT unnest({sql_list(a for a, _ in LOWPASS)}) AS x0, unnest({sql_list([a for a, _ in LOWPASS[1:]] + [1e9])}) AS x1, unnest({sql_list(b for _, b in LOWPASS)}) AS y0, unnest({sql_list([b for _, b in LOWPASS[1:]] + [20500])}) AS y1)"


@query(
    f"""WITH {_POINTS}, p AS (SELECT DISTINCT l_partkey, l_partkey % 160 + 0.25 AS k FROM lineitem)
    SELECT l_partkey, round(CASE WHEN k <= 8 THEN 3000 WHEN k > 128 THEN 20500 ELSE max(CASE WHEN k > x0 AND k <= x1 THEN y0 + (k - x0) / (x1 - x0) * (y1 - y0) END) END, 6) AS lowpass, CAST(arg_min(r, abs(r - l_partkey * 31)) AS INTEGER) AS coding_rate
    FROM p, points, (SELECT unnest([44100, 48000, 32000, 22050, 24000, 16000, 11025, 12000, 8000]) AS r) GROUP BY l_partkey, k"""
)
def encoder_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-pass by bit rate per channel, and the coding rate nearest to an input rate."""
    t = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return t.select("l_partkey", F.round(E.lowpass(F.col("l_partkey") % 160 + 0.25), 6).alias("lowpass"), E.coding_rate(F.col("l_partkey") * 31).alias("coding_rate"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 50 + l_suppkey % 300 AS main, l_partkey % 600 AS begin FROM lineitem),
    s AS (SELECT *, CAST(coalesce(sum(main) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total FROM p)
    SELECT l_orderkey, l_linenumber, least(total, 511) AS available, total - begin AS main_start, begin <= least(total, 511) AS decodable FROM s"""
)
def reservoir_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where main data starts in the stream's main data, as running sums instead of state."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), (50 + F.col("l_suppkey") % 300).alias("main"), (F.col("l_partkey") % 600).alias("begin"))
    return streams.reservoir(t, ["l_orderkey"], "place", "main", "begin").select("l_orderkey", "l_linenumber", "available", "main_start", "decodable")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 50 + l_suppkey % 300 AS main, l_partkey % 200 AS begin, l_partkey * 7 % 2400 AS bits FROM lineitem),
    u AS (SELECT *, greatest(8 * (begin + main) - bits, 0) // 8 AS unused FROM p),
    l AS (SELECT *, lag(unused) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM u)
    SELECT l_orderkey, l_linenumber, CAST(unused AS BIGINT) AS unused, bits <= 8 * (begin + main) AND CASE WHEN before IS NULL THEN begin = 0 ELSE begin <= before END AS consistent FROM l"""
)
def strict_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a frame's main data starts within what the one before left unused, and holds its bits."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), (50 + F.col("l_suppkey") % 300).alias("main"), (F.col("l_partkey") % 200).alias("begin"), (F.col("l_partkey") * 7 % 2400).alias("bits"))
    return streams.accounting(t, ["l_orderkey"], "place", "main", "begin", "bits").select("l_orderkey", "l_linenumber", "unused", "consistent")


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS a, l_suppkey % 4 AS b FROM lineitem), c AS (SELECT unnest(range(16)) AS i, unnest({sql_list(SLEN1)}) AS s1, unnest({sql_list(SLEN2)}) AS s2)
    SELECT l_orderkey, l_linenumber, CAST(best % 16 AS INTEGER) AS scalefac_compress, CAST(best // 16 AS INTEGER) AS bits FROM (SELECT *, (SELECT min((11 * s1 + 10 * s2) * 16 + i) FROM c WHERE s1 >= a AND s2 >= b) AS best FROM p) WHERE best IS NOT NULL"""
)
def scalefactor_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest of sixteen length pairs that hold both groups of scalefactors; the first of equals; none, no row."""
    t = table(spark, sf_dir, "lineitem")
    best = E.scalefac_compress(F.col("l_partkey") % 5, F.col("l_suppkey") % 4)
    return t.select("l_orderkey", "l_linenumber", best.alias("best")).where("best IS NOT NULL").select("l_orderkey", "l_linenumber", F.col("best.i").alias("scalefac_compress"), F.col("best.bits").alias("bits"))


@query(
    """WITH p AS (SELECT o_orderkey, [44100, 48000, 32000, 22050, 24000, 16000][o_orderkey % 6 + 1] AS rate, o_custkey * 1009 AS n FROM orders), q AS (SELECT *, CASE WHEN rate >= 32000 THEN 1152 ELSE 576 END AS spf FROM p)
    SELECT o_orderkey, CAST((n + 1057 + spf - 1) // spf AS BIGINT) AS frames, CAST((n + 1057 + spf - 1) // spf * spf - 528 - n AS BIGINT) AS padding FROM q"""
)
def encoded_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and end padding of an encoded signal of n samples."""
    t = table(spark, sf_dir, "orders")
    rate = F.get(F.array(*map(F.lit, (44100, 48000, 32000, 22050, 24000, 16000))), (F.col("o_orderkey") % 6).cast("int"))
    frames, padding = E.extent(F.col("o_custkey") * 1009, F.when(rate >= 32000, 1152).otherwise(576))
    return t.select("o_orderkey", frames.alias("frames"), padding.alias("padding"))


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 16 AS c, l_suppkey % 3 AS kind, l_partkey % 16 AS r0, l_suppkey % 8 AS r1, l_linenumber % 2 AS sw FROM lineitem),
    e AS (SELECT *, {sql_list(SLEN1)}[c + 1] AS a, {sql_list(SLEN2)}[c + 1] AS b, {sql_list(LONG_44)} AS edges FROM p)
    SELECT l_orderkey, l_linenumber, CAST(a * CASE kind WHEN 0 THEN 11 WHEN 1 THEN 18 ELSE 17 END + b * CASE kind WHEN 0 THEN 10 ELSE 18 END AS INTEGER) AS bits,
      CAST(CASE WHEN sw = 1 THEN CASE WHEN kind = 1 THEN 36 ELSE 36 END ELSE edges[least(r0 + 1, 22) + 1] END AS INTEGER) AS region1, CAST(CASE WHEN sw = 1 THEN 576 ELSE edges[least(r0 + r1 + 2, 22) + 1] END AS INTEGER) AS region2 FROM e"""
)
def scalefactor_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the scalefactors and the bounds of the Huffman regions, at 44.1 kHz."""
    t = table(spark, sf_dir, "lineitem")
    kind = F.col("l_suppkey") % 3
    one, two = S.region_bounds(F.col("l_linenumber") % 2, F.when(kind == 0, 0).otherwise(2), F.when(kind == 2, 1).otherwise(0), F.col("l_partkey") % 16, F.col("l_suppkey") % 8, LONG_44, SHORT_44)
    bits = S.mpeg1_bits((F.col("l_partkey") % 16).cast("int"), kind)
    return t.select("l_orderkey", "l_linenumber", bits.cast("int").alias("bits"), one.cast("int").alias("region1"), two.cast("int").alias("region2"))


_GROUPS = sql_list(n for r in S.GROUPS_LSF for k in r for n in k)


@query(
    f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 400 AS s, l_partkey % 3 AS kind FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST((s >> 4) // 5 * {_GROUPS}[kind * 4 + 1] + (s >> 4) % 5 * {_GROUPS}[kind * 4 + 2] + (s % 16 >> 2) * {_GROUPS}[kind * 4 + 3] + s % 4 * {_GROUPS}[kind * 4 + 4] AS INTEGER) AS bits FROM p"""
)
def lsf_scalefactor_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.layers import lsf_lengths

    t = table(spark, sf_dir, "lineitem")
    lengths, row, _ = lsf_lengths((F.col("l_suppkey") % 400).cast("int"), F.lit(False))
    return t.select("l_orderkey", "l_linenumber", S.lsf_bits(lengths, row, F.col("l_partkey") % 3).cast("int").alias("bits"))


_GROUPS = sql_list(n for r in S.GROUPS_LSF for k in r for n in k)


@query(
    f"""SELECT l_orderkey, l_linenumber, CAST(len0 * {_GROUPS}[spot + 1] + len1 * {_GROUPS}[spot + 2] + len2 * {_GROUPS}[spot + 3] + len3 * {_GROUPS}[spot + 4] AS INTEGER) AS bits
    FROM (SELECT *, groups_row * 12 + l_orderkey % 3 * 4 AS spot FROM ({SQL["lsf_scalefactor_lengths"]}))"""
)
def lsf_scalefactor_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of a granule's scalefactors at the lower rates: both channels' rules, all rows of lengths, long, short and mixed blocks."""
    from ..functions.layers import lsf_lengths

    t = table(spark, sf_dir, "lineitem")
    lengths, row, _ = lsf_lengths((F.col("l_partkey") % 512).cast("int"), F.col("l_suppkey") % 2 == 1)
    return t.select("l_orderkey", "l_linenumber", S.lsf_bits(lengths, row, F.col("l_orderkey") % 3).cast("int").alias("bits"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 14 + 1 AS i FROM lineitem),
    r AS (SELECT l_orderkey, sum(len) AS bytes, count(*) AS frames FROM (SELECT l_orderkey, 417 + l_partkey % 2 AS len FROM b) GROUP BY 1)
    SELECT l_orderkey, CAST(frames AS BIGINT) AS frames, CAST(bytes AS BIGINT) AS bytes, CAST(bytes * 8 * 44100 // (frames * 1152) AS BIGINT) AS average_rate FROM r"""
)
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, bytes and average bit rate of each stream."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", (417 + F.col("l_partkey") % 2).alias("len"))
    s = t.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("frames"), F.sum("len").alias("bytes"))
    return s.withColumn("average_rate", F.floor(F.col("bytes") * 8 * 44100 / (F.col("frames") * 1152)))
