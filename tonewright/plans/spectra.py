"""Transform, stereo and requantisation queries over vectors of ``embeddings`` and numbers of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import layers as L, transforms as T
from ..functions.tables import PRETAB, SHORT_44
from .registry import query, sql_list, table


def blocks(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """(vec_id, block, x): each vector whole, in lists of n components, the last one filled with zeros."""
    t = table(spark, sf_dir, "embeddings").withColumn("fill", F.pmod(-F.size("embedding"), F.lit(n)))
    t = t.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), F.col("fill"))).alias("all")).where(F.size("all") > 0)
    return t.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("all") / n).cast("int") - 1), lambda k: F.slice("all", k * n + 1, n))).alias("block", "x")).withColumn("block", F.col("block").cast("bigint"))


def _blocks_sql(n: int) -> str:
    return f"""SELECT vec_id, k // {n} AS block, k % {n} AS k, coalesce(CAST(embedding[k + 1] AS DOUBLE), 0) AS x
      FROM embeddings, LATERAL (SELECT unnest(range((len(embedding) + {n - 1}) // {n} * {n})) AS k)"""


def _imdct_sql(n: int) -> str:
    return f"""SELECT vec_id, block, i, sum(x * cos(pi() / {2 * n} * (2 * i + 1 + {n // 2}) * (2 * k + 1))) * sin(pi() / {n} * (i + 0.5)) AS y
      FROM ({_blocks_sql(n // 2)}), (SELECT unnest(range({n})) AS i) GROUP BY vec_id, block, i"""


def _rounded_imdct_sql(n: int) -> str:
    return f"SELECT vec_id, CAST(block AS BIGINT) AS block, CAST(i AS INTEGER) AS i, round(y, 6) + 0.0 AS y FROM ({_imdct_sql(n)})"


def _inverse(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    y = T.inverse_mdct(blocks(spark, sf_dir, n // 2), ["vec_id", "block"], "x", n)
    return y.select("vec_id", "block", F.posexplode("x").alias("i", "y")).withColumn("y", F.round("y", 6) + 0.0)


@query(_rounded_imdct_sql(36))
def imdct_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir, 36)


@query(_rounded_imdct_sql(12))
def imdct_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inverse(spark, sf_dir, 12)


def _mdct_sql(n: int, scale: int) -> str:
    return f"""SELECT vec_id, CAST(block AS BIGINT) AS block, CAST(m AS INTEGER) AS k, round(sum(x * sin(pi() / {n} * (k + 0.5)) * cos(pi() / {2 * n} * (2 * k + 1 + {n // 2}) * (2 * m + 1))) / {scale}, 6) + 0.0 AS x
    FROM ({_blocks_sql(n)}), (SELECT unnest(range({n // 2})) AS m) GROUP BY vec_id, block, m"""


def _forward(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    x = T.forward_mdct(blocks(spark, sf_dir, n), ["vec_id", "block"], "x", n)
    return x.select("vec_id", "block", F.posexplode("x").alias("k", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query(_mdct_sql(36, 9))
def mdct_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir, 36)


@query(_mdct_sql(12, 3))
def mdct_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir, 12)


@query(
    f"""WITH y AS ({_imdct_sql(36)}), h AS (SELECT vec_id % 32 AS subband, vec_id // 32 AS granule, block, i, y FROM y),
    o AS (SELECT a.granule, a.subband, a.block, a.i, a.y + coalesce(b.y, 0) AS v FROM h a LEFT JOIN h b ON a.subband = b.subband AND a.block = b.block AND a.granule = b.granule + 1 AND b.i = a.i + 18 WHERE a.i < 18)
    SELECT CAST(granule AS BIGINT) AS granule, CAST(subband AS BIGINT) AS subband, CAST(block AS BIGINT) AS block, CAST(i AS INTEGER) AS i, round(CASE WHEN subband % 2 = 1 AND i % 2 = 1 THEN -v ELSE v END, 6) + 0.0 AS v FROM o"""
)
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of neighbouring granules added, then the frequency inversion; a window per (subband, block) over rows of eighteen samples. Each block of 18 components is a stream of its own."""
    y = T.inverse_mdct(blocks(spark, sf_dir, 18), ["vec_id", "block"], "x", 36)
    y = y.select((F.col("vec_id") % 32).alias("subband"), F.floor(F.col("vec_id") / 32).alias("granule"), "block", F.slice("x", 1, 18).alias("now"), F.slice("x", 19, 18).alias("tail"))
    v = L.overlapped(y, ["subband", "block"], "granule").select("granule", "subband", "block", F.posexplode("v").alias("i", "v"))
    sign = F.when((F.col("subband") % 2 == 1) & (F.col("i") % 2 == 1), -F.col("v")).otherwise(F.col("v"))
    return v.select("granule", "subband", "block", "i", (F.round(sign, 6) + 0.0).alias("v"))


_ORDER = T.short_order(SHORT_44)


@query(f"""WITH p AS (SELECT CAST(unnest(range(576)) AS INTEGER) AS coded, CAST(unnest({sql_list(_ORDER)}) AS INTEGER) AS place) SELECT vec_id, coded, place, CAST(embedding[coded % 64 + 1] AS DOUBLE) AS x FROM embeddings, p""")
def short_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the 576 coded lines of each vector's short blocks go (bands, windows, lines to lines, windows), over a permutation held as one literal array."""
    t = table(spark, sf_dir, "embeddings").withColumn("coded", F.explode(F.sequence(F.lit(0), F.lit(575))))
    return t.select("vec_id", "coded", L.permuted(_ORDER, F.col("coded")).alias("place"), F.get("embedding", F.col("coded") % 64).cast("double").alias("x"))


@query(
    """SELECT l_orderkey, l_linenumber, round(sign(v) * pow(abs(v), 4.0 / 3) * pow(2, (gg - 210) / 4.0 - 2.0 * sub - CASE WHEN l_linenumber % 2 = 1 THEN 1.0 ELSE 0.5 END * (sf + pre)), 9) + 0.0 AS x FROM (
      SELECT l_orderkey, l_linenumber, l_partkey % 31 - 15 AS v, 190 + l_suppkey % 40 AS gg, l_orderkey % 8 AS sub, l_partkey % 16 AS sf, """
    + sql_list(PRETAB)
    + "[l_partkey % 22 + 1] AS pre FROM lineitem)"
)
def requantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    v, pre = F.col("l_partkey") % 31 - 15, F.get(F.array(*map(F.lit, PRETAB)), (F.col("l_partkey") % 22).cast("int"))
    gain = T.step_gain(190 + F.col("l_suppkey") % 40, F.col("l_partkey") % 16, F.col("l_linenumber") % 2 == 1, pre, F.col("l_orderkey") % 8)
    return t.select("l_orderkey", "l_linenumber", (F.round(T.power_43(v) * gain, 9) + 0.0).alias("x"))


@query(
    """SELECT l_orderkey, l_linenumber, CAST(floor(pow(x, 0.75) * pow(2, -3.0 * s / 16) + 0.4054) AS BIGINT) AS ix,
      round(pow(x - pow(floor(pow(x, 0.75) * pow(2, -3.0 * s / 16) + 0.4054), 4.0 / 3) * pow(2, s / 4.0), 2), 6) AS noise FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS x, l_suppkey % 20 AS s FROM lineitem)"""
)
def quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised magnitude at a step, and the squared error it makes."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("double").alias("x"), (F.col("l_suppkey") % 20).alias("s"))
    t = t.withColumn("ix", T.quantised(F.col("x"), F.col("s")))
    back = T.power_43(F.col("ix")) * F.pow(F.lit(2.0), F.col("s") / 4.0)
    return t.select("l_orderkey", "l_linenumber", "ix", F.round(F.pow(F.col("x") - back, F.lit(2.0)), 6).alias("noise"))


@query(
    f"""WITH p AS (SELECT vec_id // 2 AS pair, k, max(CASE WHEN vec_id % 2 = 0 THEN x END) AS m, max(CASE WHEN vec_id % 2 = 1 THEN x END) AS s FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)
    SELECT CAST(pair AS BIGINT) AS pair, CAST(k AS INTEGER) AS k, round((m + s) / sqrt(2), 7) + 0.0 AS l, round((m - s) / sqrt(2), 7) + 0.0 AS r FROM p WHERE s IS NOT NULL AND m IS NOT NULL"""
)
def mid_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels of a granule side by side by one aggregation, then (m + s) and (m - s) over the root of two."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "x")).withColumn("pair", F.floor(F.col("vec_id") / 2))
    both = t.groupBy("pair", "k").agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("x"))).alias("m"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("x"))).alias("s"))
    left, right = L.mid_side(F.col("m"), F.col("s"))
    return both.where("m IS NOT NULL AND s IS NOT NULL").select("pair", "k", (F.round(left, 7) + 0.0).alias("l"), (F.round(right, 7) + 0.0).alias("r"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 8 AS pos, l_suppkey % 7 AS lp, CASE WHEN l_linenumber % 2 = 1 THEN sqrt(0.5) ELSE sqrt(sqrt(0.5)) END AS io FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN pos >= 7 THEN NULL WHEN pos = 6 THEN 1 ELSE tan(pos * pi() / 12) / (1 + tan(pos * pi() / 12)) END, 9) AS left1, round(CASE WHEN pos >= 7 THEN NULL WHEN pos = 6 THEN 0 ELSE 1 / (1 + tan(pos * pi() / 12)) END, 9) AS right1,
      round(CASE WHEN lp = 6 THEN NULL WHEN lp % 2 = 1 THEN pow(io, (lp + 1) / 2) ELSE 1 END, 9) AS left2, round(CASE WHEN lp = 6 THEN NULL WHEN lp > 0 AND lp % 2 = 0 THEN pow(io, lp / 2) ELSE 1 END, 9) AS right2 FROM p"""
)
def intensity_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right factors of an intensity position, in MPEG-1 and in the lower rates."""
    t = table(spark, sf_dir, "lineitem")
    one = L.intensity_mpeg1(F.col("l_partkey") % 8)
    two = L.intensity_lsf(F.col("l_suppkey") % 7, F.lit(6), F.col("l_linenumber") % 2 == 1)
    return t.select("l_orderkey", "l_linenumber", *(F.round(c, 9).alias(n) for c, n in zip((*one, *two), ("left1", "right1", "left2", "right2"))))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 512 AS s, l_suppkey % 2 = 1 AS isr FROM lineitem),
    q AS (SELECT *, CASE WHEN isr THEN s >> 1 ELSE s END AS v FROM p)
    SELECT l_orderkey, l_linenumber,
      CAST(CASE WHEN isr THEN CASE WHEN v < 180 THEN v // 36 WHEN v < 244 THEN ((v - 180) % 64) >> 4 ELSE (v - 244) // 3 END ELSE CASE WHEN v < 400 THEN (v >> 4) // 5 WHEN v < 500 THEN ((v - 400) >> 2) // 5 ELSE (v - 500) // 3 END END AS INTEGER) AS len0,
      CAST(CASE WHEN isr THEN CASE WHEN v < 180 THEN (v % 36) // 6 WHEN v < 244 THEN ((v - 180) % 16) >> 2 ELSE (v - 244) % 3 END ELSE CASE WHEN v < 400 THEN (v >> 4) % 5 WHEN v < 500 THEN ((v - 400) >> 2) % 5 ELSE (v - 500) % 3 END END AS INTEGER) AS len1,
      CAST(CASE WHEN isr THEN CASE WHEN v < 180 THEN v % 6 WHEN v < 244 THEN (v - 180) % 4 ELSE 0 END ELSE CASE WHEN v < 400 THEN (v % 16) >> 2 WHEN v < 500 THEN (v - 400) % 4 ELSE 0 END END AS INTEGER) AS len2,
      CAST(CASE WHEN NOT isr AND v < 400 THEN v % 4 ELSE 0 END AS INTEGER) AS len3,
      CAST(CASE WHEN isr THEN CASE WHEN v < 180 THEN 3 WHEN v < 244 THEN 4 ELSE 5 END ELSE CASE WHEN v < 400 THEN 0 WHEN v < 500 THEN 1 ELSE 2 END END AS INTEGER) AS groups_row, (NOT isr) AND v >= 500 AS preflag FROM q"""
)
def lsf_scalefactor_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 512).cast("int").alias("s"), (F.col("l_suppkey") % 2 == 1).alias("right"))
    lengths, row, preflag = L.lsf_lengths(F.col("s"), F.col("right"))
    return t.select("l_orderkey", "l_linenumber", *(x.cast("int").alias(f"len{k}") for k, x in enumerate(lengths)), row.alias("groups_row"), preflag.alias("preflag"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, [3, 5, 7, 9, 15, 31, 63, 127, 255, 511, 1023, 2047, 4095, 8191, 16383, 32767, 65535][l_suppkey % 17 + 1] AS steps, l_partkey AS v0, l_linenumber % 63 AS sf FROM lineitem),
    q AS (SELECT *, CAST(ceil(log2(steps)) AS INTEGER) AS nb, v0 % steps AS v FROM p)
    SELECT l_orderkey, l_linenumber, nb, CAST(v AS BIGINT) AS code, round((1 << nb) / CAST(steps AS DOUBLE) * (v / CAST(1 << (nb - 1) AS DOUBLE) - 1 + ((1 << nb) - steps + 1) / CAST(1 << nb AS DOUBLE)) * pow(2, 1 - sf / 3.0), 9) + 0.0 AS x,
      CAST(v0 % 3 AS BIGINT) AS d0, CAST(v0 // 3 % 3 AS BIGINT) AS d1, CAST(v0 // 9 % 3 AS BIGINT) AS d2 FROM q"""
)
def layer12_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the quantisation classes times their scalefactor, and the three digits of a grouped code."""
    steps = (3, 5, 7, 9, *((1 << k) - 1 for k in range(4, 17)))
    t = table(spark, sf_dir, "lineitem").withColumn("steps", F.get(F.array(*map(F.lit, steps)), (F.col("l_suppkey") % 17).cast("int")))
    t = t.withColumn("nb", L.sample_bits(F.col("steps"))).withColumn("code", F.col("l_partkey") % F.col("steps"))
    x = L.dequantised(F.col("code"), F.col("steps"), F.col("nb")) * L.scalefactor(F.col("l_linenumber") % 63)
    return t.select("l_orderkey", "l_linenumber", "nb", "code", (F.round(x, 9) + 0.0).alias("x"), *(d.alias(f"d{k}") for k, d in enumerate(L.grouped_digits(F.col("l_partkey"), F.lit(3)))))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 = 0 AS lsf, [44100, 48000, 32000][l_orderkey % 3 + 1] AS rate, [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384][l_partkey % 15 + 1] * 1000 AS br, l_linenumber % 2 + 1 AS ch FROM lineitem),
    s AS (SELECT *, CASE WHEN lsf THEN 'LSF' WHEN br <> 0 AND br // ch <= 48000 THEN CASE WHEN rate = 32000 THEN 'D' ELSE 'C' END WHEN (br <> 0 AND br // ch <= 80000) OR rate = 48000 THEN 'A' ELSE 'B' END AS alloc FROM p)
    SELECT l_orderkey, l_linenumber, alloc, CAST(CASE alloc WHEN 'A' THEN 27 WHEN 'C' THEN 8 WHEN 'D' THEN 12 ELSE 30 END AS INTEGER) AS subbands,
      CAST(CASE alloc WHEN 'A' THEN 88 WHEN 'B' THEN 94 WHEN 'C' THEN 26 WHEN 'D' THEN 38 ELSE 75 END AS INTEGER) AS allocation_bits FROM s"""
)
def layer2_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation table of a frame, its subbands and the bits a channel's allocation takes; the dimension is small enough for Spark to broadcast by its size."""
    t = table(spark, sf_dir, "lineitem")
    rate = F.get(F.array(*map(F.lit, (44100, 48000, 32000))), (F.col("l_orderkey") % 3).cast("int"))
    br = F.get(F.array(*(F.lit(1000 * k) for k in (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384))), (F.col("l_partkey") % 15).cast("int"))
    t = t.withColumn("alloc", L.allocation_table(F.col("l_suppkey") % 4 == 0, rate, br, F.col("l_linenumber") % 2 + 1))
    bits = L.allocation_dimension(spark).groupBy("alloc").agg(F.count(F.lit(1)).cast("int").alias("subbands"), F.sum("nbal").cast("int").alias("allocation_bits"))
    return t.join(bits, "alloc").select("l_orderkey", "l_linenumber", "alloc", "subbands", "allocation_bits")
