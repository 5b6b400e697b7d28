"""Header queries: words drawn from ``lineitem`` hit valid and reserved values alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import checksums, header as H
from ..functions.tables import BITRATES_LSF, BITRATES_MPEG1, SAMPLE_RATES
from ..operators import streams
from .registry import SQL, query, sql_list, table

WORDS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_orderkey * 2654435761 + l_linenumber * 40503) & 2097151) | 4292870144 AS w FROM lineitem"""
_RATES = sql_list(k * 1000 for t in (BITRATES_MPEG1, BITRATES_LSF) for row in t for k in row)
FIELDS = f"""WITH words AS ({WORDS}),
bits AS (SELECT *, (w >> 19) & 3 AS vc, (w >> 17) & 3 AS lc, (w >> 16) & 1 AS prot, (w >> 12) & 15 AS bi, (w >> 10) & 3 AS ri, (w >> 9) & 1 AS pad, (w >> 6) & 3 AS md, w & 3 AS em FROM words),
valid AS (SELECT * FROM bits WHERE vc <> 1 AND lc <> 0 AND bi <> 15 AND ri <> 3 AND em <> 2),
geo AS (SELECT *, 4 - lc AS layer, CASE WHEN vc = 3 THEN 0 ELSE 1 END AS lsf,
    {sql_list(SAMPLE_RATES)}[ri + 1] // CASE vc WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS rate,
    {_RATES}[CASE WHEN vc = 3 THEN 0 ELSE 45 END + (3 - lc) * 15 + bi + 1] AS br FROM valid),
frames AS (SELECT *, CASE WHEN layer = 1 THEN 384 WHEN layer = 3 AND lsf = 1 THEN 576 ELSE 1152 END AS spf,
    CASE WHEN br = 0 THEN NULL WHEN layer = 1 THEN (12 * br // rate + pad) * 4 ELSE (CASE WHEN layer = 3 AND lsf = 1 THEN 72 ELSE 144 END) * br // rate + pad END AS len FROM geo)
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = (F.col("l_orderkey") * F.lit(2654435761) + F.col("l_linenumber") * 40503).bitwiseAND(F.lit(2097151)).bitwiseOR(F.lit(4292870144))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("w"))



@query(
    f"""{FIELDS} SELECT l_orderkey, l_linenumber, CASE vc WHEN 3 THEN '1' WHEN 2 THEN '2' WHEN 0 THEN '2.5' END AS version, CAST(4 - lc AS INTEGER) AS layer, prot = 0 AS crc, CAST(bi AS INTEGER) AS bitrate_index,
    CAST(ri AS INTEGER) AS rate_index, CAST(pad AS INTEGER) AS padding, CAST((w >> 8) & 1 AS INTEGER) AS private, CAST(md AS INTEGER) AS mode, CAST((w >> 4) & 3 AS INTEGER) AS mode_extension, CAST((w >> 3) & 1 AS INTEGER) AS copyright,
    CAST((w >> 2) & 1 AS INTEGER) AS original, CAST(em AS INTEGER) AS emphasis, vc <> 1 AND lc <> 0 AND bi <> 15 AND ri <> 3 AND em <> 2 AS valid FROM bits"""
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    plain = [H.field(w, k).alias(k) for k in ("bitrate_index", "rate_index", "padding", "private", "mode", "mode_extension", "copyright", "original", "emphasis")]
    return words(spark, sf_dir).select("l_orderkey", "l_linenumber", H.version(w).alias("version"), H.layer(w).alias("layer"), H.has_crc(w).alias("crc"), *plain, H.is_valid(w).alias("valid"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    t = words(spark, sf_dir).where(H.is_valid(w))
    return t.withColumns({"place": F.struct("l_linenumber", "l_partkey", "l_suppkey"), "layer": H.layer(w), "rate": H.sample_rate(w), "br": H.bitrate(w), "spf": H.samples(w), "len": H.frame_length(w), "ch": H.channels(w)})


@query(
    f"""{FIELDS} SELECT l_orderkey, l_linenumber, CAST(layer AS INTEGER) AS layer, CAST(rate AS INTEGER) AS sample_rate, CAST(br AS BIGINT) AS bitrate, CAST(spf AS INTEGER) AS samples, CAST(len AS BIGINT) AS frame_length, CASE WHEN md = 3 THEN 1 ELSE 2 END AS channels,
    CASE WHEN prot = 0 THEN 6 ELSE 4 END AS header_length, CASE WHEN layer = 3 THEN CASE WHEN lsf = 1 THEN CASE WHEN md = 3 THEN 9 ELSE 17 END ELSE CASE WHEN md = 3 THEN 17 ELSE 32 END END END AS side_info_length,
    upper(lpad(printf('%x', w), 8, '0')) AS bytes FROM frames"""
)
def header_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return frames(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "layer", F.col("rate").alias("sample_rate"), F.col("br").cast("bigint").alias("bitrate"), F.col("spf").alias("samples"), F.col("len").cast("bigint").alias("frame_length"),
        F.col("ch").alias("channels"), H.header_length(w).alias("header_length"), H.side_info_length(w).alias("side_info_length"), F.hex(H.to_bytes(w)).alias("bytes"),
    )


@query(
    f"""{FIELDS} SELECT CASE vc WHEN 3 THEN '1' WHEN 2 THEN '2' ELSE '2.5' END AS version, CAST(layer AS INTEGER) AS layer, count(*) AS frames, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(spf) AS BIGINT) AS samples, count(*) FILTER (br = 0) AS free_format
    FROM frames GROUP BY 1, 2"""
)
def header_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir).withColumn("version", H.version(F.col("w")))
    return t.groupBy("version", "layer").agg(F.count(F.lit(1)).alias("frames"), F.sum("len").alias("bytes"), F.sum("spf").alias("samples"), F.count_if(F.col("br") == 0).alias("free_format"))


@query(
    f"""{FIELDS} , k AS (SELECT *, vc * 32 + lc * 8 + ri * 2 + CASE WHEN bi = 0 THEN 1 ELSE 0 END AS key, CASE WHEN md = 3 THEN 1 ELSE 2 END AS ch FROM frames),
    l AS (SELECT *, lag(key) OVER o AS last_key, lag(ch) OVER o AS last_ch, lead(key) OVER o AS next_key FROM k WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT l_orderkey, l_linenumber, coalesce(key = last_key, false) AS follows, coalesce(key = next_key, false) AS confirmed,
      CAST(sum(CASE WHEN ch <> last_ch THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM l"""
)
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which headers may follow each other, and the segments between channel changes."""
    order = Window.partitionBy("l_orderkey").orderBy("place")
    t = frames(spark, sf_dir).withColumn("key", H.stream_key(F.col("w")))
    t = t.withColumn("follows", F.coalesce(F.col("key") == F.lag("key").over(order), F.lit(False))).withColumn("confirmed", F.coalesce(F.col("key") == F.lead("key").over(order), F.lit(False)))
    return streams.channel_segments(t, ["l_orderkey"], "place", "ch").select("l_orderkey", "l_linenumber", "follows", "confirmed", "segment")


@query(
    f"""{FIELDS} SELECT l_orderkey, l_linenumber, row_number() OVER o - 1 AS frame_no, CAST(coalesce(sum(len) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position,
    CAST(coalesce(sum(spf) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_sample FROM frames WHERE br > 0 WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"""
)
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = streams.offsets(frames(spark, sf_dir).where("br > 0"), ["l_orderkey"], "place", "len", "spf")
    return t.select("l_orderkey", "l_linenumber", "frame_no", "position", "first_sample")


@query(
    f"""{FIELDS} , o AS (SELECT l_orderkey, l_linenumber, spf, l_orderkey % 1200 AS delay, l_orderkey % 700 AS tail, row_number() OVER w1 AS n, count(*) OVER (PARTITION BY l_orderkey) AS total,
      CAST(coalesce(sum(spf) OVER (w1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(spf) OVER (PARTITION BY l_orderkey) AS BIGINT) AS everything FROM frames WINDOW w1 AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
    g AS (SELECT *, delay + 529 AS skip, greatest(everything - delay - tail, 0) AS length FROM o)
    SELECT l_orderkey, l_linenumber, CAST(skip AS BIGINT) AS skip, CAST(length AS BIGINT) AS length, CAST(greatest(least(skip, start + spf), start) - start AS BIGINT) AS keep_from,
      CAST(greatest(greatest(least(skip + length, start + spf), start) - start, greatest(least(skip, start + spf), start) - start) AS BIGINT) AS keep_to FROM g"""
)
def gapless_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which samples of each frame remain after the encoder's delay and padding are cut; delay and padding come from the order key."""
    return _trimmed(spark, sf_dir).select("l_orderkey", "l_linenumber", "skip", "length", "keep_from", "keep_to")


def _trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir).withColumn("delay", F.col("l_orderkey") % 1200).withColumn("tail", F.col("l_orderkey") % 700)
    return streams.gapless(t, ["l_orderkey"], "place", "spf", "delay", "tail")


@query(f"SELECT l_orderkey, l_linenumber, CAST(keep_to - keep_from AS BIGINT) AS samples, keep_to = keep_from AS empty FROM ({SQL['gapless_trim']})")
def frame_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that each frame gives out after trimming, and whether it is empty."""
    return streams.emitted(_trimmed(spark, sf_dir)).select("l_orderkey", "l_linenumber", "samples", "empty")


@query(
    f"""{FIELDS} , p AS (SELECT l_orderkey, CAST(coalesce(sum(len) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS frame_no, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(sum(len) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total FROM frames WHERE br > 0),
    i AS (SELECT unnest(range(100)) AS entry)
    SELECT l_orderkey, CAST(entry AS INTEGER) AS entry, CAST(least((position + 417) * 256 // (total + 417), 255) AS INTEGER) AS value FROM p JOIN i ON frame_no = entry * n // 100"""
)
def seek_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred seek points of each stream behind a tag frame of 417 bytes."""
    return streams.seek_points(frames(spark, sf_dir).where("br > 0"), ["l_orderkey"], "place", "len", 417).select("l_orderkey", "entry", "value")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, [32000, 40000, 48000, 56000, 64000, 80000, 96000, 112000, 128000, 160000, 192000, 224000, 256000, 320000][l_orderkey % 14 + 1] AS br, [44100, 48000, 32000][l_orderkey % 3 + 1] AS rate,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(n * (144 * br % rate) // rate - (n - 1) * (144 * br % rate) // rate AS INTEGER) AS padding, CAST(144 * br // rate + n * (144 * br % rate) // rate - (n - 1) * (144 * br % rate) // rate AS BIGINT) AS frame_length FROM f"""
)
def padding_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of a constant-rate stream carry a padding slot: the accumulator in closed form."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    t = t.withColumn("br", F.get(F.array(*(F.lit(1000 * k) for k in BITRATES_MPEG1[2][1:])), (F.col("l_orderkey") % 14).cast("int")))
    t = t.withColumn("rate", F.get(F.array(*map(F.lit, SAMPLE_RATES)), (F.col("l_orderkey") % 3).cast("int")))
    return streams.padding(t, ["l_orderkey"], "place", F.lit(1152), F.col("br"), F.col("rate")).select("l_orderkey", "l_linenumber", "padding", "frame_length")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, 4 + l_partkey % 1400 AS len, l_suppkey % 3 AS layer0, l_linenumber % 2 AS pad, [44100, 48000, 32000][l_orderkey % 3 + 1] AS rate FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN layer0 = 0 THEN (len // 4 - pad) * rate // 12 ELSE (len - pad) * rate // 144 END AS BIGINT) AS bitrate FROM f"""
)
def free_format_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumn("len", 4 + F.col("l_partkey") % 1400)
    word = H.build(version_code=F.lit(3), layer_code=3 - F.col("l_suppkey") % 3, bitrate_index=F.lit(0), rate_index=F.col("l_orderkey") % 3, padding=F.col("l_linenumber") % 2)
    return t.select("l_orderkey", "l_linenumber", H.measured_bitrate(F.col("len"), word).alias("bitrate"))


_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda v: CAST(('0x' || v) AS BIGINT))"
_TABLES = ", ".join(
    f"{name} AS (SELECT list(v ORDER BY n) AS {name} FROM (SELECT n, list_reduce(list_prepend({start}, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {step}) AS v FROM range(256) r(n)))"
    for name, start, step in (("arc_of", "n", "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 40961 ELSE 0 END)"), ("frame_of", "n << 8", "xor((x << 1) & 65535, CASE WHEN x & 32768 <> 0 THEN 32773 ELSE 0 END)"))
)


@query(
    f"""WITH {_TABLES}, b AS (SELECT doc_id, {_BYTES} AS bytes FROM documents)
    SELECT doc_id, CAST(list_reduce(list_prepend(0::BIGINT, bytes), lambda c, b: xor(c >> 8, arc_of[xor(c, b) % 256 + 1])) AS INTEGER) AS arc,
      CAST(list_reduce(list_prepend(65535::BIGINT, bytes), lambda c, b: xor((c << 8) & 65535, frame_of[xor(c >> 8, b) + 1])) AS INTEGER) AS frame FROM b, arc_of, frame_of"""
)
def checksums_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both CRC-16s over all bytes of each document."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return t.select("doc_id", checksums.crc16_arc(F.col("b")).alias("arc"), checksums.frame_crc(F.col("b")).alias("frame"))


@query(
    """WITH h AS (SELECT doc_id, md5(text) AS m FROM documents)
    SELECT doc_id, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) AS frames, CAST(('0x' || substr(m, 9, 8)) AS BIGINT) AS bytes, CAST(('0x' || substr(m, 17, 3)) AS INTEGER) AS delay, CAST(('0x' || substr(m, 20, 3)) AS INTEGER) AS padding,
      CAST(('0x' || substr(m, 23, 2)) AS INTEGER) * 100 AS lowpass, CAST(('0x' || substr(m, 25, 4)) AS INTEGER) AS music_crc,
      greatest(CAST(('0x' || substr(m, 1, 8)) AS BIGINT) * 1152 - CAST(('0x' || substr(m, 17, 3)) AS INTEGER) - CAST(('0x' || substr(m, 20, 3)) AS INTEGER), 0) AS length FROM h"""
)
def tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big-endian numbers and 12-bit pairs of a tag, and the gapless length they give."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5("text")).alias("b"))
    be = streams.big_endian
    b = F.col("b")
    t = t.select("doc_id", be(b, 1, 4).alias("frames"), be(b, 5, 4).alias("bytes"), F.shiftright(be(b, 9, 3), 12).cast("int").alias("delay"), be(b, 9, 3).bitwiseAND(F.lit(4095)).cast("int").alias("padding"), (be(b, 12, 1) * 100).cast("int").alias("lowpass"), be(b, 13, 2).cast("int").alias("music_crc"))
    return t.withColumn("length", F.greatest(F.col("frames") * 1152 - F.col("delay") - F.col("padding"), F.lit(0)))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(n AS BIGINT) AS frame_no, CAST(10 + n * 417 AS BIGINT) AS position, 'audio' AS kind, CAST(417 AS INTEGER) AS length, 'FFFB9064' AS head
    FROM documents, (SELECT unnest(range(4)) AS n)"""
)
def framed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag, noise and four frames made of each document's hash, framed again."""
    from ..sources import framing

    return _facts(framing.frames(_streams(spark, sf_dir)))


@query(SQL["framed_documents"])
def ranged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same streams cut into ranges of 700 bytes, framed range by range and joined at the seams."""
    from ..sources import ranges

    return _facts(ranges.frames_of_ranges(ranges.cut(_streams(spark, sf_dir), 700)))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.substring(F.repeat(F.md5("text"), 13), 1, 413)
    frame = F.concat(F.lit("FFFB9064"), F.hex(body))
    noise = F.lit("494433" + "03000000000000")  # an empty tag of ten bytes
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.unhex(F.concat(noise, F.repeat(frame, 4), F.hex(F.lit("TAG")), F.repeat(F.lit("20"), 125))).alias("content"))


def _facts(f: DataFrame) -> DataFrame:
    return f.select("stream_id", "frame_no", "position", "kind", F.length("bytes").alias("length"), F.hex(F.substring("bytes", 1, 4)).alias("head"))


@query(
    """WITH m AS (SELECT doc_id, md5(text) AS h FROM documents)
    SELECT doc_id, CAST(('0x' || substr(h, 1, 4)) AS INTEGER) >> 7 AS main_data_begin, CAST(('0x' || substr(h, 6, 3)) AS INTEGER) AS part2_3_length, CAST(('0x' || substr(h, 9, 3)) AS INTEGER) >> 3 AS big_values FROM m"""
)
def side_info_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fields of side information (9, 12 and 9 bits at 0, 20 and 32) cut out of sixteen bytes by shifts and masks."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.md5("text")).alias("b"))
    be = streams.big_endian
    b = F.col("b")
    return t.select(
        "doc_id", F.shiftright(be(b, 1, 2), 7).cast("int").alias("main_data_begin"), be(b, 3, 2).bitwiseAND(F.lit(4095)).cast("int").alias("part2_3_length"), F.shiftright(be(b, 5, 2), 7).cast("int").alias("big_values")
    )


@query(
    "SELECT doc_id, CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], "
    + _BYTES.replace("AS BIGINT", "AS HUGEINT")
    + "), lambda h, b: (h - h % 256 + xor((h % 256)::BIGINT, b::BIGINT)) * 1099511628211 % 18446744073709551616::HUGEINT) AS VARCHAR) AS fnv FROM documents"
)
def stream_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a over all bytes of each document."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return t.select("doc_id", checksums.fnv1a_64(F.col("b")).cast("string").alias("fnv"))
