"""The readers of frames over bytes that documents' hashes make: side information, info headers, Layer I, counts of what a stream holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import measures as M
from ..sources import layer12, sideinfo, tags
from .registry import query, sql_list, table

_NIBBLES = sql_list(f"'{k:04b}'" for k in range(16))
_SIDE = f"""b AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(md5(text) || md5(text || 'x'), '.'), lambda c: {_NIBBLES}[CAST(('0x' || c) AS INTEGER) + 1]), '') AS s FROM documents),
  o AS (SELECT doc_id, s, CAST(k // 2 AS INTEGER) AS granule, CAST(k % 2 AS INTEGER) AS channel, 21 + 59 * k AS o FROM b, (SELECT unnest(range(4)) AS k)),
  w AS (SELECT *, substr(s, o + 33, 1) = '1' AS sw FROM o),
  f AS (SELECT doc_id, granule, channel, CAST(('0b' || substr(s, 1, 9)) AS INTEGER) AS main_data_begin, CAST(('0b' || substr(s, o, 12)) AS INTEGER) AS part2_3_length, CAST(('0b' || substr(s, o + 12, 9)) AS INTEGER) AS big_values,
    CAST(('0b' || substr(s, o + 21, 8)) AS INTEGER) AS global_gain, CAST(('0b' || substr(s, o + 29, 4)) AS INTEGER) AS scalefac_compress, CAST(sw AS INTEGER) AS window_switching,
    CASE WHEN sw THEN CAST(('0b' || substr(s, o + 34, 2)) AS INTEGER) ELSE 0 END AS block_type, CASE WHEN sw THEN CAST(('0b' || substr(s, o + 36, 1)) AS INTEGER) ELSE 0 END AS mixed_block,
    CASE WHEN sw THEN [CAST(('0b' || substr(s, o + 37, 5)) AS INTEGER), CAST(('0b' || substr(s, o + 42, 5)) AS INTEGER)] ELSE [CAST(('0b' || substr(s, o + 34, 5)) AS INTEGER), CAST(('0b' || substr(s, o + 39, 5)) AS INTEGER), CAST(('0b' || substr(s, o + 44, 5)) AS INTEGER)] END AS tables,
    CASE WHEN sw THEN 36 ELSE CAST(('0b' || substr(s, o + 53, 3)) AS INTEGER) END AS region1_count, CAST(('0b' || substr(s, o + 56, 1)) AS INTEGER) AS preflag, CAST(('0b' || substr(s, o + 58, 1)) AS INTEGER) AS count1_table FROM w),
  j AS (SELECT *, big_values > 288 OR (window_switching = 1 AND block_type = 0) OR list_has_any(tables, [4, 14]) AS bad FROM f),
  r AS (SELECT doc_id, bool_or(bad) AS refused FROM j GROUP BY 1)"""
_FIELDS = ("main_data_begin", "part2_3_length", "big_values", "global_gain", "scalefac_compress", "window_switching", "block_type", "mixed_block", "region1_count", "preflag", "count1_table")


def hashed_side_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_no, bytes): a stereo frame per document whose side information is two of its hashes."""
    data = F.unhex(F.concat(F.lit("FFFB9064"), F.md5("text"), F.md5(F.concat("text", F.lit("x"))), F.repeat(F.lit("00"), 381)))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.lit(0).cast("bigint").alias("frame_no"), data.alias("bytes"))


@query(
    f"""WITH {_SIDE} SELECT doc_id, granule, channel, {", ".join(_FIELDS)}, tables[1] AS table0, tables[2] AS table1, false AS refused FROM j JOIN r USING (doc_id) WHERE NOT refused
    UNION ALL SELECT doc_id, NULL, NULL, {", ".join("NULL" for _ in _FIELDS)}, NULL, NULL, true FROM r WHERE refused"""
)
def parsed_side_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side information read bit by bit; a frame with values that the standard forbids is refused as a whole."""
    t = sideinfo.side_info(hashed_side_frames(spark, sf_dir))
    return t.select(F.col("stream_id").cast("bigint").alias("doc_id"), "granule", "channel", *_FIELDS, *(F.get("table_select", F.lit(k)).alias(f"table{k}") for k in range(2)), F.col("error").isNotNull().alias("refused"))


@query(
    f"""WITH {_SIDE} SELECT doc_id, CAST(sum(CASE WHEN block_type = 2 THEN 1 ELSE 0 END) AS BIGINT) AS short_blocks, CAST(count(*) AS BIGINT) AS granules, CAST(sum(part2_3_length) AS BIGINT) AS bits, CAST(1 AS BIGINT) AS frames, CAST(1 AS BIGINT) AS mid_side
    FROM j JOIN r USING (doc_id) WHERE NOT refused GROUP BY 1"""
)
def coding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short blocks, bits of main data and mid/side frames of each stream whose side information is accepted."""
    frames = hashed_side_frames(spark, sf_dir)
    t = M.coding_counts(frames, sideinfo.side_info(frames))
    return t.select(F.col("stream_id").cast("bigint").alias("doc_id"), "short_blocks", "granules", "bits", "frames", "mid_side")


@query(
    """WITH h AS (SELECT doc_id, md5(text) AS m FROM documents)
    SELECT doc_id, 'Info' AS kind, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) AS frames, CAST(('0x' || substr(m, 9, 8)) AS BIGINT) AS size, CAST(('0x' || substr(m, 17, 8)) AS BIGINT) AS quality, 'abcdEFGH1' AS encoder, CAST(('0x' || substr(m, 25, 2)) AS BIGINT) * 100 AS lowpass,
      CAST(('0x' || substr(m, 27, 6)) AS BIGINT) >> 12 AS delay, CAST(('0x' || substr(m, 27, 6)) AS BIGINT) & 4095 AS padding, CAST(('0x' || substr(m, 9, 8)) AS BIGINT) AS music_length, CAST(('0x' || substr(m, 1, 4)) AS BIGINT) AS music_crc,
      (CAST(('0x' || substr(m, 27, 6)) AS BIGINT) >> 12) + 529 AS skip, greatest(CAST(('0x' || substr(m, 1, 8)) AS BIGINT) * 1152 - (CAST(('0x' || substr(m, 27, 6)) AS BIGINT) >> 12) - (CAST(('0x' || substr(m, 27, 6)) AS BIGINT) & 4095), 0) AS length FROM h"""
)
def read_info_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info headers of frames whose fields are pieces of a hash, and the gapless figures that follow."""
    m = F.md5("text")
    cut = lambda at, n: F.substring(m, at, n)
    head = F.concat(F.lit("FFFB9064" + "00" * 32), F.hex(F.lit("Info").cast("binary")), F.lit("0000000F"), cut(1, 8), cut(9, 8), F.repeat(F.lit("07"), 100), cut(17, 8))
    lame = F.concat(F.hex(F.lit("abcdEFGH1").cast("binary")), F.lit("00"), cut(25, 2), F.lit("00" * 10), cut(27, 6), F.lit("00" * 4), cut(9, 8), cut(1, 4), F.lit("0000"))
    data = F.unhex(F.rpad(F.concat(head, lame), 834, "0"))
    frames = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.lit(0).cast("bigint").alias("frame_no"), data.alias("bytes"))
    info = tags.info_headers(frames)
    fields = ["kind", "frames", "size", "quality", "encoder", "lowpass", "delay", "padding", "music_length", "music_crc"]
    both = info.select("stream_id", *fields).join(tags.gapless(info), "stream_id")
    return both.select(F.col("stream_id").cast("bigint").alias("doc_id"), *fields, "skip", "length")


@query(
    """WITH a AS (SELECT doc_id, translate(md5(text), 'f', '0') AS m FROM documents), s AS (SELECT doc_id, sb, CAST(('0x' || substr(m, sb + 1, 1)) AS INTEGER) AS alloc FROM a, (SELECT unnest(range(32)) AS sb))
    SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(sb AS INTEGER) AS subband, CASE WHEN alloc = 0 THEN 0.0 ELSE round(2.0 * ((2 << alloc) / ((2 << alloc) - 1.0)) * (2.0 / (2 << alloc) - 1), 4) END + 0.0 AS x FROM s, (SELECT unnest(range(12)) AS slot)"""
)
def layer1_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer I frames of one channel whose bit allocation is a hash (15 is forbidden and made 0): the lowest code of each width, at scalefactor 0."""
    data = F.unhex(F.concat(F.lit("FFFFE0C0"), F.translate(F.md5("text"), "f", "0"), F.repeat(F.lit("00"), 800)))
    frames = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stream_id"), F.lit(0).cast("bigint").alias("frame_no"), data.alias("bytes"))
    t = layer12.subbands(frames).select(F.col("stream_id").cast("bigint").alias("doc_id"), "slot", F.posexplode("s").alias("subband", "x"))
    return t.select("doc_id", "slot", "subband", (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query(
    """WITH p AS (SELECT event_id // 256 AS segment, step, CAST(round(value * 1000) AS BIGINT) AS v, CAST(round(value * 1000) AS BIGINT) // step * step AS ref FROM events, (SELECT unnest([16, 4, 8]) AS step)),
    e AS (SELECT segment, step, CAST(sum((v - ref) * (v - ref)) AS BIGINT) AS err FROM p GROUP BY 1, 2)
    SELECT CAST(segment AS BIGINT) AS segment, CAST(arg_min(step, err) AS INTEGER) AS variant, CAST(min(err) AS BIGINT) AS err FROM e GROUP BY 1"""
)
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three coarser copies of each segment, the reference it is nearest to."""
    v = F.round(F.col("value") * 1000).cast("bigint")
    t = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 256).alias("segment"), v.alias("v"), F.explode(F.array(*map(F.lit, (16, 4, 8)))).alias("variant"))
    t = t.withColumn("ref", F.floor(F.col("v") / F.col("variant")) * F.col("variant"))
    return M.best_variants(t, ["segment"], "variant", "v", "ref").select("segment", "variant", "err")
