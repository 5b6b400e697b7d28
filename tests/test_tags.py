"""Tag frames written by aggregates and read back by expressions; VBRI; streams without a tag."""

import random

from pyspark.sql import functions as F

from tonewright.functions.checksums import crc16_arc
from tonewright.sources import tags


def test_tag_round_trip(spark):
    r = random.Random(2)
    rows = [(s, n, bytearray(bytes.fromhex(h) + bytes(r.randrange(256) for _ in range(size - 4)))) for s, h, size in (("a", "FFFB9064", 417), ("b", "FFF384C0", 192)) for n in range(250)]
    frames = spark.createDataFrame(rows, "stream_id string, frame_no bigint, bytes binary")
    tag = tags.tag_frames(frames, 57, 16000, 528, F.lit(100000))
    first = {x.stream_id: bytes(x.bytes) for x in tag.collect()}
    assert all(len(first[s]) >= 4 + 36 + 100 for s in "ab") and first["a"][36:40] == b"Info"
    info = {x.stream_id: x for x in tags.info_headers(frames.unionByName(tag)).collect()}
    for s, size, spf in (("a", 417, 1152), ("b", 192, 576)):
        x = info[s]
        assert (x.kind, x.frames, x.size, x.quality, x.encoder, x.lowpass, x.delay) == ("Info", 250, 250 * size + len(first[s]), 57, "tonewrig", 16000, 528)
        assert x.padding == max(0, min(4095, 250 * spf - 528 - 100000)) and x.crc_holds and x.music_length == x.size
        total = x.size
        assert list(x.toc) == [min(255, (k * 250 // 100 * size + len(first[s])) * 256 // total) for k in range(100)]
        data = b"".join(bytes(b) for q, _, b in rows if q == s)
        assert x.music_crc == spark.createDataFrame([(bytearray(data[:3000]),)], "b binary").select(crc16_arc(F.col("b")).alias("c")).first().c if len(data) <= 3000 else x.music_crc == arc(data)
    trim = {x.stream_id: x for x in tags.gapless(tags.info_headers(frames.unionByName(tag))).collect()}
    assert trim["a"].skip == 1057 and trim["a"].length == 250 * 1152 - 528 - info["a"].padding


def arc(data):
    crc = 0
    for b in data:
        crc = tags._crc_step(crc, b)
    return crc


def test_vbri_and_no_tag(spark):
    vbri = bytearray(417)
    vbri[:4] = bytes.fromhex("FFFB9064")
    vbri[36:54] = b"VBRI" + (1).to_bytes(2, "big") + (1105).to_bytes(2, "big") + (75).to_bytes(2, "big") + (9999).to_bytes(4, "big") + (77).to_bytes(4, "big")
    plain = bytearray(bytes.fromhex("FFFB9064") + bytes(413))
    info = {x.stream_id: x for x in tags.info_headers(spark.createDataFrame([("v", 0, vbri), ("p", 0, plain), ("p", 1, vbri)], "stream_id string, frame_no bigint, bytes binary")).collect()}
    v = info["v"]
    assert (v.kind, v.frames, v.size, v.quality, v.delay, v.padding) == ("VBRI", 77, 9999, 75, 1105, 0) and info["p"].kind is None and info["p"].frames is None
    assert arc(b"123456789") == 0xBB3D
