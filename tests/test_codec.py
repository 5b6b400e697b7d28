"""Samples to frames and back: a tone, its attack, gapless trimming, and Layer I beside Layer III."""

import numpy as np
from pyspark.sql import functions as F

from tonewright.operators import codec, filterbank
from tonewright.sources import tags

from .test_layer12 import layer1_frame
from .test_layer3 import codes


def test_encode_and_decode(spark, tmp_path):
    book, d = codes(tmp_path), filterbank.designed_prototype()
    n = 576 * 16
    x = 0.3 * np.sin(2 * np.pi * 440 / 44100 * np.arange(n)) + 0.1 * np.sin(2 * np.pi * 1320 / 44100 * np.arange(n))
    rows = [("t", c, k, b.tolist()) for c in (0, 1) for k, b in enumerate(x.reshape(-1, 32))]
    blocks = spark.createDataFrame(rows, "stream_id string, channel int, slot bigint, s array<double>")
    frames = codec.encode_pcm(blocks, book, d, 44100, 320)
    made = [(f.stream_id, f.frame_no, bytearray(f.bytes)) for f in frames.collect()]
    assert len(made) == -(-(n + 1057) // 1152) == 9
    frames = spark.createDataFrame(made, "stream_id string, frame_no bigint, bytes binary")
    tag = tags.tag_frames(frames, 50, 20000, 528, F.lit(n - 1057 - 1000)).collect()[0]
    layer1 = b"".join(layer1_frame(np.random.default_rng(k), 3)[0] for k in range(3))
    content = bytes(tag.bytes) + b"".join(bytes(b) for _, _, b in sorted(made, key=lambda m: m[1]))
    streams = spark.createDataFrame([("t", bytearray(content)), ("one", bytearray(layer1))], "stream_id string, content binary")
    got = codec.decode_streams(streams, book, d).collect()
    one = [p for p in got if p.stream_id == "one"]
    assert len(one) == 36 and all((p.keep_from, p.keep_to) == (0, 32) for p in one)
    mine = sorted((p for p in got if p.stream_id == "t" and p.channel == 0), key=lambda p: p.slot)
    y = np.concatenate([p.s for p in mine])
    kept = np.concatenate([p.s[p.keep_from : p.keep_to] for p in mine])
    delay = 481 + 576
    assert len(y) == 9 * 1152
    error = y[delay + 1200 : delay + n] - x[1200:]
    snr = 10 * np.log10((x**2).mean() / (error**2).mean())
    assert snr > 30, snr
    assert np.allclose(kept, y[1057 : 1057 + len(kept)])


def test_attacks_give_short_blocks(spark):
    r = np.random.default_rng(1)
    x = 0.001 * np.sin(np.arange(576 * 12) / 9)
    x[576 * 6 + 100 : 576 * 6 + 400] += r.normal(0, 0.4, 300)
    blocks = spark.createDataFrame([("a", 0, k, b.tolist()) for k, b in enumerate(x.reshape(-1, 32))], "stream_id string, channel int, slot bigint, s array<double>")
    kinds = [k.block_type for k in codec.block_types_of(blocks).orderBy("granule").collect()]
    assert kinds[5:8] == [1, 2, 3] and set(kinds[:5] + kinds[8:]) == {0}


def test_refused_frames_keep_their_time(spark, tmp_path):
    good = [layer1_frame(np.random.default_rng(k), 3)[0] for k in range(4)]
    bad = bytearray(good[1])
    bad[4:20] = b"\xff" * 16  # forbidden allocations
    frames = [good[0], bytes(bad), good[2], good[3]]
    rows = [("s", k, bytearray(f)) for k, f in enumerate(frames)] + [("t", k, bytearray(good[j])) for k, j in enumerate((0, 2, 3))]
    t = spark.createDataFrame(rows, "stream_id string, frame_no bigint, bytes binary")
    got = codec.played12(t, filterbank.designed_prototype()).collect()
    of = lambda s: {(r.channel, r.slot): (r.concealed, r.s) for r in got if r.stream_id == s}
    s, whole = of("s"), of("t")
    assert {k for _, k in s} == set(range(48)) and {k for _, k in whole} == set(range(36))
    for (c, k), (concealed, x) in s.items():
        assert concealed == (12 <= k < 24) and (not any(x) if concealed else x == whole[c, k if k < 12 else k - 12][1])
