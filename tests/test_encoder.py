"""Encoder against decoder: every frame's length, strict accounting, and the quantised lines read back."""

import numpy as np
import pytest

from tonewright.operators import analysis, encoder, layer3
from tonewright.sources import framing, sideinfo

from .test_layer3 import codes


@pytest.mark.parametrize("rate,kbps,channels,joint", [(44100, 128, 2, False), (48000, 64, 1, False), (22050, 64, 2, False), (44100, 160, 2, True), (48000, None, 2, True)])
def test_round_trip(spark, tmp_path, rate, kbps, channels, joint):
    r = np.random.default_rng(rate)
    book = codes(tmp_path)
    rows, kinds = [], [0, 0, 1, 2, 3, 0, 0, 1, 2, 2, 3, 0]
    for s in "ab":
        for g, t in enumerate(kinds):
            for c in range(channels):
                x = r.normal(size=576) if not (joint and c) else x * 0.9 + r.normal(size=576) * 0.001
                x = x if joint and c else x * np.exp(-np.arange(576) / 60) * (0.01 if g % 5 == 4 else 0.2)
                rows.append((s, g, c, t, x.tolist(), analysis.band_allowance(rate, t, np.full(576, 0.003), 1.0).tolist()))
    t = spark.createDataFrame(rows, "stream_id string, granule bigint, channel int, block_type int, x array<double>, allowed array<double>")
    frames = encoder.encode(t, book, rate, kbps, joint).collect()
    per = 1 if rate < 32000 else 2
    assert len(frames) == 2 * len(kinds) // per
    data = {s: b"".join(bytes(f.bytes) for f in sorted(frames, key=lambda f: f.frame_no) if f.stream_id == s) for s in "ab"}
    for s in "ab":
        assert len(framing.Framer(strict=True).feed(data[s], last=True)) == len(kinds) // per
    streams = spark.createDataFrame([(s, bytearray(d)) for s, d in data.items()], "stream_id string, content binary")
    got = layer3.spectrum(layer3.main_data(framing.frames(streams, strict=True)), book).collect()
    assert len(got) == len(rows) and all(x.exact and not x.concealed for x in got)
    truth = {(q[0], q[1], q[2]): q for q in rows}
    ratio = []
    for x in got:
        q = truth[x.stream_id, x.frame_no * per + x.granule, x.channel]
        assert x.block_type == q[3]
        place = layer3.order(rate, int(q[3] == 2))
        want = np.zeros(576)
        want[place] = analysis.coded_order(np.array(q[4]), rate, q[3])
        ratio.append(10 * np.log10((want**2).sum() / ((want - np.array(x.x)) ** 2).sum()))
    assert np.mean(ratio) > 8
    modes = {bytes(f.bytes)[3] >> 4 for f in frames}
    assert (6 in modes) == joint and (len({bytes(f.bytes)[2] >> 4 for f in frames}) > 1) == (kbps is None)
    begins = [sideinfo.parse(bytes(f.bytes))[0]["main_data_begin"] for f in frames]
    assert max(begins) <= (511 if per == 2 else 255) and max(begins) > 0
