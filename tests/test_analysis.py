"""Analysis against synthesis: hybrid reconstruction through Spark, and the quantiser's allowance."""

import numpy as np

from tonewright.operators import analysis, filterbank, layer3


def test_hybrid_round_trip(spark):
    r = np.random.default_rng(2)
    slots = r.normal(size=(18 * 9, 32))
    kinds = [0, 1, 2, 2, 3, 0, 1, 2, 3]
    rows = spark.createDataFrame([("s", 0, k, x.tolist()) for k, x in enumerate(slots)], "stream_id string, channel int, slot bigint, s array<double>")
    types = spark.createDataFrame([(k, t) for k, t in enumerate(kinds)], "granule bigint, block_type int")
    lines = analysis.forward_hybrid(analysis.granules(rows).join(types, "granule"))
    spectra = lines.selectExpr("stream_id", "granule AS frame_no", "0 AS granule", "channel", "block_type", "0 AS mixed", "x")
    back = layer3.hybrid(spectra).orderBy("slot").collect()
    got = np.array([x.s for x in back])
    np.testing.assert_allclose(got[18:], slots[:-18], atol=2e-4)


def test_quantiser_meets_the_allowance(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(12):
        t = 2 if k % 3 == 2 else 0
        x = r.normal(size=576) * np.exp(-np.arange(576) / 90) * 0.3
        rows.append(("s", 0, k, t, x.tolist(), analysis.band_allowance(44100, t, x, 0.02).tolist()))
    rows.append(("s", 0, 12, 0, [0.0] * 576, [0.0] * 22))
    t = spark.createDataFrame(rows, "stream_id string, channel int, granule bigint, block_type int, x array<double>, allowed array<double>")
    for q in analysis.quantise_lines(t, 44100).collect():
        x, allowed = np.array(rows[q.granule][4]), np.array(rows[q.granule][5])
        y = analysis.coded_order(x, 44100, q.block_type)
        kind = int(q.block_type == 2)
        band, window = layer3.layout(44100, kind)
        cell = band * 3 + np.maximum(window, 0) if kind else band
        noise = np.bincount(cell, weights=(y - analysis.dequantised(q, 44100, q.block_type)) ** 2, minlength=len(allowed))
        inner = np.arange(len(allowed)) // (3 if kind else 1) < (12 if kind else 21)
        assert np.abs(q.ix).max() <= analysis.MOST_VALUE and (q.clipped > 0 or (noise[inner] <= allowed[inner] * 1.3 + 1e-12).mean() > 0.9)


def test_a_tone_survives_the_whole_chain(spark):
    n = 18 * 16 * 32
    x = 0.5 * np.sin(2 * np.pi * 1000 / 44100 * np.arange(n))
    d = filterbank.designed_prototype()
    blocks = spark.createDataFrame([("t", 0, k, b.tolist()) for k, b in enumerate(x.reshape(-1, 32))], "stream_id string, channel int, slot bigint, s array<double>")
    bands = filterbank.analyse(blocks, ["stream_id", "channel"], "slot", "s", d)
    lines = analysis.forward_hybrid(analysis.granules(bands).selectExpr("*", "0 AS block_type"))
    spectra = lines.selectExpr("stream_id", "granule AS frame_no", "0 AS granule", "channel", "block_type", "0 AS mixed", "x")
    pcm = filterbank.synthesise(layer3.hybrid(spectra), ["stream_id", "channel"], "slot", "s", d).orderBy("slot").collect()
    y = np.concatenate([p.s for p in pcm])
    delay = 481 + 576
    error = y[delay + 1000 :] - x[1000 : len(y) - delay]
    assert 10 * np.log10((x**2).mean() / (error**2).mean()) > 45
