"""Layer III steps on frames that the test writes with code tables of its own (fixed-length words, by rule)."""

import json

import numpy as np
import pytest

from tonewright.functions.tables import LONG_44, PRETAB, SHORT_44
from tonewright.operators import filterbank, layer3
from tonewright.sources import sideinfo


def codes(path):
    """Tables 1-3 hold values to 15 in 8-bit words, tables 5 and 6 the same with 4 and 13 linbits; count-1 words are the 4 bits themselves."""
    square = [[8, x << 4 | y, x, y] for x in range(16) for y in range(16)]
    quad = [[4, k, k >> 3 & 1, k >> 2 & 1, k >> 1 & 1, k & 1] for k in range(16)]
    raw = {"pairs": {**{str(k): {"linbits": 0, "codes": square} for k in (1, 2, 3)}, "5": {"linbits": 4, "codes": square}, "6": {"linbits": 13, "codes": square}}, "quads": [quad, [[4, 15 - k, *c[2:]] for k, c in enumerate(quad)]]}
    (path / "codes.json").write_text(json.dumps(raw))
    return layer3.Codes.load(str(path / "codes.json"))


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, v, n):
        self.value, self.size = self.value << int(n) | int(v), self.size + int(n)


def granule(r, block_type=0, mixed=0, big=60, table=1):
    """Random lines and scalefactors, and the bits that code them."""
    w = Writer()
    compress = int(r.integers(0, 16))
    kind = (2 if mixed else 1) if block_type == 2 else 0
    a, b = layer3.SLEN1[compress], layer3.SLEN2[compress]
    sf = np.zeros((22, 4), int)
    places = [(x, 3) for x in range({0: 21, 1: 0, 2: 8}[kind])] + [(x, k) for x in range({0: 13, 1: 0, 2: 3}[kind], 12) for k in range(3)]
    for x, k in places:
        n = a if (x < 11 if k == 3 else x < 6) else b
        sf[x, k] = r.integers(0, 1 << n)
        w.put(sf[x, k], n)
    lines = np.zeros(576, int)
    lines[: 2 * big] = r.integers(-30 if table == 5 else -15, 31 if table == 5 else 16, 2 * big)
    lines[2 * big : 2 * big + 8] = r.integers(-1, 2, 8)
    for k in range(0, 2 * big, 2):
        x, y = abs(lines[k]), abs(lines[k + 1])
        w.put(min(x, 15) << 4 | min(y, 15), 8)
        for v, s in ((x, lines[k]), (y, lines[k + 1])):
            if table == 5 and v >= 15:
                w.put(v - 15, 4)
            if v:
                w.put(s < 0, 1)
    for k in range(2 * big, 2 * big + 8, 4):
        w.put(int("".join(str(abs(v)) for v in lines[k : k + 4]), 2), 4)
        for v in lines[k : k + 4]:
            if v:
                w.put(v < 0, 1)
    switched = int(block_type > 0)
    g = {"part2_3_length": w.size, "big_values": big, "global_gain": int(r.integers(170, 200)), "scalefac_compress": compress, "window_switching": switched, "block_type": block_type, "mixed_block": mixed, "table_select": [table] * (2 if switched else 3)}
    g |= {"subblock_gain": [int(x) if switched else 0 for x in r.integers(0, 3, 3)], "region0_count": 7, "region1_count": 7, "preflag": int(r.integers(0, 2)), "scalefac_scale": int(r.integers(0, 2)), "count1_table": 0, "scfsi": [0, 0, 0, 0]}
    return g, lines, sf, w


def frame(parts, begin=0, mode=0, ext=0, head=0xFFFB9000, size=417):
    """A frame of four (granule, channel) parts; what does not fit is returned for the next one's reservoir."""
    rows, w = [], Writer()
    for n, (g, _, _, bits) in enumerate(parts):
        rows.append(g | {"granule": n // 2, "channel": n % 2, "main_data_begin": begin})
        w.put(bits.value, bits.size)
    w.put(0, -w.size % 8)
    main = w.value.to_bytes(w.size // 8, "big")
    return (head | mode << 6 | ext << 4).to_bytes(4, "big") + sideinfo.pack(rows, False, False), main


def requantised(g, lines, sf):
    """By the standard's formula, line by line."""
    out, at = np.zeros(576), 0
    step = 1.0 if g["scalefac_scale"] else 0.5
    kind = (2 if g["mixed_block"] else 1) if g["block_type"] == 2 else 0
    bands = []
    if kind != 1:
        bands += [(b, 3, hi - lo) for b, (lo, hi) in enumerate(zip(LONG_44, LONG_44[1:])) if kind == 0 or hi <= 36]
    if kind:
        bands += [(b, w, hi - lo) for b, (lo, hi) in enumerate(zip(SHORT_44, SHORT_44[1:])) if kind == 1 or lo >= 12 for w in range(3)]
    for b, w, n in bands:
        up = sf[b, w] + (PRETAB[b] * g["preflag"] if w == 3 else 0)
        e = (g["global_gain"] - 210) / 4 - step * up - (2 * g["subblock_gain"][w] if w < 3 else 0)
        for k in range(at, at + n):
            out[k] = np.sign(lines[k]) * abs(lines[k]) ** (4 / 3) * 2**e
        at += n
    return out


@pytest.mark.parametrize("block_type,mixed,table", [(0, 0, 1), (0, 0, 5), (1, 0, 2), (2, 0, 1), (2, 1, 3), (3, 0, 1)])
@pytest.mark.parametrize("ms", [0, 1])
def test_frame_spectrum(tmp_path, block_type, mixed, table, ms):
    r = np.random.default_rng(block_type + 10 * mixed + table)
    book = codes(tmp_path)
    parts = [granule(r, block_type, mixed, table=table) for _ in range(4)]
    head, main = frame(parts, mode=1 if ms else 0, ext=2 if ms else 0)
    got = layer3.frame_spectrum(head, main, book)
    want = [requantised(*p[:3]) for p in parts]
    if ms:
        want = [f(want[k], want[k + 1]) for k in (0, 2) for f in (lambda a, b: (a + b) / 2**0.5, lambda a, b: (a - b) / 2**0.5)]
    place = layer3.order(44100, (2 if mixed else 1) if block_type == 2 else 0)
    assert sorted(place) == list(range(576))
    for (_, _, kind, _, exact, y), x in zip(got, want):
        assert kind == block_type and exact
        np.testing.assert_allclose(y[place], x, rtol=1e-12, atol=1e-15)


def test_intensity_takes_the_bands_above_the_right_channel():
    g = {"block_type": 0, "mixed_block": 0, "scalefac_compress": 0}
    left, right = np.ones(576), np.zeros(576)
    right[:5] = 1.0  # bands 0 and 1
    sf, most = np.zeros((22, 4), int), np.full((22, 4), 7)
    sf[2, 3], sf[3, 3], sf[4, 3], sf[20, 3] = 6, 7, 3, 6
    facts = {"intensity": True, "ms": False, "lsf": False, "rate": 44100}
    l, r = layer3.stereo(left, right, g, sf, most, facts)
    assert (l[8:12] == 1).all() and (r[8:12] == 0).all()  # position 6
    assert (l[12:16] == 1).all() and (r[12:16] == 0).all()  # 7: not coded, left as it was
    np.testing.assert_allclose([l[16], r[16]], [0.5, 0.5])
    assert (l[418:] == 1).all() and (r[418:] == 0).all()  # the last band goes on with the one below
    right[400] = 1.0
    l, r = layer3.stereo(left, right, g, sf, most, facts)
    np.testing.assert_allclose([l[500], r[500]], [0, 1])  # coding starts at the last band: position 0


def test_transforms_reconstruct_over_block_sequences():
    matrices, (cs, ca) = layer3._transforms()
    np.testing.assert_allclose(cs**2 + ca**2, 1)
    r = np.random.default_rng(0)
    x = r.normal(size=18 * 12)
    kinds = [0, 0, 1, 2, 2, 3, 0, 1, 2, 3, 0]
    out = np.zeros(18 * 12)
    for n, t in enumerate(kinds):
        part = x[18 * n : 18 * n + 36]
        lines = matrices[t].T @ part / (3 if t == 2 else 9)
        out[18 * n : 18 * n + 36] += matrices[t] @ lines
    np.testing.assert_allclose(out[18 : 18 * 11], x[18 : 18 * 11], atol=1e-9)


def test_stream_with_reservoir(spark, tmp_path):
    """Frames whose main data starts in the one before decode to the same as self-contained ones; one before the stream is silence."""
    r = np.random.default_rng(7)
    book = codes(tmp_path)
    whole = []
    for n in range(6):
        parts = [granule(r, kind, 0, big=40) for kind in ([0] * 4 if n != 3 else [0, 0, 1, 1])]
        whole.append(frame(parts, head=0xFFFBE000))
    rows = [("w", n, bytearray(head + main)) for n, (head, main) in enumerate(whole)]
    lost = [p | {"main_data_begin": 300} for p in sideinfo.parse(whole[0][0])]
    rows += [("x", 0, bytearray(whole[0][0][:4] + sideinfo.pack(lost, False, False) + whole[0][1])), ("x", 1, rows[1][2])]
    half = len(whole[1][1]) // 2 if len(whole[1][1]) < 1000 else 200
    late = [p | {"main_data_begin": half} for p in sideinfo.parse(whole[1][0])]
    rows += [("y", 0, bytearray(whole[0][0] + whole[0][1] + whole[1][1][:half])), ("y", 1, bytearray(whole[1][0][:4] + sideinfo.pack(late, False, False) + whole[1][1][half:]))]
    frames = spark.createDataFrame(rows, "stream_id string, frame_no bigint, bytes binary")
    mains = layer3.main_data(frames)
    spectra = layer3.spectrum(mains, book)
    got = {(x.stream_id, x.frame_no, x.granule, x.channel): x for x in spectra.collect()}
    assert all(got["x", 0, g, c].concealed and not any(got["x", 0, g, c].x) for g in (0, 1) for c in (0, 1))
    for n in (0, 1):
        for g in (0, 1):
            for c in (0, 1):
                assert got["y", n, g, c].x == got["w", n, g, c].x and not got["y", n, g, c].concealed
    assert got["x", 1, 0, 0].x == got["w", 1, 0, 0].x
    pcm = layer3.decode(frames.where("stream_id = 'w'"), book, filterbank.designed_prototype()).where("channel = 0").orderBy("slot").collect()
    assert [p.slot for p in pcm] == list(range(18 * 12))
    y = layer3.inverse_hybrid(np.array([got["w", n, g, 0].x for n in range(6) for g in (0, 1)]), np.array([got["w", n, g, 0].block_type for n in range(6) for g in (0, 1)]), np.zeros(12, int))
    slots = np.zeros((18 * 12, 32))
    for k in range(12):
        v = y[k, :, :18] + (y[k - 1, :, 18:] if k else 0)
        v[1::2, 1::2] *= -1
        slots[18 * k : 18 * k + 18] = v.T
    history = np.concatenate([np.zeros((15, 32)), slots])
    want = filterbank.synthesise_slots(np.stack([history[k : k + 16] for k in range(len(slots))]), filterbank.designed_prototype())
    np.testing.assert_allclose(np.array([p.s for p in pcm]), want, rtol=1e-4, atol=1e-5)


def test_loaded_tables_are_checked(tmp_path):
    book = codes(tmp_path)
    raw = json.loads((tmp_path / "codes.json").read_text())
    for spoil, word in ((lambda r: r["quads"][0].pop(), "values have a word"), (lambda r: r["pairs"]["1"]["codes"].__setitem__(0, [3, 0, 0, 0]), "begins another"), (lambda r: r["pairs"]["5"].update(codes=[[2, k, k >> 1, k & 1] for k in range(4)]), "linbits")):
        bad = json.loads(json.dumps(raw))
        spoil(bad)
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=word):
            layer3.Codes.load(str(tmp_path / "bad.json"))
    bits = sideinfo.Bits(bytes([0x35, 0xF0]))
    assert book.symbol(bits, 1) == (3, 5) and book.symbol(bits, -1) == (1, 1, 1, 1) and bits.left == 4


def test_loaded_prototype(tmp_path):
    d = filterbank.designed_prototype()
    for n, ok in ((512, True), (257, True), (300, False)):
        (tmp_path / "d.json").write_text(json.dumps(d[:n].tolist()))
        if ok:
            assert np.allclose(filterbank.load_prototype(str(tmp_path / "d.json")), d)
        else:
            with pytest.raises(ValueError):
                filterbank.load_prototype(str(tmp_path / "d.json"))
