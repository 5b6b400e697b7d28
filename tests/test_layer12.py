"""Layer I and II frames written by the test and read back; the filterbank's reconstruction; slots through Spark."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tonewright.functions.tables import SUBBANDS
from tonewright.operators import filterbank
from tonewright.sources import layer12


class Writer:
    def __init__(self):
        self.value, self.size = 1, 0

    def put(self, v, n):
        self.value, self.size = self.value << int(n) | int(v), self.size + int(n)

    def bytes(self, total):
        return (self.value << (8 * total - self.size)).to_bytes(total + 1, "big")[1:]


def layer1_frame(r, mode, ext=0):
    """A 448 kb/s frame at 32 kHz, and the slots it holds."""
    head = 0xFFFF0000 | 14 << 12 | 2 << 10 | mode << 6 | ext << 4
    channels, bound = (1 if mode == 3 else 2), (4 + 4 * ext if mode == 1 else 32)
    w = Writer()
    alloc = r.integers(0, 6, (32, channels))
    alloc[bound:] = alloc[bound:, :1]
    for sb in range(32):
        for c in range(channels if sb < bound else 1):
            w.put(alloc[sb, c], 4)
    scale = r.integers(0, 63, (32, channels))
    for sb, c in zip(*np.nonzero(alloc)):
        w.put(scale[sb, c], 6)
    out = np.zeros((12, channels, 32))
    for slot in range(12):
        for sb in range(32):
            for c in range(channels if sb < bound else 1):
                n = alloc[sb, c] + 1
                if n > 1:
                    code = int(r.integers(0, (1 << n) - 1))
                    w.put(code, n)
                    x = (2 * code - ((1 << n) - 2)) / ((1 << n) - 1)  # symmetric levels around zero
                    for d in [c] if sb < bound else range(channels):
                        out[slot, d, sb] = x * 2 ** (1 - scale[sb, d] / 3)
    return head.to_bytes(4, "big") + w.bytes(12 * 448000 // 32000 * 4 - 4), out


@pytest.mark.parametrize("mode,ext", [(0, 0), (1, 0), (1, 2), (2, 0), (3, 0)])
def test_layer1(mode, ext):
    r = np.random.default_rng(mode * 4 + ext)
    for _ in range(5):
        frame, want = layer1_frame(r, mode, ext)
        np.testing.assert_allclose(layer12.decode(frame), want, atol=1e-12)


@pytest.mark.parametrize("rate,index,mode,name", [(0, 10, 0, "B"), (1, 8, 0, "A"), (2, 1, 3, "D"), (0, 1, 3, "C")])
def test_layer2(rate, index, mode, name):
    r = np.random.default_rng(index)
    head = 0xFFFD0000 | index << 12 | rate << 10 | mode << 6
    kbps = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192)[index]
    channels = 1 if mode == 3 else 2
    assert layer12.layer2_table(False, (44100, 48000, 32000)[rate], kbps * 1000, channels) == name
    rows = [layer12.allocation_row(name, sb) for sb in range(SUBBANDS[name])]
    w = Writer()
    alloc = np.array([[r.integers(0, 3) if sb < 6 else 0 for _ in range(channels)] for sb in range(len(rows))])
    for sb, row in enumerate(rows):
        for c in range(channels):
            w.put(alloc[sb, c], len(row).bit_length())
    used = list(zip(*np.nonzero(alloc)))
    how = {at: int(r.integers(0, 4)) for at in used}
    for at in used:
        w.put(how[at], 2)
    factor = {}
    for at in used:
        sent = [int(r.integers(0, 63)) for _ in range({0: 3, 1: 2, 2: 1, 3: 2}[how[at]])]
        for s in sent:
            w.put(s, 6)
        pick = {0: (0, 1, 2), 1: (0, 0, 1), 2: (0, 0, 0), 3: (0, 1, 1)}[how[at]]
        factor[at] = [2 ** (1 - sent[k] / 3) for k in pick]
    want = np.zeros((36, channels, 32))
    for t in range(12):
        for sb, row in enumerate(rows):
            for c in range(channels):
                if alloc[sb, c]:
                    steps = row[alloc[sb, c] - 1]
                    codes = [int(r.integers(0, steps)) for _ in range(3)]
                    if steps in (3, 5, 9):
                        w.put(codes[0] + steps * codes[1] + steps**2 * codes[2], {3: 5, 5: 7, 9: 10}[steps])
                    else:
                        for v in codes:
                            w.put(v, steps.bit_length())
                    for k, v in enumerate(codes):
                        want[3 * t + k, c, sb] = (2 * v - (steps - 1)) / steps * factor[sb, c][t // 4]
    frame = head.to_bytes(4, "big") + w.bytes(max(144 * kbps * 1000 // (44100, 48000, 32000)[rate], (w.size + 7) // 8))
    np.testing.assert_allclose(layer12.decode(frame), want, atol=1e-12)


def test_crc_and_refusals(spark):
    assert layer12.frame_crc(0xFFFF, int.from_bytes(b"123456789", "big"), 72) == 0xAEE7
    bad = bytes.fromhex("FFFFE800") + b"\xff" * 668
    good, _ = layer1_frame(np.random.default_rng(0), 3)
    rows = spark.createDataFrame([("a", 0, bytearray(good)), ("a", 1, bytearray(bad)), ("a", 2, bytearray(good[:40]))], "stream_id string, frame_no bigint, bytes binary")
    got = layer12.subbands(rows).collect()
    assert sum(x.frame_no == 0 for x in got) == 12 and [x.error is None for x in got if x.frame_no] == [False, False]


def test_frames_of_many_layouts_together():
    r = np.random.default_rng(5)
    made = [layer1_frame(r, *kind) for kind in [(0, 0), (1, 0), (1, 2), (3, 0)] * 4]
    frames = [made[k % 16][0] for k in range(700)]
    frames[::7] = [f[:40] for f in frames[::7]]
    frames[1::7] = [f[:4] + b"\xff" * 32 + f[36:] for f in frames[1::7]]
    frames[2] = bytes.fromhex("FFFDEC00")  # a reserved rate of Layer II
    batch = pa.record_batch([pa.array(["a"] * 700), pa.array(range(700), pa.int64()), pa.array(frames, pa.binary())], names=["stream_id", "frame_no", "bytes"])
    start = time.process_time()
    read = list(layer12._rows(False)(iter([batch])))
    took = time.process_time() - start
    errors, got = {}, {}
    for x in (x for b in read for x in b.to_pylist()):
        if x["error"]:
            assert errors.setdefault(x["frame_no"], x["error"]) is x["error"] and x["s"] is None
        else:
            got[x["frame_no"], x["slot"], x["channel"]] = x["s"]
    assert errors == {k: "ran past the end" for k in range(0, 700, 7)} | {k: "forbidden allocation" for k in range(1, 700, 7)} | {2: "tuple index out of range"}
    whole = [k for k in range(700) if k not in errors]
    assert len(got) == sum(made[k % 16][1][:, :, 0].size for k in whole)
    for k in whole:
        want = made[k % 16][1]
        np.testing.assert_allclose([[got[k, slot, c] for c in range(want.shape[1])] for slot in range(12)], want, atol=1e-6)
    assert took < 700 * 0.0003  # frame by frame it took 0.001 s each and more


def test_reconstruction_and_halo(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=32 * 80)
    d = filterbank.designed_prototype()
    blocks = spark.createDataFrame([("a", k, b.tolist()) for k, b in enumerate(x.reshape(-1, 32))], "stream string, n int, v array<double>")
    bands = filterbank.analyse(blocks, ["stream"], "n", "v", d)
    pcm = np.concatenate([row.v for row in filterbank.synthesise(bands, ["stream"], "n", "v", d).orderBy("n").collect()])
    error = pcm[481 + 600 :] - x[600 : len(x) - 481]
    assert 10 * np.log10((x**2).mean() / (error**2).mean()) > 50
    assert np.allclose(d[1:256], -d[:256:-1] * np.where(np.arange(1, 256) % 64, 1, -1))
