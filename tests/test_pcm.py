"""WAV of every width, raw samples, an MP4 track, and files that are none."""

import struct

import numpy as np
import pytest

from tonewright.sources import pcm


def wav(kind, bits, x, rate=44100, extensible=False, extra=b""):
    if kind == 3:
        body = x.astype("<f4").tobytes()
    elif bits == 24:
        body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.round(x.ravel() * 2**23))
    else:
        body = np.round(x * 2.0 ** (bits - 1)).astype(f"<i{bits // 8}").tobytes()
    channels = x.shape[1]
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    form += struct.pack("<HHIH", 22, bits, 3, kind) + bytes(14) if extensible else b""
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@pytest.mark.parametrize("kind,bits,extensible", [(1, 16, False), (1, 24, False), (1, 32, True), (3, 32, False), (1, 16, True)])
def test_wav_widths(kind, bits, extensible):
    x = np.random.default_rng(bits).uniform(-0.9, 0.9, (100, 2))
    rate, got = pcm.wav_samples(wav(kind, bits, x, 48000, extensible, b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    assert rate == 48000 and np.abs(got - x).max() < 2.0 ** -(min(bits, 24) - 1)


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def test_files_to_slots(spark):
    x = np.random.default_rng(1).uniform(-0.9, 0.9, (70, 2))
    files = spark.createDataFrame([("a", bytearray(wav(1, 16, x))), ("b", bytearray(b"RIFFxxxxWAVE")), ("c", None)], "stream_id string, content binary")
    got = pcm.wav_slots(files).collect()
    a = sorted((r for r in got if r.stream_id == "a"), key=lambda r: (r.channel, r.slot))
    assert len(a) == 6 and all((r.rate, r.samples, r.error) == (44100, 70, None) for r in a)
    y = np.array([r.s for r in a]).reshape(2, 96)
    assert np.abs(y[:, :70].T - x).max() < 2**-14 and not y[:, 70:].any()
    assert {r.stream_id: r.error for r in got if r.error} == {"b": "no data chunk", "c": "no RIFF WAVE file"}
    raw = spark.createDataFrame([("r", bytearray(np.round(x * 32768).astype("<i2").tobytes() + b"\1"))], "stream_id string, content binary")
    assert np.abs(np.array([r.s for r in pcm.raw_slots(raw, 44100).orderBy("channel", "slot").collect()]).reshape(2, 96)[:, :70].T - x).max() < 2**-14


def test_mp4_track(spark):
    samples = [bytes([k]) * (5 + k) for k in range(5)]
    media = box(b"ftyp", b"isom") + box(b"mdat", b"".join(samples))
    first = len(box(b"ftyp", b"isom")) + 8
    offsets = [first, first + len(samples[0] + samples[1]), first + len(b"".join(samples[:4]))]
    table = box(b"stsz", struct.pack(">III", 0, 0, 5) + b"".join(struct.pack(">I", len(s)) for s in samples)) + box(b"stco", struct.pack(">II3I", 0, 3, *offsets)) + box(b"stsc", struct.pack(">II6I", 0, 2, 1, 2, 1, 3, 1, 1))
    moov = box(b"moov", box(b"mvhd", bytes(20)) + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", table)))))
    files = spark.createDataFrame([("m", bytearray(media + moov)), ("n", bytearray(media))], "stream_id string, content binary")
    got = {r.stream_id: r.content for r in pcm.mp4_streams(files).collect()}
    assert bytes(got["m"]) == b"".join(samples) and got["n"] is None
