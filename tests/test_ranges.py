"""Frames of byte ranges against the reader of whole streams: any size of range, on tags, noise, false headers, free format and cut ends."""

import random

import pyarrow as pa
import pytest

from tonewright.sources import framing, ranges
from tonewright.sources.framing import Framer

from .test_framing import stream


def cases():
    r = random.Random(7)
    tag = lambda n, fill: b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + fill * n
    damaged = bytearray(stream(60, seed=3))
    for _ in range(80):
        damaged[r.randrange(len(damaged))] = r.randrange(256)
    body = stream(12, seed=4)
    false = bytearray(stream(30, seed=5))
    for k in range(40, len(false) - 4, 300):  # headers of the same kind inside frames
        false[k : k + 4] = bytes.fromhex("FFFB9064")
    return {
        "plain": stream(80), "tag of sync bytes": tag(5000, b"\xff") + stream(30) + b"TAG" + bytes(125), "tag between": stream(9) + tag(3000, b"\xff\xfb\x90\x64"[:1]) + stream(9, seed=2),
        "noise": r.randbytes(4000) + stream(20) + bytes(9000) + stream(20, seed=2) + r.randbytes(3000), "all noise": r.randbytes(20000), "sync only": b"\xff" * 12000, "damaged": bytes(damaged), "false headers": bytes(false),
        "free": stream(40, bytes.fromhex("FFFB0064"), 480), "free, noise": b"x" * 2500 + stream(25, bytes.fromhex("FFFB0064"), 480) + b"\xff\xfb" * 700, "cut": stream(50)[:-100], "cut free": stream(11, bytes.fromhex("FFFB0064"), 480)[:-100],
        "two kinds": body + stream(20, bytes.fromhex("FFF384C0"), 192) + body, "empty": b"", "endless tag": stream(5) + tag(90000, b"z")[:4000], "letters": b"I" * 700 + b"ID" * 300 + stream(7) + b"ID3"[:2],
        "one frame": stream(1), "none": b"plain text, nothing else. " * 300,
    }


def test_framer_takes_any_chunking():
    for name, data in cases().items():
        want = Framer().feed(data, last=True)
        for size in (1, 7, 417, 5000):
            f, got = Framer(), []
            for k in range(0, len(data), size):
                got += f.feed(data[k : k + size])
            assert got + f.feed(b"", last=True) == want, (name, size)


def in_rounds(data, step):
    """The steps of ``frames_of_ranges`` without Spark: frames of each stream, and how many rounds it took."""
    rows = {(k, no): (k, no, at, min(step, len(v) - at), len(v), v[at : at + step + ranges.LOOK_AHEAD]) for k, v in data.items() for no, at in enumerate(range(0, max(len(v), 1), step))}
    integers, names = [pa.int64()] * 9, list("abcdefghi")
    walk_schema = pa.schema([(n, pa.string() if n == "stream_id" else pa.list_(pa.int64()) if n == "seen" else pa.int64()) for n in (c.split()[0] for c in ranges._WALK.split(", "))])

    def walks(asked):
        table = [(*rows[k], *s) for k, s in asked]
        kinds = [pa.string(), *integers[:4], pa.binary(), *integers[:3]]
        return [r for b in ranges._walks(iter([pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*table), kinds)], names=names)])) for r in b.to_pylist()]

    found, rounds = walks([(k, (r[2], None, None)) for k, r in rows.items()]), 0
    while True:
        found.sort(key=lambda r: (r["stream_id"], r["range_no"]))
        plan = [r for b in ranges._resolve(iter([pa.RecordBatch.from_pylist(found, schema=walk_schema)])) for r in b.to_pylist()]
        wanted = [((r["stream_id"], r["range_no"]), (r["entry"], r["lock"], r["free"])) for r in plan if r["wanted"]]
        if not wanted:
            break
        found, rounds = found + walks(wanted), rounds + 1
    out = {k: [] for k in data}
    for p in plan:
        r = rows[p["stream_id"], p["range_no"]]
        if p["entry"] < r[2] + r[3]:
            out[r[0]] += [(p["first_no"] + k, *f) for k, f in enumerate(ranges.walk(r[5], *r[2:5], p["entry"], p["lock"], p["free"])[0])]
    return out, rounds


@pytest.mark.parametrize("step", [97, 417, 1000, 4096, 1 << 20])
def test_any_size_of_range(step):
    data = cases()
    got, rounds = in_rounds(data, step)
    assert got == {k: [(n, *f) for n, f in enumerate(Framer().feed(v, last=True))] for k, v in data.items()}
    assert rounds < 40 and (rounds == 0 or step < 1 << 20)


def test_ranges_equal_whole_streams(spark):
    data = cases()
    t = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()] + [("null", None)], "stream_id string, content binary")
    got = ranges.frames_of_ranges(ranges.cut(t, 2500)).collect()
    for name, content in data.items():
        mine = sorted((r for r in got if r.stream_id == name), key=lambda r: r.frame_no)
        assert [(r.frame_no, r.position, r.kind, bytes(r.bytes)) for r in mine] == [(k, *f) for k, f in enumerate(Framer().feed(content, last=True))], name
    assert not any(r.stream_id == "null" for r in got)


def test_source(spark, tmp_path):
    data = cases()
    for k, v in enumerate(data.values()):
        (tmp_path / f"{k:02d}.mp3").write_bytes(v)
    (tmp_path / "other.txt").write_bytes(b"x")
    got = ranges.read_frames(spark, str(tmp_path), 12000)
    assert spark.read.format("audio_ranges").option("rangeBytes", 12000).load(str(tmp_path)).rdd.getNumPartitions() > len(data) + 5
    rows = got.collect()
    for k, content in enumerate(data.values()):
        mine = sorted((r for r in rows if r.stream_id.endswith(f"{k:02d}.mp3")), key=lambda r: r.frame_no)
        assert [(r.position, r.kind, bytes(r.bytes)) for r in mine] == Framer().feed(content, last=True)
    whole = framing.frames(framing.read_audio(spark, str(tmp_path))).count()
    assert whole == len(rows)
