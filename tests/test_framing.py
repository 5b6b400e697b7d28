"""Framing: header vectors, tags, damage, free format, chunking, and the streaming form against the batch form."""

import random

from tonewright.sources import framing
from tonewright.sources.framing import Framer, read_head

HEAD = bytes.fromhex("FFFB9064")


def stream(n=20, head=HEAD, length=417, seed=1):
    r = random.Random(seed)
    return b"".join(head + bytes(r.randrange(250) for _ in range(length - 4)) for _ in range(n))


def test_header_vectors():
    for word, length in (("FFFB9064", 417), ("FFFBE400", 960), ("FFF384C0", 192), ("FFFFC400", 384), ("FFFDA200", 627)):
        assert read_head(bytes.fromhex(word), 0).length == length
    for word in ("FFFBF000", "FFF99000", "FFEB9000"):
        assert read_head(bytes.fromhex(word), 0) is None


def test_tags_are_skipped_and_counted():
    data = b"ID3\x03\0\0\0\0\x02\x01" + b"\xff" * 257 + stream() + b"TAG" + b"x" * 125
    f = Framer()
    found = f.feed(data, last=True)
    assert [p for p, _, _ in found] == [267 + 417 * k for k in range(20)]
    assert f.skipped == 10 + 257 + 128
    assert len(Framer(strict=True).feed(data, last=True)) == 20


def test_chunking_does_not_matter():
    data = b"noise" + stream(8) + b"\x00" * 50 + stream(3, seed=2)
    want = Framer().feed(data, last=True)
    assert len(want) == 11
    for size in (1, 3, 64, 1000):
        f, got = Framer(), []
        for k in range(0, len(data), size):
            got += f.feed(data[k : k + size])
        assert got + f.feed(b"", last=True) == want


def test_free_format_and_truncation():
    f = Framer()
    assert len(f.feed(stream(6, bytes.fromhex("FFFB0064"), 480), last=True)) == 6 and f.free == 480
    last = Framer().feed(stream(5)[:-100], last=True)[-1]
    assert last[1] == "truncated" and len(last[2]) == 417 and last[2].endswith(bytes(100))


def test_garbage_never_fails():
    r = random.Random(5)
    for n in (0, 1, 3, 4, 100, 4096, 20000):
        Framer().feed(r.randbytes(n), last=True)
        Framer().feed(b"\xff" * n, last=True)
    base = bytearray(stream(12))
    for _ in range(60):
        damaged = bytearray(base)
        for _ in range(20):
            damaged[r.randrange(len(damaged))] = r.randrange(256)
        Framer().feed(bytes(damaged[: r.randrange(1, len(damaged))]), last=True)


def test_batch_source(spark):
    rows = spark.createDataFrame([("a", bytearray(stream(4))), ("b", bytearray()), ("c", None)], "stream_id string, content binary")
    got = framing.frames(rows).collect()
    assert [(r.stream_id, r.frame_no, r.position, len(r.bytes)) for r in got] == [("a", k, 417 * k, 417) for k in range(4)]


def test_stream_facts(spark):
    rows = spark.createDataFrame([("a", bytearray(b"noise" + stream(4) + b"TAG" + bytes(125))), ("b", bytearray(stream(3)[:-100])), ("c", None)], "stream_id string, content binary")
    got = {r.stream_id: (r.frames, r.audio_bytes, r.skipped_bytes, r.truncated, r.free_length) for r in framing.stream_facts(rows).collect()}
    assert got == {"a": (4, 4 * 417, 133, False, None), "b": (3, 3 * 417, 0, True, None), "c": (0, 0, 0, False, None)}


def test_streaming_equals_batch(spark, tmp_path):
    data = b"ID3\x03\0\0\0\0\0\x0a" + b"y" * 10 + stream(9)
    parts = [data[k : k + 700] for k in range(0, len(data), 700)]
    schema = "stream_id string, chunk_no bigint, bytes binary, last boolean"
    rows = [("s", k, bytearray(p), k == len(parts) - 1) for k, p in enumerate(parts)]
    half = len(rows) // 2
    for n, some in enumerate((rows[half:], rows[:half])):  # late chunks first
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = framing.stream_frames(source).writeStream.format("memory").queryName("framed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.position, r.kind, bytes(r.bytes)) for r in spark.sql("SELECT * FROM framed ORDER BY frame_no").collect()]
    assert got == Framer().feed(data, last=True)
