"""The streaming decoder against the batch one, for any chunking, with noise and damage in the stream."""

import time

import numpy as np
import pytest

from tonewright.operators import codec, encoder, filterbank
from tonewright.operators.analysis import band_allowance
from tonewright.streaming.decode import SCHEMA, StreamDecoder, stream_decode

from .test_layer12 import layer1_frame
from .test_layer3 import codes


@pytest.fixture(scope="module")
def streams(spark, tmp_path_factory):
    """Code tables, and bytes of three streams: Layer III with noise before and a damaged frame, Layer I with a refused frame, and nothing."""
    r, book = np.random.default_rng(5), codes(tmp_path_factory.mktemp("codes"))
    rows = []
    for g, t in enumerate([0, 0, 1, 2, 3, 0, 0, 0]):
        for c in range(2):
            x = r.normal(size=576) * np.exp(-np.arange(576) / 60) * 0.2
            rows.append(("s", g, c, t, x.tolist(), band_allowance(44100, t, np.full(576, 0.003), 1.0).tolist()))
    t = spark.createDataFrame(rows, "stream_id string, granule bigint, channel int, block_type int, x array<double>, allowed array<double>")
    frames = [bytearray(f.bytes) for f in encoder.encode(t, book, 44100, 160).orderBy("frame_no").collect()]
    frames[2][4:12] = b"\xff" * 8
    one = [bytearray(layer1_frame(np.random.default_rng(k), 3)[0]) for k in range(4)]
    one[1][4:20] = b"\xff" * 16
    return book, {"three": b"noise" + b"".join(frames), "one": b"".join(one), "none": b"nothing here"}


def test_chunking_does_not_matter(spark, streams):
    book, data = streams
    d, r = filterbank.designed_prototype(), np.random.default_rng(6)
    t = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "stream_id string, content binary")
    batch = codec.decode_streams(t, book, d, trim=False).collect()
    for name, content in data.items():
        want = {(x.channel, x.slot): np.array(x.s, np.float32) for x in batch if x.stream_id == name}
        for sizes in ([len(content)], [1] * len(content), r.integers(1, 700, 200).tolist()):
            decoder, got, at = StreamDecoder(), {}, 0
            for n in sizes:
                for c, slot, s, _ in decoder.feed(content[at : at + n], book, d):
                    got[c, slot] = s
                at += n
                if at % 7 == 0:
                    fresh = StreamDecoder()
                    fresh.restore(*decoder.state_of())  # what is kept says all
                    decoder = fresh
            for c, slot, s, _ in decoder.feed(content[at:], book, d, last=True):
                got[c, slot] = s
            assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
        assert decoder.skipped == {"three": 5, "one": 0, "none": len(content)}[name]
    assert len({x.stream_id for x in batch}) == 2


def test_streaming_query(spark, streams, tmp_path):
    """Chunks out of order over two batches; a stream that never sends its end is ended by the timeout."""
    book, data = streams
    rows, data = [], data | {"open": data["three"][:-50]}
    for name, content in data.items():
        cuts = list(range(0, len(content), 300))
        rows += [(name, k, bytearray(content[a : a + 300]), k == len(cuts) - 1 and name != "open") for k, a in enumerate(cuts)]
    schema = "stream_id string, chunk_no bigint, bytes binary, last boolean"
    for part in range(2):
        spark.createDataFrame(rows[1 - part :: 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    d = filterbank.designed_prototype()
    t = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "stream_id string, content binary")
    want = {(x.stream_id, x.channel, x.slot): x.s for x in codec.decode_streams(t, book, d, trim=False).collect()}
    known = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream_decode(chunks, book, d, timeout_ms=6000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        got = {}
        for _ in range(120):
            time.sleep(0.5)
            assert q.exception() is None
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = {(x.stream_id, x.channel, x.slot): x for x in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect()}
            if len(got) == len(want):
                break
        q.stop()
        assert spark.read.format("statestore").option("stateVarName", "head").load(str(tmp_path / "state")).count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", known)
    assert set(got) == set(want) and all(np.allclose(got[k].s, want[k], atol=1e-6) and (got[k].keep_from, got[k].keep_to) == (0, 32) for k in want)


def test_reset_forgets(streams):
    book, data = streams
    d = filterbank.designed_prototype()
    a = StreamDecoder()
    first = a.feed(data["one"], book, d)
    a.reset()
    a.slots = 0
    assert all((x[2] == y[2]).all() for x, y in zip(a.feed(data["one"], book, d), first))
