"""The streaming encoder against the batch one, byte for byte, for any chunking; its state in Spark; the timeout."""

import time

import numpy as np
import pytest

from tonewright.operators import codec, filterbank
from tonewright.operators.codec import Settings
from tonewright.operators.quantiser import Books
from tonewright.streaming.encode import StreamEncoder, stream_encode

from .test_layer3 import codes

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CASES = {"constant": (44100, 128, None, 2), "mono": (22050, 64, None, 1), "variable": (48000, None, 3, 2)}


def programme(rate, n, channels, seed):
    """Notes, noise and clicks."""
    r = np.random.default_rng(seed)
    t = np.arange(n) / rate
    x = 0.3 * np.sin(2 * np.pi * 330 * t) + 0.1 * np.sin(2 * np.pi * 990 * t) + 0.01 * r.normal(size=n)
    x[n // 2 : n // 2 + 200] += r.normal(0, 0.5, 200)
    return np.stack([x, 0.7 * x + 0.02 * r.normal(size=n)][:channels], axis=1)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Code tables; and of each case its settings, samples and the batch encoder's frames."""
    book, d, out = codes(tmp_path_factory.mktemp("codes")), filterbank.designed_prototype(), {}
    for name, (rate, kbps, quality, channels) in CASES.items():
        x = programme(rate, 576 * 9, channels, len(name))
        rows = [(name, c, k, b.tolist()) for c in range(channels) for k, b in enumerate(x[:, c].reshape(-1, 32))]
        blocks = spark.createDataFrame(rows, "stream_id string, channel int, slot bigint, s array<double>")
        frames = codec.encode_pcm(blocks, book, d, rate, kbps, quality=quality, channels=channels).orderBy("frame_no").collect()
        out[name] = Settings(d, rate, kbps, quality=quality, channels=channels), x, [bytes(f.bytes) for f in frames]
    return book, out


@pytest.mark.parametrize("name", sorted(CASES))
def test_chunking_does_not_matter(made, name):
    book, cases = made
    use, x, want = cases[name]
    books, r = Books(book), np.random.default_rng(1)
    for sizes in ([len(x)], [1] * 700 + [len(x)], r.integers(1, 900, 40).tolist() + [len(x)]):
        encoder, got, at, early = StreamEncoder(use, books), [], 0, 0
        for n in sizes:
            got += encoder.feed(x[at : at + n].reshape(-1))
            at += n
            fresh = StreamEncoder(use, books)
            fresh.restore(*encoder.state())  # what is kept says all
            encoder = fresh
        early = len(got)
        got += encoder.flush()
        assert got == want and early > 0


def test_odd_ends(made):
    """Samples that fill no block of 32, none at all, and half a sample."""
    book, cases = made
    use, x, _ = cases["constant"]
    for n in (0, 1, 700, 1152):
        encoder = StreamEncoder(use, Books(book))
        got = encoder.feed(x[:n].reshape(-1)) + encoder.flush()
        assert len(got) == -(-(n + 1057) // 1152)
    with pytest.raises(ValueError):
        StreamEncoder(use, Books(book)).feed(x[0, :1])


def test_streaming_query(spark, made, tmp_path):
    """Chunks out of order over several batches, and two streams that never send their end: the timeout plays it."""
    book, cases = made
    use, x, want = cases["constant"]
    cuts, rows = list(range(0, len(x), 1500)), []
    for name, ends in (("a", True), ("b", False), ("c", False)):
        rows += [(name, k, x[at : at + 1500].reshape(-1).tolist(), ends and k == len(cuts) - 1) for k, at in enumerate(cuts)]
    schema = "stream_id string, chunk_no bigint, pcm array<double>, last boolean"
    for part in (rows[1::2], rows[0::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_encode(chunks, book, use, timeout_ms=6000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        state = None
        for _ in range(120):
            time.sleep(0.5)
            assert q.exception() is None
            got = spark.read.schema("stream_id string, frame_no bigint, bytes binary").parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
            if len(got) == 3 * len(want):
                break
        q.stop()
        state = spark.read.format("statestore").option("stateVarName", "head").load(str(tmp_path / "state"))
        assert state.count() == 0 and "value" in state.columns
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", known)
    for name in "abc":
        mine = sorted((f for f in got if f.stream_id == name), key=lambda f: f.frame_no)
        assert [f.frame_no for f in mine] == list(range(len(want))) and [bytes(f.bytes) for f in mine] == want
