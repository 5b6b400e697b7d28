"""The folds over bytes against plain loops: runs and chunks of every length, slices, and the memory they take."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tonewright.functions import checksums


def plain(data):
    arc, frame, fnv = 0, 0xFFFF, 14695981039346656037
    for b in data:
        arc, frame, fnv = arc ^ b, frame ^ b << 8, (fnv ^ b) * 1099511628211 % 2**64
        for _ in range(8):
            arc = arc >> 1 ^ (0xA001 if arc & 1 else 0)
            frame = (frame << 1 ^ (0x8005 if frame & 0x8000 else 0)) & 0xFFFF
    return arc, frame, str(fnv)


@pytest.fixture
def chunk(request, monkeypatch):
    monkeypatch.setattr(checksums, "CHUNK", request.param)
    checksums._powers.cache_clear()
    yield
    checksums._powers.cache_clear()


@pytest.mark.parametrize("chunk", [1, 5, 256, 1000, checksums.CHUNK], indirect=True)
def test_pieces_of_any_length(chunk):
    r = np.random.default_rng(0)
    values = [None if n < 0 else r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 3, -1, 1, 2, 255, 0, 256, 257, 512, 700, 1, -1, 1025, 0)]
    want = [(None,) * 3 if v is None else plain(v) for v in values]
    for data in (pa.array(values, pa.binary()), pa.array(values, pa.large_binary()), pa.array([b"before", *values, b"behind"], pa.binary()).slice(1, len(values))):
        assert list(zip(*(f.func(data).to_pylist() for f in (checksums._arc, checksums._frame, checksums._fnv)))) == want
    assert checksums._fnv.func(pa.array([b"", None, b""], pa.binary())).to_pylist() == [plain(b"")[2], None, plain(b"")[2]]
    assert checksums._fnv.func(pa.array([], pa.binary())).to_pylist() == []


def test_memory_is_that_of_a_chunk():
    """All bytes of a batch as numbers of eight bytes were over eight times its size; one value of sixteen megabytes took as many steps."""
    for data in (pa.array([b"x" * 4000] * 4000, pa.binary()), pa.array([b"x" * 16_000_000], pa.binary())):
        for f in (checksums._arc, checksums._fnv):
            f.func(data.slice(0, 1).cast(pa.binary()))  # tables
            tracemalloc.start()
            f.func(data)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 8_000_000
