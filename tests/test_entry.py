"""Every registered audio query against its SQL over the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from tonewright.plans import audio

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        at = f"{SF}/{t}"
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(audio.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = audio.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({audio.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_blocks_cover_whole_vectors(spark, tmp_path):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(3, 64)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: audio.queries()[name](spark, str(tmp_path)).collect()
    for name, n in (("imdct_long", 36), ("imdct_short", 12)):
        x = np.pad(vectors.astype(float), ((0, 0), (0, -64 % (n // 2)))).reshape(3, -1, n // 2)
        i, k = np.arange(n)[:, None], np.arange(n // 2)
        y = x @ np.cos(np.pi / (2 * n) * (2 * i + 1 + n // 2) * (2 * k + 1)).T * np.sin(np.pi / n * (np.arange(n) + 0.5))
        got = run(name)
        assert len(got) == y.size and all(abs(q.y - y[q.vec_id, q.block, q.i]) < 2e-6 for q in got)
    x = np.pad(vectors.astype(float), ((0, 0), (0, 8))).reshape(3, 2, 36)
    k, m = np.arange(36), np.arange(18)[:, None]
    y = (x * np.sin(np.pi / 36 * (k + 0.5))) @ np.cos(np.pi / 72 * (2 * k + 1 + 18) * (2 * m + 1)).T / 9
    got = run("mdct_long")
    assert len(got) == y.size and all(abs(q.x - y[q.vec_id, q.block, q.k]) < 2e-6 for q in got)
    got = run("short_reorder")
    assert len(got) == 3 * 576 and all({q.place for q in got if q.vec_id == v} == set(range(576)) for v in range(3))
    assert all(q.x == float(vectors[q.vec_id, q.coded % 64]) for q in got)


def test_checksums_over_whole_texts(spark, tmp_path):
    texts = [None, "", "a", "123456789", "Zażółć gęślą jaźń \x00 " * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {q.doc_id: q for q in audio.queries()["checksums_of_bytes"](spark, str(tmp_path)).collect()}
    hashed = {q.doc_id: q.fnv for q in audio.queries()["stream_hash"](spark, str(tmp_path)).collect()}
    assert (got[0].arc, got[0].frame, hashed[0]) == (None, None, None) and got[3].arc == 0xBB3D
    for k, t in enumerate(texts[1:], 1):
        arc, frame, fnv = 0, 0xFFFF, 14695981039346656037
        for b in t.encode():
            arc, frame, fnv = arc ^ b, frame ^ b << 8, (fnv ^ b) * 1099511628211 % 2**64
            for _ in range(8):
                arc = arc >> 1 ^ (0xA001 if arc & 1 else 0)
                frame = (frame << 1 ^ (0x8005 if frame & 0x8000 else 0)) & 0xFFFF
        assert (got[k].arc, got[k].frame, hashed[k]) == (arc, frame, str(fnv))
