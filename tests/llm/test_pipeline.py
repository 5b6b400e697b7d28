"""The pipeline's stages against brute force over the smallest documents."""

from collections import Counter

import corpus_pipeline
from tonewright.llm.common import materialize

from ..conftest import SF
from .test_operators import components, fingerprint, plain_spans


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "test")
        seen.append(docs.collect())
        if k < 4:
            assert docs.columns == columns
    language, near, spans, mixed, packed = seen
    want = components({r.doc_id: fingerprint(r.text) for r in language})
    assert sorted(r.doc_id for r in near) == sorted({w for w in want.values()})
    rows = sorted((r.doc_id, r.text) for r in near)
    kept = {i: left for (i, _), (left, gone) in zip(rows, plain_spans(rows)) if left.strip() or not gone}
    assert {r.doc_id: r.text for r in spans} == kept
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= set(kept) and max(times.values()) <= 2 and all(r.text == kept[r.doc_id] for r in mixed)
    size = sum(len(t.split()) for t in kept.values())
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * size) < 0.1 * size
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    whole = {r.doc_id: r.doc_tokens for r in packed}
    assert all(tokens[i] == n * whole[i] for i, n in times.items()) and set(tokens) == set(times)


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
