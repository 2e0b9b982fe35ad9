"""The pipeline's stages, each against brute force on what the one before kept."""

import os

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_operators import _fingerprint, _roots  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    from tokenizers import Tokenizer

    import public_tokenizers
    from skyledger.llm._shared import written

    given = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [given]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "test-stage"))
    assert all(k.columns == given.columns for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:-1]]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    gone = rows[0].keys() - rows[1].keys()
    assert len(gone & clean) <= 0.05 * len(clean) and len(gone & toxic) >= 0.3 * len(toxic & rows[0].keys())  # a dozen toxic rows to learn from
    largest = {}
    for i, t in rows[1].items():
        largest[t] = max(i, largest.get(t, -1))
    assert set(rows[2]) == set(largest.values()) and all(rows[2][i] == rows[1][i] for i in rows[2])
    fps = {i: _fingerprint(t) for i, t in rows[2].items()}
    ids = sorted(fps)
    roots = _roots(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert set(rows[3]) == set(roots.values())
    times = {}
    for r in kept[4].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= set(rows[3]) and max(times.values()) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = kept[5].collect()
    assert len(last) == sum(times.values())
    assert all(r.n_tokens == len(library.encode(rows[3][r.doc_id], add_special_tokens=False).ids) for r in last)


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
