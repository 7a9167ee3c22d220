"""The latent space of the decontamination is fitted on every document, however many there are."""

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import decontaminate


def brute_space(docs, index, background=4000, emphasis=10.0, rank=128):
    """Weighted term vectors by dense algebra over all documents' and the block's own passages."""
    at, idf, size = {t: i for i, t in enumerate(index.terms)}, index.idf, len(index.terms)
    rows = []
    share = min(1.0, background / len(docs))
    cut = [decontaminate.tokens_of(t or "") for t in docs]
    passages = [(w[k:k + 64], share) for w in cut for k in range(0, len(w), 64)]
    for words, weight in [*passages, *((p, emphasis ** 2) for p in index.passages.tokens)]:
        row = np.zeros(size)
        for w in words:
            if w in at:
                row[at[w]] += idf[at[w]]
        if np.count_nonzero(row) > 1:
            rows.append(row * np.sqrt(weight) / np.linalg.norm(row))
    gram = np.array(rows).T @ np.array(rows)
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(size, min(size, rank + 8))))[0]
    for _ in range(2):
        q = np.linalg.qr(gram @ q)[0]
    values, vectors = np.linalg.eigh(q.T @ gram @ q)
    space = idf[:, None] * (q @ vectors[:, np.argsort(values)[::-1][:rank]])
    return space @ space.T


@pytest.fixture(scope="module")
def corpus():
    """5,000 documents, more than weigh fully; one in ten of more than one passage, some null, empty or repeated."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    share = 1.0 / np.arange(1, 301)
    draw = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [draw(int(rng.integers(60, 200) if i % 10 == 0 else rng.integers(3, 12))) for i in range(4990)]
    items = [(i, draw(int(rng.integers(5, 30)))) for i in range(12)]
    return [(i, t) for i, t in enumerate([*docs, *docs[:6], None, None, "", items[0][1]])], items


def test_every_document_is_fitted(spark, corpus):
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    (index,) = decontaminate.build_indexes(df, spark.createDataFrame(items, "item_id long, text string"), rank=6)
    want = brute_space([t for _, t in docs], index, rank=6)
    assert np.allclose(index.vectors @ index.vectors.T, want, atol=1e-4 * np.abs(want).max())


def test_every_block_is_fitted(spark, corpus):
    """Blocks of one tokenising pass: each has its own terms, frequencies and space."""
    docs, items = corpus
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.build_indexes(df, spark.createDataFrame(items, "item_id long, text string"), rank=4, block_items=5)
    assert len(found) > 1
    texts = [set(decontaminate.tokens_of(t or "")) for _, t in docs]
    for index in found:
        df = np.array([sum(t in words for words in texts) for t in index.terms])
        at = {t: i for i, t in enumerate(index.terms)}
        weighty = index.idf > 0
        assert np.allclose(index.idf[weighty], np.maximum(np.log((1 + len(docs)) / (1 + df[weighty])), 0.05))
        assert set(at) == {w for p in index.passages.tokens for w in p}
        want = brute_space([t for _, t in docs], index, rank=4)
        assert np.allclose(index.vectors @ index.vectors.T, want, atol=1e-4 * np.abs(want).max())


def test_the_pipeline_stage_fits_every_document(spark, corpus, scratch, monkeypatch):
    """More terms than the rank, so the space is a choice; the documents with a passage go, null and empty ones stay."""
    docs, _ = corpus
    items = [(i, t) for i, t in docs if len((t or "").split()) >= 150][:20]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    made, build = [], decontaminate.build_indexes
    monkeypatch.setattr(decontaminate, "build_indexes", lambda *a, **k: made.extend(build(*a, **k)) or made)
    kept = {r.doc_id for r in corpus_pipeline.benchmark_decontamination(
        spark, spark.createDataFrame(docs, "doc_id long, text string"), scratch).collect()}
    (index,) = made
    assert len(index.terms) > 136
    want = brute_space([t for _, t in docs], index)
    assert np.allclose(index.vectors @ index.vectors.T, want, atol=1e-4 * np.abs(want).max())
    assert not kept & {i for i, _ in items} and {i for i, t in docs if not t} <= kept
