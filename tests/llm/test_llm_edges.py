"""Nulls in any column, empty and very long texts, ties and repeated rows, empty
tables, and extra columns whose names clash with the operators' own."""

import zlib

import pytest

from ledgerlens.llm import (decontaminate, html_extract, license_scan, lm_score, mixing, quality_qda, secret_scan,
                            simhash_dedup, syncmer, toxicity)

CLASH = "score double, label int, raw string, fp long, root string, bucket int, block int, _gone long, _own long, _cores string, features string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH
LONG = "wording " * 40_000 + "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" " + "x" * 100_000
TEXTS = [(1, "A plain line of words, no more. Released under the MIT License."), (2, None), (3, ""), (4, " \t\n "), (5, LONG),
         (None, None), (None, "a row without an id"), (6, "twice the same text here"), (6, "twice the same text here"),
         (7, "twice the same text here"), (8, "ÉÀ ß 漢字 \U0001F600 \x85\xa0 nul\x00 end")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 2 else "en", None if i in (3, None) else f"s{(i or 0) % 2}", None, *[None] * 12) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 9)] + [(1, None, None), (None, 1, 1), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (None, "some words that stand without an id"), (2, ""), (3, "short one"),
                                  (4, "twice the same text here"), (4, "twice the same text here")], "item_id long, text string")


def test_toxicity(docs, none, labels, no_labels):
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert all(r.score < 1e-6 for r in toxicity.toxicity_scores(docs, no_labels).collect())
    assert toxicity.toxicity_scores(none, no_labels).count() == 0


def test_quality(docs, none, labels, no_labels):
    rows = quality_qda.quality_scores(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1
    assert {r.score for r in quality_qda.quality_scores(docs, no_labels).collect()} == {0.5}
    assert quality_qda.quality_scores(none, labels).count() == 0
    kept = quality_qda.keep_good(docs, no_labels)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert quality_qda.keep_good(none, no_labels).count() == 0


def test_html(spark, none):
    rows = [(1, "http://a/x", None, 0), (2, None, "<p>one", 0), (3, "odd url", "", 0), (4, "http://a/y", "<div>" * 3000 + "deep", 0),
            (5, "http://a/z", "<article><p>a &amp; b<br>c</p><nav>no</nav><div class='user-comments'>no</div></article><p>out", 0),
            (5, "http://a/z", "<article><p>a &amp; b<br>c</p><nav>no</nav><div class='user-comments'>no</div></article><p>out", 0),
            (6, "http://a/c", "<article><p>body</article><article class='comment'><p>me too</article>", 0),
            (None, "http://a/", "<script>x</script><!-- y --><form>z</form>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert html_extract.extract(pages).count() == len(rows)
    assert got == {1: ("", 0), 2: ("one", 3), 3: ("", 0), 4: ("deep", 4), 5: ("a & b c", 7), 6: ("body", 4), None: ("", 0)}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs, budget_share=2.0).collect()
    assert rows and all(r.n_tokens >= 0 and 0 < r.weight <= 1 for r in rows)
    assert {r.source for r in rows} == {"s0", "s1", None}
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.where("text IS NULL")).count() == 0


def test_license(docs, none):
    assert [(r.doc_id, r.licenses) for r in license_scan.scan(docs).collect()] == [(1, "MIT")]
    assert license_scan.scan(none).count() == 0


def test_lm(docs, none):
    rows = lm_score.score_documents(docs).collect()
    assert len(rows) == len(TEXTS) and len({r.train_tokens for r in rows}) == 1
    assert all(r.n_tokens == 1 for r in rows if r.doc_id in (2, 3, 4))
    assert all(r.score <= 0 and r.base_score <= 0 for r in rows)
    assert lm_score.score_documents(none).count() == 0
    held = docs.where("doc_id = 1").limit(1)
    only = next(i for i in range(1, 100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = lm_score.score_documents(held.selectExpr(f"{only}L AS doc_id", "text")).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.n_known == 0 and alone.score == 0


def test_decontaminate(docs, none, bench):
    found = decontaminate.contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(6, 4), (6, 4), (7, 4)]
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 3
    assert decontaminate.drop_contaminated(none, bench).count() == 0


def test_syncmer(docs, none):
    rows = syncmer.edited_fingerprints(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert all(r.fingerprint == r.edited_fingerprint for r in rows if r.n_chars < 4)
    assert syncmer.edited_fingerprints(none).count() == 0
    assert syncmer.edited_fingerprints(docs.where("doc_id = 1")).first().near_next == 1
    assert syncmer.document_fingerprints(docs).count() == len(TEXTS)


def test_secrets(docs, none):
    assert {r.doc_id for r in secret_scan.scan(docs).where("is_secret").collect()} == {5}
    assert secret_scan.scan(none).count() == 0
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    assert [r.doc_id for r in clean.where("text LIKE '%<SECRET>%'").collect()] == [5]
    long = clean.where("doc_id = 5").first()
    assert "0641917ea4" not in long.text and long.n_chars == len(long.text)
    assert secret_scan.redact(none).count() == 0


def test_simhash(docs, none):
    rows = simhash_dedup.simhash_components(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert simhash_dedup.simhash_components(none).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5, 6, 8]
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash_dedup.keep_one(none).count() == 0
