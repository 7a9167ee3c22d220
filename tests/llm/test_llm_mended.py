"""Cases that earlier forms of the operators lost: tiny corpora, short items, short secrets, deep pages, texts without spaces."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import decontaminate, html_extract, lm_score, secret_scan


def training_ids(n):
    return [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:n]


@pytest.mark.parametrize("texts", [["a b c", "d e f", "g h i"], ["a"], [""], ["a a a"], ["a b", "a b", "a b"]])
def test_scores_are_finite_on_tiny_corpora(spark, texts):
    """No word seen twice, none seen once, one word, no word: every score is a log
    probability, and what a text's words and the unknown word may weigh sums to one."""
    ids = training_ids(len(texts))
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2)
    probes = ["a", "zz", "a b", "q r s"]
    rows = list(zip(ids, texts)) + [(held, p) for p in probes]
    got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)


def test_hot_contexts_are_split_by_their_share(spark):
    """A word that starts half of all pairs is dealt over buckets in proportion; the scores stay those of one bucket."""
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"the w{rng.integers(0, 400)}" for _ in range(60))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    many = {r.doc_id: r.score for r in lm_score.score_documents(df, block_bytes=2_000, bucket_bytes=500).collect()}
    few = {r.doc_id: r.score for r in lm_score.score_documents(df).collect()}
    assert many.keys() == few.keys() and all(many[k] == pytest.approx(few[k], abs=1e-9) for k in few)


@pytest.mark.parametrize("shortest, longest", [(2, 8), (6, 12), (15, 60)])
def test_items_of_every_length_are_found(spark, shortest, longest):
    """A full block of 500 items, each planted word for word in a document of its own: recall 0.9 or more by brute force."""
    rng = np.random.default_rng(longest)
    words = [f"w{k}" for k in range(3000)]
    share = 1.0 / np.arange(1, len(words) + 1)
    draw = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    items = [(i, draw(int(rng.integers(shortest, longest + 1)))) for i in range(500)]
    docs = [(i, f"{draw(int(rng.integers(20, 120)))} {text} {draw(90)}") for i, text in items]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"),
                                        spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    df = Counter(w for _, t in docs for w in set(t.split()))
    told = [i for i, t in items if len(t.split()) >= 5 or any(df[w] <= 0.05 * len(docs) for w in t.split())]
    assert sum((i, i) in got for i in told) >= 0.9 * len(told)
    texts = {i: f" {t} " for i, t in docs}
    asked = dict(items)
    assert all(f" {asked[i]} " in texts[d] for d, i in got if len(asked[i].split()) < 5)


def test_short_items_alone_and_common_ones(spark):
    """Items of two to four tokens are found as they stand, inside one text only; a single word or common words tell nothing."""
    docs = [(1, "we met the Purple, Walrus again"), (2, "purple and walrus"), (3, "so purple"), (4, "walrus of the"), (5, ""), (6, None)]
    docs += [(100 + i, f"one of the many {i}") for i in range(60)]
    items = [(1, "purple walrus"), (2, "of the"), (3, "purple"), (4, ""), (5, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contamination(df, bench).collect()] == [(1, 1)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {d for d, _ in docs} - {1}


def test_secrets_by_their_place(spark):
    """Short values, values without digits and URL user parts are confirmed; descriptions, templates and prose are left alone."""
    secret = {"password = correcthorsebatterystaplexy": "correcthorsebatterystaplexy", "db_password: Tr0ub4dor&3": "Tr0ub4dor&3",
              "SECRET=Zq8!mK2#pL9": "Zq8!mK2#pL9", "token: qwhgjzkmnpvbxrtyclsdfqwmzkhgpbvn": "qwhgjzkmnpvbxrtyclsdfqwmzkhgpbvn",
              "connect postgres://admin:s3cr3tP4ss@db.internal/x": "s3cr3tP4ss", '{"user":"x1","password":"hV7$kq!2z","n":3}': "hV7$kq!2z"}
    clean = ["the password: required for all users", "a token = optional in this call", "password: <password>", "password=changeme", "",
             "The secret: always listen to people", "see the token: https://example.com/docs/auth/index.html for more", "the author: Katherine wrote", None]
    rows = list(enumerate([*secret, *clean]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.core) for r in secret_scan.scan(docs).where("is_secret").collect()}
    assert got == set(enumerate(secret.values()))
    texts = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert all(texts[i] == t.replace(secret[t], "<SECRET>") for i, t in enumerate(secret))
    assert all(texts[len(secret) + i] == t for i, t in enumerate(clean))


def test_very_deep_pages_keep_all_text():
    for depth in (50, 260, 20_000):
        page = f"<article><h1>Top</h1>{'<div>' * depth}inside<nav>menu</nav><p>one</p><p>two</p>{'</div>' * depth}<p>after</p></article><p>out</p>"
        assert html_extract.main_text(page, None) == "Top\ninside\none\ntwo\nafter"
        assert html_extract.main_text(page + "</b>" * depth, html_extract.induce([page] * 3)) == "Top\ninside\none\ntwo\nafter"


def test_wrapper_alone_finds_the_article_among_neutral_tags(spark):
    """Nothing but div elements under class names without meaning: what the pages of a host share is template, the rest the text."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for host in range(3):
        a, b, c, d = (f"x{rng.integers(1000, 9999)}q" for _ in range(4))
        for i in range(8):
            body = [" ".join(f"h{host}p{i}k{k}w{rng.integers(0, 99)}" for k in range(12)) for _ in range(rng.integers(1, 7))]
            page = (f"<div class={a}><div>Home</div><div>All sections</div></div><div class={b}><div>{body[0]}</div>"
                    + "".join(f"<div class={c}>{x}</div>" for x in body[1:]) + f"<div>Read more on this site</div></div><div class={d}>Imprint of host {host}</div>")
            rows.append((host * 10 + i, f"http://h{host}.example/{i}", f"<html><body>{page}</body></html>"))
            want[host * 10 + i] = "\n".join(body)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


def test_counts_survive_packing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 4, 5, 999):
        values = np.minimum(rng.zipf(1.3, n), 10**12) - rng.integers(0, 2, n)
        assert np.array_equal(lm_score.unpack(lm_score.pack(values)), values)
    edges = np.array([0, 1, 2, 3, 257, 258, 259, 1 << 40])
    assert np.array_equal(lm_score.unpack(lm_score.pack(edges)), edges)
