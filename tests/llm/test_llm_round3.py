"""Language identification, token alignment and the filter audit against brute
force and held-out languages; survivors of ids that repeat."""

import collections
import hashlib
import itertools
import json
import re
import unicodedata
import zlib

import numpy as np
import pytest

from ledgerlens.llm import filter_audit, language_id, simhash_dedup, token_align
from ledgerlens.llm.common import read
from test_llm_edges import DOCS, TEXTS

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 2 else "en", None if i in (3, None) else f"s{(i or 0) % 2}", None, *[None] * 12) for i, t in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


# ---- language identification -------------------------------------------------

def test_languages_of_the_held_out_fold(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(found) == len(rows)
    held = [r for r in rows if fold(r.doc_id, 4) == 2]
    assert all(found[r.doc_id].held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in found.values())


def test_held_out_languages_are_not_read(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    turned = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 'xx' ELSE lang END AS lang")
    one, two = (sorted(map(tuple, language_id.identify(d).collect())) for d in (docs, turned))
    assert one == two


def brute_grams(text):
    kinds = {c: unicodedata.category(c)[0] for c in text.lower()}
    if "L" not in kinds.values():
        return collections.Counter()
    words = "".join(c if kinds[c] in "LM" else " " for c in text.lower()).split(" ")
    padded = [f" {w} " for w in words if w]
    return collections.Counter(w[i:i + n] for w in padded for n in (1, 2, 3) for i in range(len(w) - n + 1)
                               if w[i:i + n].strip() and (n < 3 or w[i + 1] != " "))


def code(gram):
    out = 0
    for c in gram:
        out = (out << 21) | ord(c)
    return out


@pytest.mark.parametrize("text", ["Ein Wort, zwei Wörter!", "a", " ́a", "x1y É ſ漢字\U0001F600z", "aa aa aa b", "e" * 300, "", "12 34 !"])
def test_grams_and_ranks_against_brute_force(text):
    grams = language_id.grams_of(language_id.words_of(text, language_id.letter_table()))
    want = brute_grams(text)
    expected = collections.Counter()
    for gram, n in want.items():                       # a space between two words is in the pieces of both
        expected[code(gram)] += n
    got = collections.Counter(grams.tolist())
    assert got == expected
    if got:
        codes, place = language_id.ranked(grams, 3)
        ordered = sorted(got.values(), reverse=True)
        least = ordered[min(2, len(ordered) - 1)]
        assert set(codes.tolist()) == {g for g, n in got.items() if n >= least}
        for g, p in zip(codes.tolist(), place):
            same = [i for i, n in enumerate(ordered) if n == got[g]]
            assert p == np.mean(same)


def test_profiles_and_distance(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("der die das und", "de"), ("the of and to", "en"), ("the and", "en"), ("77", "zz"), (None, "en")]) if fold(i, 4) != 2],
        "doc_id long, text string, lang string")
    learned = language_id.learn(docs, 4, 2, 30, 1000)
    table = language_id.letter_table()
    texts = collections.defaultdict(collections.Counter)
    for r in docs.collect():
        texts[r.lang].update(brute_grams(r.text or ""))
    ranks = {lang: {code(g): i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:30])} for lang, c in texts.items() if c}
    assert learned.names == sorted(ranks)
    for text in ("the undoing", "q", "das"):
        grams = language_id.grams_of(language_id.words_of(text, table))
        codes, place = language_id.ranked(grams, 30)
        for lang, apart in zip(learned.names, learned.distances(grams)):
            steps = [min(abs(ranks[lang][g] - p), 30) if g in ranks[lang] else 30 for g, p in zip(codes.tolist(), place)]
            assert apart == pytest.approx(np.mean(steps) / 30)


def test_language_edges(spark, odd):
    rows = language_id.identify(odd).collect()
    assert len(rows) == len(TEXTS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (2, 3, 4))
    assert {r.lang_pred for r in rows} == {"und", "en"} and not any(r.held_out for r in rows if r.doc_id is None)
    assert len({(r.score, r.lang_pred) for r in rows if r.doc_id in (6, 7)}) == 1
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.drop("lang").selectExpr("*", "cast(null AS string) AS lang")).collect()} == {"und"}


# ---- token alignment ---------------------------------------------------------

def brute_alignment(texts):
    """Groups by walking both encodings; the digests and links from them."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side, alphabet = SentencePieceProcessor(model_file=PIECES), token_align.byte_alphabet()
    groups, sizes = {}, {}
    for i, text in texts.items():
        groups[i], sizes[i] = [], (0, 0)
        if not text:
            continue
        a = [(k, bytes(alphabet[c] for c in a_side.id_to_token(k))) for k in a_side.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in b_side.encode(text):
            piece = b_side.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
        if not b"".join(p for _, p in a) == b"".join(p for _, p in b) == (" " + text).encode():
            continue
        sizes[i] = len(a), len(b)
        own_a, own_b, end_a, end_b = [], [], 0, 0
        a, b = collections.deque(a), collections.deque(b)
        while a or b:
            if end_a <= end_b:
                k, p = a.popleft()
                own_a.append(k)
                end_a += len(p)
            else:
                k, p = b.popleft()
                own_b.append(k)
                end_b += len(p)
            if end_a == end_b:
                groups[i].append((own_a, own_b))
                own_a, own_b = [], []
    links = {i: [pair for x, y in own for pair in itertools.product(x, y)] for i, own in groups.items()}
    count = collections.Counter(pair for own in links.values() for pair in set(own))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return {i: (*sizes[i], len(groups[i]), len(links[i]), sum(count[x] == best[x[0]] for x in links[i]), sum(count[x] for x in links[i]),
                hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups[i]).encode()).hexdigest()
                if groups[i] else "") for i in texts}


HARD = ["plain words here", "plain words here", "", None, "<|endoftext|> is text", "</s><s>", "▁ a mark", "tab\tand\n\n  blanks   ",
        "漢字かな交じり文", "\U0001F600\U0001F468‍\U0001F469", "ééé é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "=" * 2000, "x\x00y",
        " leading", "trailing ", "1234567890 3.14", "don't we'll", "\r\n", "  ", "of of of of the the"]


@pytest.mark.parametrize("broadcast_rows", [1 << 20, 0])
def test_alignment_against_brute_force(spark, sf_dir, broadcast_rows):
    texts = {i: t for i, t in enumerate(HARD)}
    texts.update({1000 + r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()})
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in token_align.align(docs, broadcast_rows=broadcast_rows).collect()}
    want = brute_alignment(texts)
    assert got == want
    assert sum(row[0] == 0 for row in want.values()) < 10


def test_the_fast_encoder_equals_the_tokenizer(spark, sf_dir):
    raw = open(BYTE_LEVEL, "rb").read()
    assert token_align.ranked_by_id(json.loads(raw))
    changed = json.loads(raw)
    changed["model"]["merges"] = changed["model"]["merges"][::-1]
    assert not token_align.ranked_by_id(changed)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE_LEVEL)
    tokenizer.encode_special_tokens = True
    texts = [t for t in HARD if t] + [r.text or "" for r in read(spark, sf_dir, "documents").collect()]
    texts += ["".join(p) for p in itertools.product([" ", "a", "É", "1", "½", "'s", "\t", "\n", "　", "!", "́"], repeat=3)]
    fast = token_align.byte_level(raw).encode(texts)
    assert fast == [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_alignment_edges(odd):
    rows = token_align.align(odd).collect()
    assert len(rows) == len(TEXTS)
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows if r.doc_id in (2, 3))
    assert len({tuple(r)[1:] for r in rows if r.doc_id in (6, 7)}) == 1
    assert token_align.align(odd.limit(0)).count() == 0


# ---- filter audit ------------------------------------------------------------

def brute_audit(rows, labels):
    fails = []
    for i, text, part in rows:
        text, words = text or "", re.findall("[^\x20\x09-\x0D]+", text or "")
        bad = {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        bad |= {"D"} if re.search("[#$%&*|]", text) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (other or "") == text for j, other, _ in rows) else set()
        fails.append((part or "", bad, labels.get(i, (0, 0))))
    out, removed_by = {}, collections.Counter()
    for part in {p for p, _, _ in fails}:
        own = [(bad, label) for p, bad, label in fails if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                removed_by[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in bad for bad, _ in own) - len(gone),
                                                   sum(bad == {f} for bad, _ in own), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone)]
    return {key: (*counts, removed_by[key[0], key[1][key[2] - 1]]) for key, counts in out.items()}


def test_audit_against_brute_force(spark, odd):
    many = [(100 + i, t, f"s{i % 3}") for i, t in enumerate(
        ["one two three " * 80, "A B " * 150, " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}" for k in range(250)) + " #",
         "costs $5", " ".join(f"w{k}" for k in range(250)), "", None, "x" * 300])]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()] + many + [(102, many[2][1], None), (102, many[2][1], "s2"), (None, many[2][1], "s0")]
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(100, 106)] + [(None, 1, 1), (104, 0, 1), (3, None, None), (999, 1, 1)]
    known = collections.defaultdict(lambda: (0, 0))
    for i, good, toxic in labels:
        if i is not None:
            known[i] = max(known[i][0], good or 0), max(known[i][1], toxic or 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(rows, known)
    assert len(got) == len(want) == 600 * len({part or "" for _, _, part in rows})
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


def test_audit_edges(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = filter_audit.filter_audit(odd, labels).collect()
    assert {r.part for r in rows} == {"", "s0", "s1"} and len(rows) == 1800
    assert all(r.good_lost == r.toxic_lost == 0 for r in rows)
    assert filter_audit.filter_audit(odd.limit(0), labels).count() == 0


# ---- SimHash survivors -------------------------------------------------------

def test_ids_that_repeat_keep_every_group(spark):
    same, other = "one text that two rows share word for word", "an unrelated text under an id that is taken"
    rows = [(3, same, "a"), (5, same, "b"), (5, other, "c"), (5, other, "d"), (7, other, "e"), (8, "a third text of its own here", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _fp string")
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, same), (5, other), (8, rows[-1][1])])
