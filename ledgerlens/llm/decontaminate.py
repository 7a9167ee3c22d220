"""Benchmark decontamination by latent semantic retrieval.

1. One pass cuts all documents into passages and stores which of the benchmark's
   terms each holds; document frequencies over all documents give IDF.
2. A randomised SVD of TF-IDF passages (every benchmark passage and every passage
   of every document) gives a latent space: Spark sums A'(A Q) over the passages'
   partitions, the driver orthogonalises the terms-by-rank result.
3. Every document is cut into overlapping windows of twice a passage's length
   class; a window whose latent vector is close to a passage's is a candidate.
4. A candidate is confirmed by the longest common subsequence of the passage
   with the text around the window, and by the passage's answer (its last
   quarter), so paraphrases count and shared snippets do not.
5. Items of two to four tokens are too short for a direction of their own and
   are searched as they stand.

The benchmark is the query set: it is taken in blocks of ``block_items``, and
every document is searched for every block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Bytes other than letters, digits and non-ASCII become blanks.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Passages of up to so many tokens are searched with windows twice as long at this stride, so one window holds them whole.
CLASSES = (7, 14, 32)
WINDOW = 2 * CLASSES[-1]     # longer passages are cut to this; the last class takes them
SHORT = 5                    # items of fewer tokens are searched as they stand
CHUNK = 100_000      # tokens searched at a time (bounds memory)


def tokens_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(PLAIN).split()


@dataclass
class Passages:
    """A block of benchmark passages."""
    items: list[int]
    tokens: list[list[bytes]]
    short: list[tuple[int, list[bytes]]]     # items searched as they stand

    @property
    def terms(self) -> list[bytes]:
        return sorted({t for p in [*self.tokens, *(words for _, words in self.short)] for t in p})


def passages_of(rows: list, min_tokens: int) -> Passages:
    """Passages of (item_id, text) rows: items of up to ``WINDOW`` tokens whole, longer ones in equal parts."""
    items, out, short = [], [], []
    for item, text in rows:
        words = tokens_of(text or "")
        parts = -(-len(words) // WINDOW)
        if min_tokens <= len(words) < SHORT:
            short.append((item, words))
        elif len(words) >= max(min_tokens, SHORT):
            for i in range(parts):
                items.append(item)
                out.append(words[i * len(words) // parts:(i + 1) * len(words) // parts])
    return Passages(items, out, short)


def term_counts(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's term ids (-1: no term) in passages of ``WINDOW`` tokens: the distinct
    terms of each passage, how often each occurs there, and how many each passage has."""
    at = np.flatnonzero(ids >= 0)
    keys, counts = np.unique(at // WINDOW * size + ids[at], return_counts=True)
    return (keys % size).astype(np.int32), counts.astype(np.uint8), np.bincount(keys // size).astype(np.uint8)


def passage_terms(texts: DataFrame, terms: list[bytes]) -> DataFrame:
    """:func:`term_counts` of every text, one row each, stored."""
    known = {t: i for i, t in enumerate(terms)}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, size = known.get, len(known)
        for batch in batches:
            out = [term_counts(np.array([get(t, -1) for t in tokens_of(text)], np.int64), size) for text in batch["text"]]
            yield pd.DataFrame([[part.tobytes() for part in parts] for parts in out], columns=["ids", "counts", "sizes"])

    return stored(texts.mapInPandas(cut, "ids binary, counts binary, sizes binary"), "decon-terms")


def document_frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Number of texts with each term, and number of texts, from :func:`passage_terms`."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += len(batch)
            for ids in batch["ids"]:
                seen[np.unique(np.frombuffer(ids, np.int32))] += 1
        used = np.flatnonzero(seen)
        yield pd.DataFrame({"term": [-1, *used], "n": [n, *seen[used]]})

    sums = rows.select("ids").mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(size), 0
    for r in sums:
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, total


def term_weights(passages: Passages, terms: list[bytes], df: np.ndarray, total: int, common: float) -> np.ndarray:
    """IDF; terms in over ``common`` of the texts weigh nothing, unless a passage
    would be left with fewer than four terms."""
    idf = np.log((1.0 + total) / (1.0 + df))
    idf = np.maximum(idf, 0.05)
    dropped = df > common * max(1, total)
    at = {t: i for i, t in enumerate(terms)}
    for p in passages.tokens:
        own = {at[t] for t in p}
        if sum(1 for i in own if not dropped[i]) < 4:
            dropped[list(own)] = False
    return np.where(dropped, 0.0, idf)


def tf_idf(ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and weights of the passages with two or more weighty terms, each of length 1, and
    how many terms each has.  ``ids`` are -1 where a term is not the block's."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = ids >= 0
    own[own] = idf[ids[own]] > 0
    own[own] = (np.bincount(owner[own], minlength=len(sizes)) > 1)[owner[own]]
    ids, owner = ids[own], owner[own]
    weights = counts[own] * idf[ids]
    lengths = np.sqrt(np.bincount(owner, weights ** 2, minlength=len(sizes)))
    kept = np.bincount(owner, minlength=len(sizes))
    return ids, weights / lengths[owner], kept[kept > 0]


def add_gram(total: np.ndarray, q: np.ndarray, ids: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> None:
    """``total += A'(A q)`` for the passages of :func:`tf_idf`, a few thousand terms at a time."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff(ends // 4096)) + 1), len(sizes)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        n, at = sizes[lo:hi], slice(ends[lo] - sizes[lo], ends[hi - 1])
        term, w = ids[at], weights[at, None]
        dots = np.add.reduceat(w * q[term], np.cumsum(n) - n, axis=0)
        back = w * np.repeat(dots, n, axis=0)
        order = np.argsort(term, kind="stable")
        used, first = np.unique(term[order], return_index=True)
        total[used] += np.add.reduceat(back[order], first, axis=0)


def latent_space(rows: DataFrame, place: np.ndarray, passages: Passages, terms: list[bytes], idf: np.ndarray, total: int,
                 rank: int, background: int, emphasis: float, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (terms by rank) of the TF-IDF passages of all
    documents (``rows`` of :func:`passage_terms`, whose term ``i`` is this block's
    ``place[i]`` or -1) and of the benchmark.

    A benchmark passage has length ``emphasis``.  Every passage of every document is
    summed; all have the one length at which the documents weigh together as
    ``background`` texts of length 1 would, or 1 if there are fewer."""
    size = len(terms)
    share = min(1.0, background / max(1, total))
    at = {t: i for i, t in enumerate(terms)}
    own = tf_idf(*map(np.concatenate, zip(*(term_counts(np.array([at[t] for t in p]), size) for p in passages.tokens))), idf)

    def gram(q: np.ndarray) -> np.ndarray:
        """A'(A q), summed over the documents' passages by Spark, term by term."""
        width = q.shape[1]

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((size, width))
            for batch in batches:
                for _, run in batch.groupby(batch["ids"].map(len).cumsum() // (4 * CHUNK)):
                    ids, counts, sizes = (np.frombuffer(b"".join(run[c]), t) for c, t in
                                          [("ids", np.int32), ("counts", np.uint8), ("sizes", np.uint8)])
                    add_gram(sums, q, *tf_idf(place[ids], counts, sizes, idf))
            used = np.flatnonzero(np.abs(sums).sum(axis=1))
            if len(used):
                yield pd.DataFrame({"term": used.astype(np.int32), "x": sums[used].tolist()})

        sums = (rows.mapInPandas(part, "term int, x array<double>").groupBy("term")
                .agg(F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("x")).collect())
        out = np.zeros((size, width))
        for r in sums:
            out[r["term"]] = r["x"]
        out *= share
        add_gram(out, q, own[0], emphasis * own[1], own[2])
        return out

    width = min(size, rank + 8)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    return q @ vectors[:, np.argsort(values)[::-1][:rank]]


def lcs(masks: dict[bytes, int], full: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the passage."""
    row = full
    for w in words:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return full.bit_count() - row.bit_count()


def masks_of(passage: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, t in enumerate(passage):
        out[t] = out.get(t, 0) | 1 << i
    return out


class Index:
    """Latent vectors of the passages and all that a task needs to search a text."""

    def __init__(self, passages: Passages, terms: list[bytes], idf: np.ndarray, space: np.ndarray,
                 cosine: float, overlap: float, answer: float, common: np.ndarray):
        self.passages, self.terms, self.idf = passages, terms, idf
        self.cosine, self.overlap, self.answer = cosine, overlap, answer
        self.vectors = (idf[:, None] * space).astype(np.float32)     # of one occurrence of a term
        at = {t: i for i, t in enumerate(terms)}
        own = np.array([self.vectors[[at[t] for t in p]].sum(axis=0) for p in passages.tokens]).reshape(-1, self.vectors.shape[1])
        self.norms = np.maximum(np.linalg.norm(own, axis=1), 1e-9).astype(np.float32)
        self.directions = (own / self.norms[:, None]).astype(np.float32)
        weight = np.array([sum(idf[at[t]] ** 2 for t in p) for p in passages.tokens])
        of = np.searchsorted(CLASSES[:-1], [len(p) for p in passages.tokens])
        #: Length, its passages and the least weight among them.
        self.classes = [(CLASSES[c], np.flatnonzero(of == c), weight[of == c].min()) for c in range(len(CLASSES)) if (of == c).any()]
        # A short item of nothing but common terms is no evidence.
        self.short = [(item, [at[t] for t in words]) for item, words in passages.short if not all(common[at[t]] for t in words)]
        self.ready = None

    def __getstate__(self):
        return {**self.__dict__, "ready": None}

    def start(self) -> None:
        if self.ready is None:
            exact = {i for _, words in self.short for i in words}
            known = {t: i for i, t in enumerate(self.terms) if self.idf[i] > 0 or i in exact}
            self.ready = known, [masks_of(p) for p in self.passages.tokens], [
                masks_of(p[-max(2, len(p) // 4):]) for p in self.passages.tokens]

    def candidates(self, sizes: list[int], ids: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, start, window, passage, cosine) for the windows of consecutive texts, class by class."""
        at = np.flatnonzero(ids >= 0)
        at = at[self.idf[ids[at]] > 0]
        if not len(at):
            return
        mass = np.concatenate(([0.0], np.cumsum(self.idf[ids[at]] ** 2)))
        ends = np.cumsum(sizes)
        for stride, own, least in self.classes:
            directions, norms_own = self.directions[own], self.norms[own]
            starts = [np.arange(e - n, max(e - n + 1, e - stride), stride) for n, e in zip(sizes, ends)]
            text = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
            start = np.concatenate(starts)
            stop = np.minimum(start + 2 * stride, ends[text])
            lo, hi = np.searchsorted(at, start), np.searchsorted(at, stop)
            # A window without a good part of any passage's weight is close to none.
            some = (mass[hi] - mass[lo] >= 0.3 * least) & (hi > lo)
            text, start, lo, hi = text[some], start[some], lo[some], hi[some]
            for i in range(0, len(start), 4096):
                sizes_in = hi[i:i + 4096] - lo[i:i + 4096]
                first = np.cumsum(sizes_in) - sizes_in
                within = np.repeat(lo[i:i + 4096] - first, sizes_in) + np.arange(sizes_in.sum())
                vectors = np.add.reduceat(self.vectors[ids[at[within]]], first, axis=0)
                dots = vectors @ directions.T
                norms = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                # Close in angle, and holding a good part of the passage's own weight.
                r, c = np.nonzero((dots >= self.cosine * norms) & (dots >= 0.4 * norms_own))
                for a, b in zip(r, c):
                    t = text[i + a]
                    yield int(t), int(start[i + a] - (ends[t] - sizes[t])), 2 * stride, int(own[b]), float(dots[a, b] / norms[a, 0])

    def exact(self, sizes: list[int], ids: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) for the short items that stand in consecutive texts, token by token."""
        if not self.short:
            return set()
        base, owner, found = len(self.terms) + 1, np.repeat(np.arange(len(sizes)), sizes), set()
        for n in {len(words) for _, words in self.short}:
            if len(ids) < n:
                continue
            asked: dict[int, list[int]] = {}
            for item, words in self.short:
                if len(words) == n:
                    asked.setdefault(sum(w * base ** k for k, w in enumerate(words)), []).append(item)
            runs = len(ids) - n + 1
            code = sum(ids[k:k + runs] * base ** k for k in range(n))
            whole = np.logical_and.reduce([ids[k:k + runs] >= 0 for k in range(n)]) & (owner[:runs] == owner[n - 1:])
            for i in np.flatnonzero(whole & np.isin(code, list(asked))):
                found.update((int(owner[i]), item) for item in asked[int(code[i])])
        return found

    def confirm(self, words: list[bytes], start: int, window: int, p: int) -> tuple[float, float]:
        """Best LCS share of passage ``p`` over tight spans around the window, and the answer's share there."""
        _, masks, answers = self.ready
        size = len(self.passages.tokens[p])
        full, span = (1 << size) - 1, size + size // 4 + 2
        tail = max(2, size // 4)
        best = (0.0, 0.0)
        reach = max(window // 2, size // 2 + 1)
        lo, hi = max(0, start - reach), min(len(words), start + window + reach)
        region = words[lo:hi]
        if lcs(masks[p], full, region) < self.overlap * size:        # bounds every span inside
            return best
        for a in range(0, max(1, len(region) - span + 1 + size // 8), max(1, size // 8)):
            piece = region[a:a + span]
            share = lcs(masks[p], full, piece) / size
            if share > best[0]:
                best = share, lcs(answers[p], (1 << tail) - 1, piece) / tail
        return best

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, overlap, answer) for every confirmed item of every text; best passage first."""
        if not self.passages.tokens and not self.short:
            return
        self.start()
        known = self.ready[0]
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, text in enumerate([*texts, None]):
            if text is not None:
                words = tokens_of(text)
                if words:
                    group.append((i, words))
                    held += len(words)
            if group and (text is None or held >= CHUNK):
                get = known.get
                ids = np.array([get(w, -1) for _, ws in group for w in ws], np.int64)
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                sizes = [len(ws) for _, ws in group]
                best.update(dict.fromkeys(self.exact(sizes, ids), (1.0, 1.0, 1.0)))
                for t, start, window, p, cos in self.candidates(sizes, ids):
                    key = (t, self.passages.items[p])
                    overlap, answer = self.confirm(group[t][1], start, window, p)
                    if overlap >= self.overlap and answer >= self.answer and (overlap, answer, cos) > best.get(key, (0, 0, 0)):
                        best[key] = overlap, answer, cos
                for (t, item), (overlap, answer, cos) in sorted(best.items()):
                    yield group[t][0], item, cos, overlap, answer
                group, held = [], 0


def build_indexes(docs: DataFrame, benchmark: DataFrame, rank: int = 128, background: int = 4000, emphasis: float = 10.0,
                  block_items: int = 500, min_tokens: int = 2, common: float = 0.05, cosine: float = 0.5, overlap: float = 0.7,
                  answer: float = 0.5, counted_blocks: int = 40) -> list[Index]:
    """An index for each block of the benchmark.  Items of fewer than
    ``min_tokens`` tokens identify nothing and are not searched, nor are items
    under five tokens that hold only terms of over ``common`` of the texts.
    All documents are tokenised once for ``counted_blocks`` blocks; frequencies
    and latent spaces are summed over all of them."""
    texts = docs.select(text_or_empty().alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, math.ceil(items.count() / block_items))
    out = []
    for first in range(0, blocks, counted_blocks):
        group = []
        for b in range(first, min(blocks, first + counted_blocks)):
            rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
            group.append(passages_of([(r["item_id"], r["text"]) for r in rows], min_tokens))
        every = sorted({t for passages in group for t in passages.terms})
        if not every:
            continue
        term_rows = passage_terms(texts, every)
        counts, total = document_frequencies(term_rows, len(every))
        at = {t: i for i, t in enumerate(every)}
        for passages in group:
            terms = passages.terms
            if not terms:
                continue
            own = [at[t] for t in terms]
            df, place = counts[own], np.full(len(every), -1)
            place[own] = np.arange(len(terms))
            idf = term_weights(passages, terms, df, total, common)
            space = (latent_space(term_rows, place, passages, terms, idf, total, min(rank, len(terms)), background, emphasis)
                     if passages.tokens else np.zeros((len(terms), 1)))
            out.append(Index(passages, terms, idf, space, cosine, overlap, answer, df > common * max(1, total)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``doc_id, item_id, cosine, overlap, answer``: one row per document row and
    benchmark item found in it.

    Whole texts are searched.  Null or empty texts and null items match nothing;
    an item that repeats in the benchmark counts once; repeated document rows
    repeat; empty tables give no rows.  ``parameters``: see :func:`build_indexes`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    schema = "doc_id long, item_id long, cosine double, overlap double, answer double"
    out = None
    for index in build_indexes(docs, benchmark, **parameters):
        def search(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = list(index.search(list(batch["text"])))
                ids = batch["doc_id"].array
                yield pd.DataFrame({"doc_id": ids[[f[0] for f in found]], **{
                    c: [f[i] for f in found] for i, c in enumerate(["item_id", "cosine", "overlap", "answer"], 1)}})

        hits = rows.mapInPandas(search, schema)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; judged row by row,
    so null or repeated ids do no harm."""
    for index in build_indexes(docs, benchmark, **parameters):
        docs = docs.where(clean_by(index)(text_or_empty()))
    return docs


def clean_by(index: Index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        out[[f[0] for f in index.search(list(texts))]] = False
        return pd.Series(out)

    return clean
