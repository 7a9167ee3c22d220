"""Language-model scoring with a weighted backoff automaton.

The model is a bigram model by absolute discounting: states are contexts, a
context's bigrams are its arcs with their smoothed log-probabilities, and
its failure arc leads to the unigram state at the price of the backoff weight.
Scoring a text is one traversal from left to right: the state is the word
before, each token takes its arc or the failure arc and adds its log10
probability; the end token closes the text.

The automaton of a corpus fits no single machine, so none holds it.  Documents
are dealt into blocks.  A block sends its distinct n-grams with their training
counts to buckets of n-grams (by hash); a bucket sums the counts of all blocks
and answers each block, in the order asked, with what it needs: the totals of
its words and bigrams and the mass of its contexts.  The block then has
exactly the part of the automaton that its texts can visit.  A context with more
than a bucket's fair share of the tokens is split by the following word, in ways
that follow that share.

Words are identified by 64-bit hashes, followers inside a context by 40 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MB, fold_of, stored, text_or_empty

START, END = b" start", b" end"      # no word holds a blank
LOW40 = np.uint64((1 << 40) - 1)
HOT_SHARE = 1 / 2000                 # contexts above this share of the tokens are split ...
HOT_WAYS = 16                        # ... at least this many ways; others from half a bucket's share on
DISCOUNT = 0.75                      # absolute discount of the bigrams


class Block:
    """The texts of a block as arrays: words by ascending hash, the distinct
    (context, word) pairs in that order, and for every token its pair."""

    def __init__(self, raws: list[bytes], train: np.ndarray):
        ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        start, end = ids[START], ids[END]
        parts, sizes = [], np.empty(len(raws), np.int64)
        for i, raw in enumerate(raws):
            words = raw.lower().split()
            seq = np.empty(len(words) + 2, np.int32)
            seq[0], seq[-1] = start, end
            seq[1:-1] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
            parts.append(seq)
            sizes[i] = len(seq)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes, self.start, self.size = hashes[order], int(rank[start]), len(order)
        seq = rank[np.concatenate(parts)] if parts else np.empty(0, np.int64)
        last = np.cumsum(sizes) - 1
        inner = np.ones(len(seq), bool)
        inner[last - sizes + 1] = False                     # the start is no token
        self.words = seq[inner]
        self.owner = np.repeat(np.arange(len(raws)), sizes - 1)
        before = np.ones(len(seq), bool)
        before[last] = False
        learn = np.repeat(train.astype(np.float64), sizes - 1)
        self.codes, self.pair = np.unique(seq[before] * self.size + self.words, return_inverse=True)
        self.pair_counts = np.bincount(self.pair, learn, len(self.codes)).astype(np.int64)
        self.word_counts = np.bincount(self.words, learn, self.size).astype(np.int64)

    def word_parts(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """Bucket and its words (indexes, by ascending hash)."""
        yield from split((self.hashes % np.uint64(buckets)).astype(np.int64))

    def pair_parts(self, buckets: int, hot: np.ndarray, ways: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Bucket, its contexts, the number of pairs of each and these pairs.  A hot
        context goes to all its buckets, with or without a pair there: each answers with its share of the mass."""
        ctx, word = self.codes // self.size, self.codes % self.size
        at = np.minimum(np.searchsorted(hot, self.hashes), len(hot) - 1)
        own = np.where(hot[at] == self.hashes, ways[at], 1)
        place = mixed(self.hashes)
        way = mixed(self.hashes[word]) % own[ctx].astype(np.uint64)
        bucket = ((place[ctx] + way) % np.uint64(buckets)).astype(np.int64)
        present = np.unique(ctx)
        split_here = present[own[present] > 1]
        more = np.repeat(split_here, own[split_here])
        step = np.arange(len(more)) - np.repeat(np.cumsum(own[split_here]) - own[split_here], own[split_here])
        more_bucket = ((place[more] + step.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        every, of = np.unique(np.concatenate([bucket, more_bucket]) * self.size + np.concatenate([ctx, more]), return_inverse=True)
        sizes = np.bincount(of[:len(ctx)], minlength=len(every))
        asked, first = np.unique(every // self.size, return_index=True)
        order = np.argsort(bucket, kind="stable")
        lo, hi = (np.searchsorted(bucket[order], asked, side) for side in ("left", "right"))
        for b, i, j, k, m in zip(asked, first, np.append(first[1:], len(every)), lo, hi):
            yield int(b), every[i:j] % self.size, sizes[i:j], order[k:m]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second, independent hash of each hash."""
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def split(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    cut = np.flatnonzero(np.diff(buckets[order])) + 1
    for at in np.split(order, cut):
        if len(at):
            yield int(buckets[at[0]]), at


def pack(values: np.ndarray) -> bytes:
    """Counts as two bits each; what 3 stands for follows as one byte each, larger ones as (index, value)."""
    rest = values[values >= 3] - 3
    large = np.flatnonzero(rest >= 255)
    small = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    small[:len(values)] = np.minimum(values, 3)
    bits = small[0::4] | small[1::4] << 2 | small[2::4] << 4 | small[3::4] << 6
    return (np.array([len(values), len(rest)], np.int64).tobytes() + bits.tobytes() + np.minimum(rest, 255).astype(np.uint8).tobytes()
            + np.stack([large, rest[large]]).astype(np.int64).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    n, more = np.frombuffer(raw, np.int64, 2).tolist()
    bits = np.frombuffer(raw, np.uint8, -(-n // 4), 16)
    out = np.stack([bits & 3, bits >> 2 & 3, bits >> 4 & 3, bits >> 6], axis=1).reshape(-1)[:n].astype(np.int64)
    at = 16 + len(bits)
    rest = np.frombuffer(raw, np.uint8, more, at).astype(np.int64)
    large, values = np.frombuffer(raw[at + more:], np.int64).reshape(2, -1)
    rest[large] = values
    out[out == 3] += rest
    return out


def pack40(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8")


ASK = "kind int, bucket long, block long, keys binary, sizes binary, followers binary, counts binary"
REPLY = "kind int, bucket long, block long, totals binary, mass binary, kinds binary"


def ask(block: int, docs: pd.DataFrame, buckets: int, hot: np.ndarray, ways: np.ndarray) -> pd.DataFrame:
    b = Block(list(docs["raw"]), docs["train"].to_numpy(bool))
    rows = [(0, bucket, block, b.hashes[at].tobytes(), None, None, pack(b.word_counts[at])) for bucket, at in b.word_parts(buckets)]
    for bucket, contexts, sizes, at in b.pair_parts(buckets, hot, ways):
        rows.append((1, bucket, block, b.hashes[contexts].tobytes(), pack(sizes),
                     pack40(b.hashes[b.codes[at] % b.size] & LOW40), pack(b.pair_counts[at])))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ASK.split(", ")])


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals over all blocks for the n-grams of one bucket, row by row."""
    keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
    counts = [unpack(c) for c in rows["counts"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    asked = list(zip(rows["bucket"].tolist(), rows["block"].tolist()))
    out = []
    if rows["kind"].iloc[0] == 0:
        totals = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
        parts = np.split(totals[at], np.cumsum([len(k) for k in keys])[:-1])
        for (bucket, block), part in zip(asked, parts):
            out.append((0, bucket, block, pack(part), None, None))
    else:
        sizes = [unpack(s) for s in rows["sizes"]]
        ctx = np.repeat(at, np.concatenate(sizes)).astype(np.uint64)
        code = (ctx << np.uint64(40)) | np.concatenate([unpack40(f) for f in rows["followers"]])
        pairs, of = np.unique(code, return_inverse=True)
        totals = np.bincount(of, np.concatenate(counts), len(pairs)).astype(np.int64)
        owner = (pairs >> np.uint64(40)).astype(np.int64)
        mass = np.bincount(owner, totals, len(every)).astype(np.int64)
        kinds = np.bincount(owner, totals > 0, len(every)).astype(np.int64)
        ctx_parts = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        pair_parts = np.split(of, np.cumsum([len(c) for c in counts])[:-1])
        for (bucket, block), c, p in zip(asked, ctx_parts, pair_parts):
            out.append((1, bucket, block, pack(totals[p]), pack(mass[c]), pack(kinds[c])))
    return pd.DataFrame(out, columns=[c.split()[0] for c in REPLY.split(", ")])


def traverse(docs: pd.DataFrame, replies: pd.DataFrame, buckets: int, hot: np.ndarray, ways: np.ndarray,
             n: int, v: int, discount: float) -> pd.DataFrame:
    """Base and model log10 probability of a block's texts."""
    b = Block(list(docs["raw"]), docs["train"].to_numpy(bool))
    given = {(k, u): row for k, u, row in zip(replies["kind"], replies["bucket"], replies.to_dict("records"))}
    words = np.zeros(b.size, np.int64)
    for bucket, at in b.word_parts(buckets):
        words[at] = unpack(given[0, bucket]["totals"])
    mass, kinds = (np.zeros(b.size, np.int64) for _ in range(2))
    pairs = np.zeros(len(b.codes), np.int64)
    for bucket, contexts, _, at in b.pair_parts(buckets, hot, ways):
        row = given[1, bucket]
        pairs[at] = unpack(row["totals"])
        mass[contexts] += unpack(row["mass"])
        kinds[contexts] += unpack(row["kinds"])
    # Unigram state: seen words by absolute discounting, every other word is one unknown word.
    p = np.where(words > 0, words - discount, discount * v) / n if n else np.ones(b.size)
    # Arcs and failure arcs.
    ctx, word = b.codes // b.size, b.codes % b.size
    back = np.where(mass > 0, DISCOUNT * kinds / np.maximum(mass, 1), 1.0)
    arc = np.log10(back[ctx] * p[word] + np.where(pairs > 0, pairs - DISCOUNT, 0.0) / np.maximum(mass[ctx], 1))
    base = np.log10((words + 1) / (n + 1 * (v + 1)))
    total = lambda x: np.bincount(b.owner, x, len(docs))
    return pd.DataFrame({
        "doc_id": docs["doc_id"].array, "n_tokens": total(np.ones(len(b.owner))).astype(np.int64),
        "n_known": total((words > 0)[b.words]).astype(np.int64), "train_tokens": np.full(len(docs), n, np.int64),
        "base_score": total(base[b.words]), "score": total(arc[b.pair])})


def vocabulary(rows: DataFrame, buckets: int) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """Training tokens, distinct training tokens, the unigrams' discount (from the
    numbers of words seen once and twice; without either the bigrams', so that it
    lies between 0 and 1), and by ascending hash the words that hold over
    ``HOT_SHARE`` of them or half a bucket's share (so at most 2000 or two a
    bucket), and the start, with the ways in which each is split."""
    share = min(HOT_SHARE, 0.5 / buckets)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: defaultdict[bytes, int] = defaultdict(int)

        def drain() -> pd.DataFrame:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))
            counts = np.fromiter(seen.values(), np.int64, len(seen))
            seen.clear()
            return pd.DataFrame([(b, hashes[at].tobytes(), pack(counts[at]))
                                 for b, at in split((hashes % np.uint64(buckets)).astype(np.int64))], columns=["bucket", "keys", "counts"])

        for batch in batches:
            for raw in batch["raw"]:
                for w in raw.lower().split():
                    seen[w] += 1
                seen[END] += 1
            if len(seen) > 600_000:
                yield drain()
        yield drain()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        every, at = np.unique(np.concatenate([np.frombuffer(k, np.uint64) for k in rows["keys"]]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([unpack(c) for c in rows["counts"]]), len(every)).astype(np.int64)
        top = counts >= max(2, share * counts.sum() / 4)        # a superset; the exact share follows
        none = np.zeros(top.sum(), np.int64)
        return pd.DataFrame({"key": [None, *every[top].astype(np.int64)], "n": [counts.sum(), *counts[top]], "v": [len(every), *none],
                             "once": [(counts == 1).sum(), *none], "twice": [(counts == 2).sum(), *none]}).astype({"key": "Int64"})

    asked = rows.where("train").select("raw").mapInPandas(local, "bucket long, keys binary, counts binary")
    sums = stored(asked.groupBy("bucket").applyInPandas(total, "key long, n long, v long, once long, twice long"), "lm-vocabulary")
    n, v, once, twice = sums.where("key IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once", "twice")]).first()
    hot = {r["key"] % (1 << 64): r["n"] / n for r in sums.where(F.col("key").isNotNull() & (F.col("n") >= share * n)).select("key", "n").collect()}
    hot[xxhash.xxh64_intdigest(START)] = hot.get(xxhash.xxh64_intdigest(END), 0.0)      # as many starts as ends
    hashes = np.array(sorted(hot), np.uint64)
    part = np.array([hot[h] for h in sorted(hot)])
    ways = np.clip(np.maximum(np.ceil(2 * part * buckets), np.where(part >= HOT_SHARE, HOT_WAYS, 1)), 1, buckets).astype(np.int64)
    discount = once / (once + 2 * twice) if once and twice else DISCOUNT
    return n, v, discount, hashes, ways


def score_documents(docs: DataFrame, modulus: int = 7, held_out: int = 2, block_bytes: int = 8 * MB,
                    bucket_bytes: int = 8 * MB) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per
    row: log10 probabilities of the whole text under the smoothed unigram base
    and under the automaton, both learned from the rows outside the held-out fold.
    Texts are held in blocks of ``block_bytes``, n-grams in buckets for
    ``bucket_bytes`` of text; both together bound the messages between them.

    Null text counts as empty (its end token alone); a null ``doc_id`` is in no
    held-out fold, so it trains.  Unknown words share the model's unknown-word
    probability.  Repeated rows count and score one by one.  Without training
    rows every known probability is 1 and the score 0; no rows give none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("raw"),
                       (fold_of(modulus) != held_out).alias("train"))
    spark = docs.sparkSession
    size = rows.select(F.sum(F.octet_length("raw"))).first()[0] or 0
    least = 2 * spark.sparkContext.defaultParallelism
    blocks, buckets = (int(max(least, -(-size // part))) for part in (block_bytes, bucket_bytes))
    n, v, discount, hot, ways = vocabulary(rows, buckets)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(blocks))).repartition(blocks, "block")

    def asked(key, batch: pd.DataFrame) -> pd.DataFrame:
        return ask(int(key[0]), batch, buckets, hot, ways)

    def scored(batch: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        return traverse(batch, replies, buckets, hot, ways, n, v, discount)

    replies = (dealt.groupBy("block").applyInPandas(asked, ASK)
               .groupBy("kind", "bucket").applyInPandas(answer, REPLY).repartition(blocks, "block"))
    out = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(
        scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", (fold_of(modulus) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")
