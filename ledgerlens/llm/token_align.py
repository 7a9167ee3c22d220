"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Each batch of texts is encoded by both tokenizers.  A pandas ``merge_asof`` keyed
by document finds, for every token's start, the other side's covering token; both
directions together give all overlaps, and overlaps with equal ends cut a text
into groups.  Counts of linked id pairs over the corpus are Spark sums.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

TOKENIZERS = "/opt/tokenizers"
ID_BITS = 20
ENCODED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, links array<long>")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """One tokenizer: texts to ids, and the bytes of each id."""

    def __init__(self, pieces: list[bytes], encode):
        self.pieces, self.encode = pieces, encode
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)

    def named(self, within: str, last: str) -> np.ndarray:
        """Each id in decimal with the mark behind it, then the same with ``last``."""
        return np.array([f"{i}{mark}" for mark in (within, last) for i in range(len(self.pieces))], dtype=object)


#: How a byte-level tokenizer cuts a text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked_by_id(file: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE whose ids follow its merges:
    its ids are then merge ranks, all that the faster encoder needs."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    made = [m if isinstance(m, str) else " ".join(m) for m in merges]
    return (model.get("type", "BPE") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space")
            and cut.get("use_regex", True) and not file.get("normalizer") and not model.get("ignore_merges")
            and all(vocab.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(made)))


def byte_level(raw: bytes) -> Side:
    """A byte-level tokenizer file; special tokens' strings are plain text and a
    space goes before every text."""
    file, alphabet = json.loads(raw), byte_alphabet()
    vocab = file["model"]["vocab"] | {t["content"]: t["id"] for t in file.get("added_tokens", [])}
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    if ranked_by_id(file):
        import tiktoken

        ranks = {pieces[i]: i for i in range(256 + len(file["model"]["merges"]))}
        fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        return Side(pieces, lambda texts: [fast.encode_ordinary(" " + t) for t in texts])
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(raw)
    tokenizer.encode_special_tokens = True
    return Side(pieces, lambda texts: [e.ids for e in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)])


def sentence_pieces(raw: bytes) -> Side:
    """A sentence-piece model, which puts the space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return Side([piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())],
                lambda texts: model.encode(texts, num_threads=1))


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> pd.DataFrame:
    """All (a, b) places of tokens that share a byte: the union, over both sides, of
    each token's start and the other side's token that covers it (tokens that start
    together come twice).  Starts are byte offsets that increase over a batch."""
    left = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(start_a))})
    right = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(start_b))})
    found = [pd.merge_asof(left, right, on="at", by="doc"), pd.merge_asof(right, left, on="at", by="doc")]
    return pd.concat([f[["a", "b"]] for f in found], ignore_index=True)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of ``n`` over each."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(n[order], new)


@dataclass
class Tokens:
    """One side's tokens of a batch: document, id, end offset and group of each."""
    doc: np.ndarray
    ids: np.ndarray
    end: np.ndarray
    group: np.ndarray

    @classmethod
    def of(cls, side: Side, encoded: list[list[int]]) -> Tokens:
        sizes = [len(ids) for ids in encoded]
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.int64, sum(sizes))
        return cls(np.repeat(np.arange(len(encoded)), sizes), ids, np.cumsum(side.lengths[ids]), np.empty(0, np.int64))

    def start(self) -> np.ndarray:
        return np.concatenate([[0], self.end[:-1]]).astype(np.int64)

    def by_group(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (group, id) with the number of such tokens, in order."""
        keys, n = summed((self.group << ID_BITS) | self.ids, np.ones(len(self.ids), np.int64))
        return keys >> ID_BITS, keys & ((1 << ID_BITS) - 1), n


def grouped(side_a: Side, side_b: Side, in_a: list[list[int]], in_b: list[list[int]]) -> tuple[Tokens, Tokens, np.ndarray]:
    """Both sides' tokens with their groups, and the document of each group."""
    a, b = Tokens.of(side_a, in_a), Tokens.of(side_b, in_b)
    both = overlaps(a.doc, a.start(), b.doc, b.start())
    at_a, at_b = both["a"].to_numpy(), both["b"].to_numpy()
    equal = a.end[at_a] == b.end[at_b]
    for side, at in ((a, at_a[equal]), (b, at_b[equal])):
        last = np.zeros(len(side.ids), np.int64)                        # tokens that end a group
        last[at] = 1
        side.group = np.cumsum(last) - last
    doc = np.empty(a.group[-1] + 1, np.int64)
    doc[a.group] = a.doc
    return a, b, doc


def linked_pairs(a: Tokens, b: Tokens, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``document, pair, links`` of each document's distinct linked id pairs (A's id
    above B's in one number).  Equal ids of a group are counted before the sides
    meet, so a long run of one token makes one pair."""
    group_a, id_a, n_a = a.by_group()
    group_b, id_b, n_b = b.by_group()
    first, past = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, side="right")
    width = past - first
    left = np.repeat(np.arange(len(group_a)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    keys, links = summed((doc[group_a[left]] << 2 * ID_BITS) | (id_a[left] << ID_BITS) | id_b[right], n_a[left] * n_b[right])
    return keys >> 2 * ID_BITS, keys & ((1 << 2 * ID_BITS) - 1), links


def group_digests(named_a: np.ndarray, named_b: np.ndarray, a: Tokens, b: Tokens, n_docs: int) -> list[str]:
    """The SHA-256 of each document's groups, ``a1,a2|b1;a3|b2,b3``: every id in
    decimal, with the mark behind it, at its place in the text."""
    last_a, last_b = np.r_[a.group[1:] != a.group[:-1], True], np.r_[b.group[1:] != b.group[:-1], True]
    size_a, size_b = np.bincount(a.group), np.bincount(b.group)
    before = (np.cumsum(size_b) - size_b)[a.group]                      # b tokens of earlier groups
    through = np.cumsum(size_a)[b.group]                                # a tokens up to the own group
    marked = np.empty(len(a.ids) + len(b.ids), dtype=object)
    marked[np.arange(len(a.ids)) + before] = named_a[a.ids + last_a * (len(named_a) // 2)]
    marked[np.arange(len(b.ids)) + through] = named_b[b.ids + last_b * (len(named_b) // 2)]
    docs = np.arange(n_docs + 1)
    edges = (np.searchsorted(a.doc, docs) + np.searchsorted(b.doc, docs)).tolist()
    return [hashlib.sha256("".join(marked[i:j].tolist())[:-1].encode()).hexdigest() for i, j in zip(edges, edges[1:])]


class Aligner:
    """Both tokenizers and the tables that the digests need; one per task."""

    def __init__(self, side_a: Side, side_b: Side):
        self.a, self.b = side_a, side_b
        self.named_a, self.named_b = side_a.named(",", "|"), side_b.named(",", ";")

    def align(self, texts: list[str]) -> list[tuple]:
        """``n_a, n_b, n_groups, n_links, groups_sha256, pairs, links`` of each text."""
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        rows: dict[str, list[int]] = {}
        for i, text in enumerate(texts):                                # equal texts are aligned once
            if text:
                rows.setdefault(text, []).append(i)
        given, kept, in_a, in_b = list(rows), [], [], []
        for text, x, y in zip(given, self.a.encode(given), self.b.encode(given)) if given else []:
            whole = (" " + text).encode()
            if b"".join([self.a.pieces[k] for k in x]) == whole == b"".join([self.b.pieces[k] for k in y]):
                kept.append(text), in_a.append(x), in_b.append(y)
        if not kept:
            return out
        a, b, doc = grouped(self.a, self.b, in_a, in_b)
        where, pair, links = linked_pairs(a, b, doc)
        digests = group_digests(self.named_a, self.named_b, a, b, len(kept))
        places = np.arange(len(kept) + 1)
        of_group, of_pair = np.searchsorted(doc, places).tolist(), np.searchsorted(where, places).tolist()
        for k, text in enumerate(kept):
            own = slice(of_pair[k], of_pair[k + 1])
            found = (len(in_a[k]), len(in_b[k]), of_group[k + 1] - of_group[k], int(links[own].sum()), digests[k], pair[own], links[own])
            for i in rows[text]:
                out[i] = found
        return out


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """A tokenizer file's bytes, read by the driver and sent with the tasks (a few
    megabytes, fixed by the tokenizer): a local path, or a URI that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def alignments(docs: DataFrame, byte_level_file: str, piece_file: str, chars: int = 500_000) -> DataFrame:
    """Both encodings of every row: counts, group digest and distinct linked pairs.
    Texts are taken in runs of about ``chars`` characters, a longer one alone."""
    spark = docs.sparkSession
    raw_a, raw_b = vocabulary(spark, byte_level_file), vocabulary(spark, piece_file)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(byte_level(raw_a), sentence_pieces(raw_b))
        names = [f.split()[0] for f in ENCODED.split(", ")]
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            run = (np.cumsum([len(t) for t in texts]) // chars).tolist() if texts else []
            begins = [i for i in range(len(run)) if i == 0 or run[i] != run[i - 1]] + [len(run)]
            for i, j in zip(begins, begins[1:]):
                columns = zip(*aligner.align(texts[i:j]))
                yield pd.DataFrame({"doc_id": batch["doc_id"].array[i:j], **dict(zip(names[1:], map(list, columns)))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(encode, ENCODED)


def align(docs: DataFrame, byte_level_file: str = f"{TOKENIZERS}/byte_bpe_50k.json",
          piece_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", broadcast_rows: int = 1 << 20) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per
    row of ``docs``: its tokens by both tokenizers, its groups (cut where both end
    a token), its links (token pairs within a group), the links whose id pair has
    its A id's highest count over the corpus, and the sum of the links' counts.  A
    pair's count is the number of rows that hold it linked.

    Null and empty texts, and texts that either tokenizer does not return byte by
    byte, have no tokens: zeros and an empty digest.  Repeated rows count one by
    one; a null ``doc_id`` keeps its row.  No rows give none.

    Every row's distinct pairs are stored once.  The counts are sums combined
    before their shuffle; they are sent to the tasks if they are at most
    ``broadcast_rows`` rows of 17 bytes, and joined by a shuffle beyond."""
    rows = stored(alignments(docs, byte_level_file, piece_file).withColumn("row", F.monotonically_increasing_id()), "align-rows")
    pairs = rows.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", "x.pairs", "x.links")
    counts = stored(pairs.groupBy("pairs").agg(F.count(F.lit(1)).alias("docs")), "align-counts")
    id_a = F.shiftright("pairs", ID_BITS)
    highest = counts.groupBy(id_a.alias("a")).agg(F.max("docs").alias("most"))
    table = stored(counts.join(highest, id_a == F.col("a")).select("pairs", "docs", (F.col("docs") == F.col("most")).alias("best")),
                   "align-table")
    small = table.count() <= broadcast_rows
    scored = (pairs.join(F.broadcast(table) if small else table, "pairs").groupBy("row")
              .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
                   F.sum(F.col("links") * F.col("docs")).alias("count_sum")))
    zero = F.lit(0).cast("long")
    return rows.join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
