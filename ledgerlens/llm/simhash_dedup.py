"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprint: every word shingle votes with its XXH64; a bit is set where more
than half the votes have it.  Two fingerprints link when they differ in at most
``max_bits`` bits; a class is a connected component of links.

The search never compares all pairs:

* Equal fingerprints collapse first, so a group of exact copies is one row.
* Pigeonhole: with the 64 bits cut into ``max_bits + 2`` blocks, two linked
  fingerprints agree on at least two whole blocks.  Each fingerprint is dealt
  once per pair of blocks, keyed by (pair, value of the pair).
* A key that more than ``split_rows`` fingerprints share is dealt again on the
  bits still free, so it reaches many tasks instead of one.
* Inside a key the fingerprints are sorted by the Gray rank of their masked
  bits.  An upper node stands for a run that shares a bit pattern; node pairs
  carry the differences found so far and whole groups are pruned once these
  exceed ``max_bits``.
* A key reports a star per component found in it (its smallest member), not
  the pairs; components over all keys are then found by min-label
  contraction with joins, checkpointed every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_side, stored, text_or_empty

SEED = 42
SEGMENT = 4          # bits by which one level of the index splits a node
PAIR_LIMIT = 1 << 20  # node pairs expanded at a time (bounds memory)


def fingerprint_of(raw: bytes, shingle: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    text = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    votes, half = np.zeros(64, np.int64), n
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((digest(text[a:b - 1], SEED) for a, b in zip(starts[lo:hi], starts[lo + size:hi + size])),
                        np.dtype(">u8"), hi - lo)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * votes > half).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit integer) per row; null text counts as empty."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = [fingerprint_of(raw, shingle) for raw in batch["raw"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fp": np.array(fp, np.uint64).astype(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("raw"))
    return rows.mapInPandas(score, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray order."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def popcount(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64)


def linked_stars(fps: np.ndarray, free: int, max_bits: int) -> np.ndarray:
    """For distinct ``fps`` (uint64), the smallest member of each one's component
    under links of at most ``max_bits`` differing bits among the ``free`` bits."""
    order = np.argsort(gray_rank(fps & np.uint64(free)), kind="stable")
    keys = fps[order] & np.uint64(free)
    n = len(keys)
    # Free bits, high to low, in segments: the levels of the index.
    bits = [b for b in range(63, -1, -1) if free >> b & 1]
    masks = [sum(1 << b for b in bits[i:i + SEGMENT]) for i in range(0, len(bits), SEGMENT)]
    # Runs of Gray-sorted keys that share all bits of the levels so far.
    ends, prefix = [np.array([0, n])], 0
    for m in masks:
        prefix |= m
        shared = keys & np.uint64(prefix)
        ends.append(np.concatenate(([0], np.flatnonzero(shared[1:] != shared[:-1]) + 1, [n])))
    parent = np.arange(n)

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        """Union by smallest label until every given pair agrees."""
        while True:
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    stack = [(0, np.array([0]), np.array([0]), np.array([0]))]  # level, node, node, differences
    while stack:
        level, left, right, diff = stack.pop()
        if level == len(masks):
            merge(ends[level][left], ends[level][right])
            continue
        if len(left) > PAIR_LIMIT:
            for lo in range(0, len(left), PAIR_LIMIT):
                stack.append((level, left[lo:lo + PAIR_LIMIT], right[lo:lo + PAIR_LIMIT], diff[lo:lo + PAIR_LIMIT]))
            continue
        own, child = ends[level], ends[level + 1]
        first = np.searchsorted(child, own)           # children of node i: first[i] .. first[i + 1] - 1
        nl, nr = first[left + 1] - first[left], first[right + 1] - first[right]
        total = nl * nr
        at = np.repeat(np.arange(len(left)), total)
        k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        a = first[left[at]] + k // nr[at]
        b = first[right[at]] + k % nr[at]
        m = np.uint64(masks[level])
        d = diff[at] + popcount((keys[child[a]] ^ keys[child[b]]) & m)
        keep = (d <= max_bits) & (a <= b)             # left <= right: each pair of nodes once
        stack.append((level + 1, a[keep], b[keep], d[keep]))
    label = np.empty(n, np.uint64)
    label[order] = fps[order][parent]
    # Smallest fingerprint (signed order, as Spark compares) of each component.
    group = np.empty(n, np.int64)
    group[order] = parent
    signed = fps.astype(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, group, signed)
    return least[group]


def block_masks(bits: list[int], blocks: int) -> list[int]:
    """``bits`` cut into ``blocks`` runs of nearly equal length, as masks."""
    cut = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(cut, cut[1:])]


def pair_masks(free: int, max_bits: int) -> list[int]:
    """Masks of every pair of ``max_bits + 2`` blocks of the ``free`` bits: two
    patterns within ``max_bits`` agree under at least one of them."""
    blocks = block_masks([b for b in range(64) if free >> b & 1], max_bits + 2)
    return [a | b for a, b in combinations(blocks, 2)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def link_stars(fps: DataFrame, max_bits: int, split_rows: int) -> DataFrame:
    """``fp, root``: stars whose components are those of the links between the
    distinct fingerprints ``fps``; fingerprints without a link do not appear."""
    full = (1 << 64) - 1
    masks = pair_masks(full, max_bits)

    def dealt(rows: DataFrame, shared: Column) -> DataFrame:
        return rows.withColumn("key", F.col("fp").bitwiseAND(shared))

    level = dealt(fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask")), F.col("mask"))
    sizes = level.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    level = level.join(sizes, ["mask", "key"])
    # Keys with many fingerprints: deal them again on the bits still free.
    sub = F.lit(None).cast("array<bigint>")
    for m in masks:
        finer = F.array(*[F.lit(signed(m | x)) for x in pair_masks(full & ~m, max_bits)])
        sub = F.when(F.col("mask") == signed(m), finer).otherwise(sub)
    finer = F.when(F.col("n") > split_rows, sub).otherwise(F.array(F.col("mask")))
    level = dealt(level.select("fp", F.explode(finer).alias("mask")), F.col("mask"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy().astype(np.uint64)
        if len(values) < 2:
            return pd.DataFrame({"fp": np.array([], np.int64), "root": np.array([], np.int64)})
        root = linked_stars(values, ~int(group["mask"].iloc[0]) & full, max_bits)
        own = values.astype(np.int64)
        linked = root != own
        return pd.DataFrame({"fp": own[linked], "root": root[linked]})

    # A few MB here are much work: keep every partition instead of merging small ones.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return level.repartition(tasks, "mask", "key").groupBy("mask", "key").applyInPandas(search, "fp long, root long")


def components(edges: DataFrame, label: str = "simhash") -> DataFrame:
    """``node, root`` with the smallest node reachable over ``edges(fp, root)``,
    for every node with an edge.  Each round links every node to the smallest
    label beside it and then jumps over labels, so rounds grow with the log of
    a chain's length; the round's table is written to the shared folder."""
    both = stored(edges.select(F.col("fp").alias("u"), F.col("root").alias("v"))
                  .unionAll(edges.select(F.col("root").alias("u"), F.col("fp").alias("v"))).distinct(), f"{label}-edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select(F.col("u").alias("node"), F.least("u", "m").alias("root")), f"{label}-labels")
    while True:
        beside = (both.join(labels.select(F.col("node").alias("v"), "root"), "v")
                  .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        # The label's own label: hooks whole trees at once.
        near = labels.join(beside, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        hooked = (near.select(F.col("old").alias("at"), F.col("mid").alias("to"))
                  .unionAll(near.select(F.col("node").alias("at"), F.col("mid").alias("to")))
                  .groupBy("at").agg(F.min("to").alias("to")))
        jump = hooked.select(F.col("at").alias("mid"), F.col("to").alias("top"))
        fresh = (near.join(hooked.withColumnRenamed("at", "node"), "node")
                 .select("node", "old", F.least("mid", "to").alias("mid"))
                 .join(jump, "mid", "left")
                 .select("node", "old", F.least("mid", F.coalesce("top", "mid")).alias("root")))
        fresh = stored(fresh, f"{label}-labels")
        labels = fresh.select("node", "root")
        if fresh.where("root <> old").isEmpty():
            return labels


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2, split_rows: int = 2000) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest
    ``doc_id`` reachable over links.  Null or wordless text has fingerprint zero
    and links like any other; fewer than ``shingle`` words form one shingle.  A
    null ``doc_id`` keeps its row and never becomes a component's id unless it
    is the only kind there.  Repeated rows stay repeated.  No rows give none."""
    rows = stored(fingerprints(docs, shingle), "simhash-rows")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    tops = components(link_stars(fps.select("fp"), max_bits, split_rows))
    grouped = fps.join(tops.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                           "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, split_rows: int = 2000) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: one whose ``doc_id`` is
    the component's id.  Rows that repeat an id with texts of several groups are
    judged by their own text, so no group loses its survivor to another's row.
    Rows with a null ``doc_id`` cannot be told apart and all stay."""
    classes = stored(simhash_components(docs, shingle, max_bits, split_rows).where("doc_id IS NOT NULL"), "simhash-classes")
    ids = stored(classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("least"),
                                               F.max("component_id").alias("most"))
                 .where("n > 1 OR least <> doc_id").withColumn("mixed", F.col("least") != F.col("most")), "simhash-ids")
    gone = ids.where("NOT mixed AND least <> doc_id").select(F.col("doc_id").alias("_gone"))
    again = ids.where("mixed OR least = doc_id").select(F.col("doc_id").alias("_again"))
    again.stored_path = gone.stored_path = ids.stored_path                  # subsets: no larger than their table
    left = docs.join(small_side(gone), docs["doc_id"] == gone["_gone"], "left_anti")
    if again.isEmpty():
        return left
    again = small_side(again)
    whole = left.join(again, left["doc_id"] == again["_again"], "left_anti")
    repeated = left.join(again, left["doc_id"] == again["_again"], "left_semi")

    @F.pandas_udf("long")
    def fingerprint(raw: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(r, shingle) for r in raw], np.uint64).astype(np.int64))

    name, component, same, value = (free_name(docs, base) for base in ("_fp", "_component", "_same", "_hex"))
    own = classes.select(F.col("doc_id").alias(same), F.col("fingerprint").alias(value), F.col("component_id").alias(component)).distinct()
    judged = repeated.withColumn(name, F.lower(F.lpad(F.hex(fingerprint(text_or_empty().cast("binary"))), 16, "0")))
    kept = (judged.join(own, (F.col("doc_id") == F.col(same)) & (F.col(name) == F.col(value)))
            .where(F.col("doc_id") == F.col(component)).dropDuplicates([component]).select(*docs.columns))
    return whole.unionByName(kept)
