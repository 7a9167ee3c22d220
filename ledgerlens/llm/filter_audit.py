"""Filter interaction audit: what each filter of a chain removes, in every order.

A document's failed filters form a bit mask.  The step at which an order removes
it is a min-plus product: the mask matrix (0 where the filter fails, infinite
elsewhere) combined by minimum with the order's inverse permutation (the place
of each filter).  The texts are read once, for the masks; all orders follow from
the number of documents per part and mask, at most 32 rows a part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stored, text_or_empty

FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
AUDIT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of its words are
    distinct), C (over 2 % of its code points are A-Z), D (a symbol of #$%&*|)."""
    upper = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
            100 * upper > 2 * F.char_length(text), text.rlike("[#$%&*|]")]


def failed_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: rows of ``docs`` by id, part and failed filters
    (bit i: ``FILTERS[i]``).

    E compares by the SHA-256 of the text.  Rows that repeat an id and a text
    collapse before the first shuffle, and the smallest id of a text is a
    combined minimum joined back by text and id, so a text that a third of all
    rows share is no hot key."""
    text = F.col("text")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("text"))
            .withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")))
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures(text, F.col("words")))]
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), sum(bits[1:], bits[0]).alias("mask"))
    rows = stored(rows.groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = (rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
             .select(F.col("key").alias("_key"), F.col("doc_id").alias("_first")))
    again = F.when(F.col("_first").isNull() & F.col("doc_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    return (rows.join(first, (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("_first")), "left")
            .select("doc_id", "part", (F.col("mask") + again).alias("mask"), "n"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and those labelled quality 1 and
    toxic 1, per part and set of failed filters.  A document labelled more than
    once counts as labelled 1 if any of its labels is 1."""
    flags = stored(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "audit-labels")
    return (failed_masks(docs).join(small_side(flags, 8 << 20), "doc_id", "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
                 F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")))


class Orders:
    """The removal step of every mask in every order of ``k`` filters, and the
    masks that an order's step removes or finds removed."""

    def __init__(self, k: int):
        self.orders = list(itertools.permutations(range(k)))
        place = np.empty((len(self.orders), k), dtype=np.int64)                 # inverse permutations, from 1
        for i, order in enumerate(self.orders):
            place[i, list(order)] = np.arange(1, k + 1)
        fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1                # mask x filter
        never = k + 1
        cost = np.where(fails == 1, 0, never)
        self.removal = np.minimum((cost[:, None, :] + place[None]).min(axis=2), never)   # min-plus product
        steps = np.arange(1, k + 1)
        self.at = np.array(self.orders)                                         # order x step: its filter
        self.removed = (self.removal[:, :, None] == steps).astype(np.int64)     # mask x order x step
        self.redundant = ((self.removal[:, :, None] < steps) & (fails[:, self.at] == 1)).astype(np.int64)
        self.k = k

    def audit(self, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Counts by order and step from ``weights`` (3 x masks: all, good, toxic)."""
        removed, good, toxic = (np.einsum("m,mos->os", w, self.removed) for w in weights)
        own = np.zeros(self.k, dtype=np.int64)
        np.add.at(own, self.at, removed)                                        # by filter, over all orders and steps
        return {"kept": weights[0].sum() - np.cumsum(removed, axis=1), "removed": removed,
                "redundant": np.einsum("m,mos->os", weights[0], self.redundant),
                "unique_fails": weights[0][1 << self.at], "good_lost": good, "toxic_lost": toxic, "shapley": own[self.at]}


def audit_orders(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of ``filters`` for each part of ``part, mask, n, good, toxic``."""
    def audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Orders(len(filters))
        names = ["".join(filters[f] for f in order) for order in table.orders]
        for batch in batches:
            for part, cells in zip(batch["part"], batch["cells"]):
                weights = np.zeros((3, 1 << len(filters)), dtype=np.int64)
                for cell in cells:
                    weights[:, cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
                out = {name: values.ravel() for name, values in table.audit(weights).items()}
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(names, len(filters)),
                                    "step": np.tile(np.arange(1, len(filters) + 1, dtype=np.int32), len(names)), **out})

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInPandas(audit, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (value of ``source``; null: empty string), order of the
    five filters and step: documents ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing its filter, removed earlier), ``unique_fails`` (failing
    its filter only), ``good_lost`` and ``toxic_lost`` (labelled 1 and removed
    here), ``shapley`` (its filter's removals over all orders).

    Null text counts as empty: it fails A only, and E after a smaller id with an
    empty text.  A row without an id never fails E and makes no other row fail
    it; rows that repeat an id and a text do not fail E by each other and count
    one by one.  Parts have all their rows, zeros included; no documents give none."""
    return audit_orders(mask_counts(docs, labels))


def audit_oracle() -> str:
    letters = ", ".join(f"('{c}', {i})" for i, c in enumerate(FILTERS))
    distinct = " AND ".join(f"{a}.c <> {b}.c" for a, b in itertools.combinations("vwxyz", 2))
    return rf"""
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM rows),
fails AS (
  SELECT doc_id, part,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM words),
flags AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN flags USING (doc_id) GROUP BY part, mask),
letters(c, bit) AS (VALUES {letters}),
orders AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z WHERE {distinct}),
removal AS (
  SELECT filter_order, m.mask,
         min(CASE WHEN (m.mask >> bit) & 1 = 1 THEN instr(filter_order, c) ELSE 6 END) AS gone
  FROM orders, letters, (SELECT unnest(range(32)) AS mask) m GROUP BY filter_order, m.mask),
steps AS (
  SELECT filter_order, instr(filter_order, c) AS step, c, bit FROM orders, letters),
cells AS (
  SELECT part, s.filter_order, s.step, c,
         sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < step AND (mask >> bit) & 1 = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = 1 << bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts JOIN removal USING (mask) JOIN steps s USING (filter_order)
  GROUP BY part, s.filter_order, s.step, c)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM cells"""
