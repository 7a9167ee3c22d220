"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams; a
document's most frequent n-grams are compared with it by the out-of-place
distance: how many places each n-gram stands from its place in the profile, or
the profile's length where it is missing.  The nearest language wins.

n-grams are one to three characters of lower-cased words with a space at each
end, packed exactly into 63 bits (21 a code point).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, text_or_empty

SPACE, POINT_BITS = 32, 21
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For every code point: 2 letter, 1 mark, 0 neither."""
    kind = {"L": 2, "M": 1}
    return np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], dtype=np.uint8)


def words_of(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the whole lower-cased text's words (letters and their marks),
    one space before, between and after them; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    kind = table[points]
    if not (kind == 2).any():
        return np.empty(0, np.int64)
    inside = kind > 0
    after = np.empty_like(inside)                       # the place behind a word's end holds its one space
    after[0], after[1:] = False, inside[:-1]
    points = np.where(inside, points, SPACE)[inside | after].astype(np.int64)
    ends = [] if points[-1] == SPACE else [SPACE]
    return np.concatenate([[SPACE], points, ends]).astype(np.int64)


def grams_of(points: np.ndarray) -> np.ndarray:
    """The n-grams of :func:`words_of`, repeats included; none spans two words."""
    if not len(points):
        return points
    one, two = points[points != SPACE], (points[:-1] << POINT_BITS) | points[1:]
    three = ((two[:-1] << POINT_BITS) | points[2:])[points[1:-1] != SPACE]
    return np.concatenate([one, two, three])


def ranked(grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent of ``grams``, with all that tie with the last, and
    their ranks from 0; n-grams of equal count share the mean of their ranks."""
    codes, n = np.unique(grams, return_counts=True)
    if len(n) > size:
        keep = n >= np.partition(n, len(n) - size)[len(n) - size]
        codes, n = codes[keep], n[keep]
    _, place, same = np.unique(-n, return_inverse=True, return_counts=True)
    return codes, (np.cumsum(same) - (same + 1) / 2.0)[place]


class Profiles:
    """Language profiles: names in order, all their n-grams in order, and each
    n-gram's rank in every profile (``size`` where it is missing)."""

    def __init__(self, grams: dict[str, list[int]], size: int):
        self.names, self.size = sorted(grams), size
        self.codes = np.array(sorted(set().union(*grams.values())), dtype=np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), float(size))
        for column, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, grams[name]), column] = np.arange(len(grams[name]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to every language, 0 to 1."""
        codes, place = ranked(grams, self.size)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        there = self.ranks[np.where(self.codes[at] == codes, at, len(self.codes))]
        apart = np.where(there >= self.size, self.size, np.minimum(np.abs(there - place[:, None]), self.size))
        return apart.mean(axis=0) / self.size

    def predict(self, grams: np.ndarray) -> tuple[str, float, float]:
        """Nearest language (of several the first by name), its likeness and its
        lead over the next."""
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0, 0.0
        apart = self.distances(grams)
        best = int(apart.argmin())
        rest = np.delete(apart, best)
        return self.names[best], float(1 - apart[best]), float(rest.min() - apart[best]) if len(rest) else 1.0


def training_rows(docs: DataFrame, modulus: int, held_out: int, max_train_per_lang: int) -> DataFrame:
    """``lang, text`` of the rows to learn from: with an id outside the held-out
    fold and a language; at most about ``max_train_per_lang`` of each language,
    chosen by a hash of the id."""
    rows = (docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"),
                        text_or_empty().alias("text"), fold_of(modulus).alias("fold"))
            .where(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.col("fold") != held_out)))
    shares = {r["lang"]: max_train_per_lang / r["count"] for r in rows.groupBy("lang").count().collect()}
    cuts = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, int(min(1.0, share) * (1 << 20)) + 1)]) \
        if shares else F.create_map().cast("map<string,int>")
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < cuts[F.col("lang")]).select("lang", "text")


def learn(docs: DataFrame, modulus: int, held_out: int, size: int, max_train_per_lang: int,
          flush: int = 2_000_000) -> Profiles:
    """Profiles of ``size`` n-grams per language.  The counts are Spark sums over
    partial counts of each task (made for every ``flush`` code points); of equal
    counts the smaller code ranks first.  Only the profiles reach the driver."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, texts, held = letter_table(), {}, 0

        def counted():
            for lang, parts in texts.items():
                codes, n = np.unique(grams_of(np.concatenate(parts)), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                points = words_of(text, table)
                if len(points):
                    texts.setdefault(lang, [np.array([SPACE])]).append(points[1:])
                    held += len(points)
                if held >= flush:
                    yield from counted()
                    texts, held = {}, 0
        yield from counted()

    counts = (training_rows(docs, modulus, held_out, max_train_per_lang).mapInPandas(partial, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    grams: dict[str, list[int]] = {}
    for row in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        grams.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(grams, size)


def identify(docs: DataFrame, modulus: int = 4, held_out: int = 2, size: int = 400,
             max_train_per_lang: int = 20_000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin`` per row of ``docs``.

    Every whole text is compared with the profiles learned from at most about
    ``max_train_per_lang`` rows of each language outside the held-out fold (rows
    without an id or a language teach nothing; a language whose rows hold no letter
    has no profile).  ``score`` is 1 less the out-of-place distance to the
    nearest profile, ``margin`` its lead over the next.  Null text, and text
    without a letter, is ``und`` with score 0, as is every text when nothing was
    learned.  Of equally near languages the first by name wins.  A null
    ``doc_id`` is never in the held-out fold.  Repeated rows get equal results;
    no rows give none."""
    profiles = learn(docs, modulus, held_out, size, max_train_per_lang)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = letter_table()
        for batch in batches:
            found = [profiles.predict(grams_of(words_of(text, table))) for text in batch["text"]]
            lang, near, lead = zip(*found) if found else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "lang_pred": lang, "score": near, "margin": lead})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = rows.mapInPandas(score, "doc_id long, lang_pred string, score double, margin double")
    return out.select("doc_id", (fold_of(modulus) == held_out).alias("held_out"), "lang_pred", "score", "margin")
