"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Text is folded first (case, homoglyphs, digit substitutions, separators), so
that disguised spellings meet the lexicon.  The lexicon is learned: stems
(prefixes of words, or whole words) whose log-odds between toxic and clean
training documents is high, short stems first, with their log-odds as weight.  A document's weights are summed over the matches of one
automaton pass, matches inside exception phrases excluded, normalised by length
and mapped to a probability by a logistic fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_sample, small_side, stored, text_or_empty

# Cyrillic and Greek letters drawn like Latin ones.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
              "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t",
              "υ": "u", "ν": "v", "κ": "k", "ι": "i"}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e"}
FULL_WIDTH = {0xFF21 + i: chr(ord("a") + i) for i in range(26)} | {0xFF41 + i: chr(ord("a") + i) for i in range(26)}
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], None)
FOLD = str.maketrans(HOMOGLYPHS) | FULL_WIDTH | INVISIBLE | str.maketrans(SUBSTITUTES)
BREAKS = re.compile(r"[\W_]+")

#: Harmless phrases that hold words such a lexicon often learns.
EXCEPTIONS = ("trash can", "trash bin", "clown fish")
MIN_STEM, MAX_STEM = 4, 10


def folded(text: str) -> str:
    """Lower-cased, folded words between single spaces, a space at both ends."""
    return f" {BREAKS.sub(' ', text.lower().translate(FOLD)).strip()} "


def stems(words: set[str]) -> set[str]:
    """Candidate entries of a document: word prefixes, and whole words closed by a space."""
    out = {w + " " for w in words if len(w) > 2}
    for w in words:
        out.update(w[:k] for k in range(MIN_STEM, min(MAX_STEM, len(w)) + 1))
    return out


class Lexicon:
    """Weighted entries and exception phrases, compiled once per task."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str]):
        self.weights, self.exceptions, self.automaton = weights, exceptions, None

    def __getstate__(self):
        return self.weights, self.exceptions, None

    def __setstate__(self, state):
        self.weights, self.exceptions, self.automaton = state

    def matches(self, text: str) -> Iterator[tuple[float, str, str]]:
        """Weight and the two phrases (with the word before, with the word after)
        of every word of the folded ``text`` that an entry matches; a word counts
        once, by its heaviest entry."""
        if not self.weights or len(text) < 3:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.automaton.add_word(" " + entry, (len(entry), weight))
            self.automaton.make_automaton()
        best: dict[int, float] = {}
        for end, (size, weight) in self.automaton.iter(text):
            start = end - size + 1
            best[start] = max(weight, best.get(start, weight))
        for start, weight in best.items():
            stop = text.index(" ", start)
            before = text[text.rfind(" ", 0, start - 1) + 1:stop] if start > 1 else ""
            after = text[start:text.index(" ", stop + 1)] if stop < len(text) - 1 else ""
            yield weight, before, after

    def features(self, text: str) -> tuple[float, float]:
        """Log of the summed weight, and of that weight per 100 words; a word that
        a text repeats counts once, so mere repetition does not add up."""
        line = folded(text)
        words = {a.rpartition(" ")[2] or b.partition(" ")[0]: w for w, a, b in self.matches(line)
                 if w > 0 and a not in self.exceptions and b not in self.exceptions}
        total = sum(words.values())
        return float(np.log1p(total)), float(np.log1p(100.0 * total / (line.count(" ") + 20.0)))


def count_entries(rows: DataFrame) -> DataFrame:
    """``entry, toxic, clean``: training documents (``text, label``) of either class that hold each entry."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def drain() -> pd.DataFrame:
            entries = list(seen[1] | seen[0])
            out = pd.DataFrame({"entry": entries, "toxic": [seen[1][e] for e in entries], "clean": [seen[0][e] for e in entries]})
            seen[0].clear(), seen[1].clear()
            return out.astype({"entry": str, "toxic": "int64", "clean": "int64"})

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                seen[label].update(stems(set(folded(text).split())))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield drain()
        yield drain()

    counted = rows.select("text", "label").mapInPandas(count, "entry string, toxic long, clean long")
    return counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame, min_documents: int, min_log_odds: float, max_entries: int) -> dict[str, float]:
    """Entries by log-odds from training rows (``text, label``); an entry
    that only lengthens a kept one stays where its odds are clearly higher."""
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return {}
    weight = F.ln((F.col("toxic") + 0.1) / (toxic + 1.0)) - F.ln((F.col("clean") + 0.1) / (clean + 1.0))
    telling = (count_entries(rows).where(F.col("toxic") >= min_documents).withColumn("weight", weight)
               .where(F.col("weight") >= min_log_odds)
               .orderBy(F.desc(F.col("toxic") * F.col("weight")), "entry").limit(5 * max_entries).collect())
    seen = {r["entry"]: r["toxic"] for r in telling}
    odds = {r["entry"]: r["weight"] for r in telling}
    kept: list[str] = []
    reach: dict[str, float] = {}        # best odds among an entry's kept beginnings and itself
    for e in sorted(odds, key=len):
        shorter = max((reach.get(e[:k], 0.0) for k in range(MIN_STEM, len(e))), default=0.0)
        if odds[e] >= shorter + (1.0 if shorter else 0.0):
            kept.append(e)
            reach[e] = odds[e]
    kept.sort(key=lambda e: (-seen[e] * odds[e], e))
    return {e: odds[e] for e in kept[:max_entries]}


def learn_exceptions(rows: DataFrame, lexicon: Lexicon, min_documents: int) -> frozenset[str]:
    """Two-word phrases around matches that clean training documents use and toxic ones never do."""
    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, int(y)) for text, y in zip(batch["text"], batch["label"])
                     for p in {p for _, a, b in lexicon.matches(folded(text)) for p in (a, b) if p}]
            yield pd.DataFrame(found, columns=["phrase", "label"]).astype({"phrase": str, "label": "int32"})

    counted = (rows.select("text", "label").mapInPandas(phrases, "phrase string, label int").groupBy("phrase")
               .agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).where((F.col("toxic") == 0) & (F.col("n") >= min_documents)))
    return frozenset(r["phrase"] for r in counted.collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge-regularised logistic regression with an intercept in the last place."""
    t = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(t.shape[1])
    ridge = np.diag([0.05] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(t @ w, -30, 30)))
        step = np.linalg.solve((t * (weight * p * (1 - p))[:, None]).T @ t + ridge, t.T @ (weight * (p - y)) + ridge @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3,
                    max_train_per_class: int = 10_000, min_documents: int = 3, min_log_odds: float = 3.0,
                    max_entries: int = 20_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    The lexicon and the logistic map are learned from at most about
    ``max_train_per_class`` labelled documents of each class outside the held-out
    fold (two thirds of them give the entries, the rest the map).  Every whole
    text is scored; labels, language, source and id are no inputs.  Null or
    empty text scores like text without a match.  Without labels of both
    classes every score is the share of toxic labels (0 without labels).
    Repeated rows get equal scores; no rows give none."""
    sample, shares = labelled_sample(labels, "toxic", modulus, held_out, max_train_per_class)
    sample = stored(sample, "toxic-labels")
    train = stored(docs.select(F.col("doc_id"), text_or_empty().alias("text")).join(small_side(sample), "doc_id")
                   .select("text", "label", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")), F.lit(3)) < 2).alias("entries")),
                   "toxic-train")
    words, rest = train.where("entries"), train.where("NOT entries")
    weights = learn_lexicon(words, min_documents, min_log_odds, max_entries)
    lexicon = Lexicon(weights, frozenset())
    lexicon = Lexicon(weights, frozenset(exceptions) | (learn_exceptions(words, lexicon, min_documents) if weights else frozenset()))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(*lexicon.features(t), float(y)) for t, y in zip(batch["text"], batch["label"])], columns=["a", "b", "y"])

    seen = rest.select("text", "label").mapInPandas(measure, "a double, b double, y double").collect()
    y = np.array([r["y"] for r in seen])
    if len(set(y)) < 2:
        model = np.array([0.0, 0.0, 20.0 if len(y) and y[0] else -20.0])
    else:
        weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        model = fit_logistic(np.array([[r["a"], r["b"]] for r in seen]), y, weight)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch["text"]]).reshape(len(batch), 2)
            p = 1 / (1 + np.exp(-np.clip(x @ model[:2] + model[2], -700, 700)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": p, "predicted": (p >= threshold).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return (rows.mapInPandas(score, "doc_id long, score double, predicted int")
            .select("doc_id", (fold_of(modulus) == held_out).alias("held_out"), "score", "predicted"))
