"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics.  Each class gets a
Gaussian whose covariance is shrunk towards the pooled diagonal; the score is a
logistic function of the Mahalanobis log-density difference, computed with one
Cholesky factor per class that is cached in the model.  The class moments and
every step of the logistic fit are plain Spark sums over all training rows; only
the sums reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, labelled_rows, labelled_sample, small_side, stored, text_or_empty

SYMBOLS = b"*&%$#|!@^~<>{}[]=+\\_/"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
STOPS = b".,;:?"
NAMES = ["words", "word_length", "symbols", "upper", "digits", "stops", "repeats", "distinct", "solo",
         "squeeze", "lines_again", "letters"]
SIZE = len(NAMES)
BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of one whole UTF-8 text.  Shares are smoothed by a
    few pseudo-counts, so a very short text stays near the middle."""
    words = raw.split()
    n, size = len(words), len(raw)
    lower = raw.lower()
    share = lambda count, of, soft, prior: ((count + soft * prior) / (of + soft)) ** 0.5
    without = lambda chars: size - len(raw.translate(None, chars))
    tokens = lower.split()
    repeats = sum(map(bytes.__eq__, tokens, tokens[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = without(LETTERS)
    squeezed = len(zlib.compress(lower[:1 << 20], 1)) if size <= 1 << 20 else sum(
        len(zlib.compress(lower[i:i + (1 << 20)], 1)) for i in range(0, size, 1 << 20))
    return [
        np.log1p(n),
        np.log((size - n + 15.0) / (n + 3.0)),
        share(without(SYMBOLS), size, 30, 0.001),
        share(without(UPPER), size, 30, 0.02),
        share(without(DIGITS), size, 30, 0.002),
        share(without(STOPS), size, 30, 0.03),
        share(repeats, n, 5, 0.01),
        np.log((len(set(tokens)) + 3.0) / (n + 3.0) ** 0.9),
        share(sum(1 for t in tokens if len(t) == 1), n, 5, 0.03),
        np.log((squeezed + 30.0) / (size + 60.0)),
        share(len(lines) - len(set(lines)), len(lines), 3, 0.01),
        share(letters, size, 30, 0.8),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (the statistics) per row; null text counts as empty."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "x": [statistics(raw) for raw in batch["raw"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("raw"))
    return rows.mapInPandas(measure, "doc_id long, x array<double>")


@dataclass
class QuadraticModel:
    """Means, Cholesky factors and log-determinants by class (0, 1), and the
    logistic map of the log-density difference."""
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    scale: float
    offset: float
    prior: float | None = None      # set where training saw no second class

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        out = []
        for c in (0, 1):
            z = np.linalg.solve(self.factors[c], (x - self.means[c]).T)
            out.append(-0.5 * (z * z).sum(axis=0) - 0.5 * self.log_dets[c])
        return out[1] - out[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * self.log_ratio(x) + self.offset, -700, 700)))


def fit(features: DataFrame, training: DataFrame, shrinkage: float = 0.2) -> QuadraticModel:
    """Class moments and logistic map over every training row (``doc_id, label``) with features."""
    rows = stored(features.join(training, "doc_id").select("x", "label"), "quality-train")
    x = [F.col("x")[i] for i in range(SIZE)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(SIZE) for j in range(i + 1)]
    moments = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect()}
    if len(moments) < 2:
        only = next(iter(moments), None)
        none = np.zeros((2, SIZE))
        return QuadraticModel(none, none, none, 0.0, 0.0, 0.5 if only is None else 0.99 * only + 0.005)
    means, covs, counts = [], [], []
    for c in (0, 1):
        n, s = moments[c]["n"], np.array(moments[c]["s"])
        mean, second = s[:SIZE] / n, np.zeros((SIZE, SIZE))
        second[np.tril_indices(SIZE)] = s[SIZE:] / n
        second = second + np.tril(second, -1).T
        means.append(mean), covs.append(second - np.outer(mean, mean)), counts.append(n)
    pooled = np.diag(sum(n * np.diag(c) for n, c in zip(counts, covs)) / sum(counts) + 1e-6)
    covs = [(1 - g) * c + g * pooled for n, c in zip(counts, covs) for g in [max(shrinkage, SIZE / (n + SIZE))]]
    factors = np.array([np.linalg.cholesky(c) for c in covs])
    log_dets = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    model = QuadraticModel(np.array(means), factors, log_dets, 1.0, 0.0)

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), SIZE)
            yield pd.DataFrame({"z": model.log_ratio(x), "y": batch["label"].astype(float)})

    model.scale, model.offset = logistic(stored(rows.mapInPandas(ratios, "z double, y double"), "quality-ratios"), sum(counts))
    return model


def logistic(rows: DataFrame, n: int, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a ridge-regularised one-variable logistic fit over all
    ``n`` rows (``z, y``).  Slopes and curvatures are Spark sums, one pass a step;
    the median of ``|z|``, exact up to a million rows, only sets the unit."""
    places = [((n + 1) // 2 - 0.5) / n, (n // 2 + 0.5) / n]
    width = max(1.0, float(np.mean(rows.agg(F.percentile_approx(F.abs("z"), places, 1_000_000)).first()[0])))
    clip = lambda x: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))
    t = clip(F.col("z") / width)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-clip(t * float(w[0]) + float(w[1]))))
        at = rows.select(t.alias("t"), (p - F.col("y")).alias("r"), (p * (1 - p)).alias("v"))
        s = at.agg(*map(F.sum, [F.col("t") * F.col("r"), F.col("r"), F.col("t") * F.col("t") * F.col("v"),
                                F.col("t") * F.col("v"), F.col("v")])).first()
        g = np.array(s[:2]) + 1e-2 * w
        h = np.array([[s[2], s[3]], [s[3], s[4]]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-6) / width, float(w[1])


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = 0.5,
                   max_train_per_class: int = 1_000_000_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Learns from labelled rows outside the held-out fold only; labels, language,
    source and id are no inputs of a score.  Null or empty text is scored like
    any other; a null ``doc_id`` is never in the held-out fold.  Without labels
    every score is 0.5, with labels of one class near that class.  Repeated
    rows get equal scores; no rows give none."""
    features = stored(document_statistics(docs), "quality-features")
    training, _ = labelled_sample(labels, "quality", modulus, held_out, max_train_per_class)
    model = fit(features, training)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), float).reshape(len(batch), SIZE)
            p = model.score(x)
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": p, "predicted": (p >= threshold).astype(np.int32)})

    out = features.mapInPandas(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", (fold_of(modulus) == held_out).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows the classifier rejects.  A row is scored by its
    own text, so rows that repeat an id are judged one by one."""
    training = stored(labelled_rows(labels, "quality", modulus, held_out), "quality-labels")
    learn = docs.join(small_side(training), "doc_id", "left_semi")
    model = fit(document_statistics(learn), training)

    @F.pandas_udf("boolean")
    def good(raw: pd.Series) -> pd.Series:
        x = np.array([statistics(r) for r in raw], float).reshape(len(raw), SIZE)
        return pd.Series(model.score(x) >= threshold)

    return docs.where(good(text_or_empty().cast("binary")))
