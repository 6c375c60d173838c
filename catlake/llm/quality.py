"""Quality classifier by Bradley-Terry pairwise ranking.

Features of a whole text: the shares of the trigrams of its character classes, the shares
of words that equal the one before, that occurred before, and of lines that occurred
before, and the longest run of one word; shares by their square roots, so that a spoilt
part shows in a long text. Preference pairs (a document of label 1, one of label 0) are
drawn from a bounded sample of labelled rows (``sample``), and the weights learn by the
logistic loss on the differences of features. The threshold is the quantile of the
sample's scores at its share of label 0; a document's score is the logistic function of
its distance to the threshold.

Edge cases: null and empty texts have features too (all zero) and get a score; if only
one label is known, every score is 1 or 0 accordingly, and 0.5 without any label; repeated
rows are learned from once and each get their score; a null id is outside the held-out
fold and never labelled; empty tables give empty results; extra columns stay where rows
are returned whole and are ignored elsewhere, also with clashing names. Very long texts
are read in blocks that end between words; trigrams across their ends aren't counted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .characters import blocks, classes, points
from .common import fold, kept_by, labelled_sample, pick, with_made

SAMPLE = 6000
_GRAMS, _MORE = 12**3, 4


def features(text: str | None) -> np.ndarray:
    text = text or ""
    counts = np.zeros(_GRAMS)
    for block in blocks(text):
        c = classes()[points(block)].astype(np.int32)
        if len(c) > 2:
            counts += np.bincount((c[:-2] * 12 + c[1:-1]) * 12 + c[2:], minlength=_GRAMS)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    same = list(map(eq, words, islice(words, 1, None)))
    run = longest = 0
    for x in same:
        run = run + 1 if x else 0
        longest = max(longest, run)
    more = [sum(same) / n, (len(words) - len(set(words))) / n * 0.1, (len(lines) - len(set(lines))) / max(1, len(lines)), min(1.0, longest / 8) ** 2]
    return np.sqrt(np.concatenate([counts / max(1, counts.sum()), more])).astype(np.float32)


def _packed(x: np.ndarray) -> bytes:
    """The places of the features that aren't zero, in two bytes each, and these features."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float

    def score(self, text: str | None) -> float:
        z = float(self.weights @ features(text)) - self.threshold
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 30, batch: int = 256, rate: float = 1.0, decay: float = 1e-4, seed: int = 3) -> Model:
    """Fit on ``sample`` rows at most of (doc_id, text, label); features are made on the executors."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([_packed(features(x)) for x in texts])

    made = labelled.select("doc_id", "label", packed("text").alias("x")).dropDuplicates()
    rows = made.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "label", "x").limit(sample).toArrow()
    width = _GRAMS + _MORE
    x = np.zeros((rows.num_rows, width), np.float32)
    for into, packed_row in zip(x, rows["x"], strict=True):
        data = packed_row.as_buffer()
        n = len(data) // 6
        into[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, np.uint8, 4 * n, 2 * n).view("<f4")
    y = rows["label"].to_numpy() == 1
    good, bad = np.flatnonzero(y), np.flatnonzero(~y)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), 0.0 if not len(y) else -40.0 if len(good) else 40.0)
    rng, w, speed = np.random.default_rng(seed), np.zeros(width), np.full(width, 1e-8)
    for _ in range(epochs * (min(len(y), sample) // batch + 1)):
        d = x[rng.choice(good, batch)] - x[rng.choice(bad, batch)]
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        g = -(p @ d) / batch + decay * w
        speed += g * g
        w -= rate * g / np.sqrt(speed)
    scores = x @ w
    return Model(w, float(np.quantile(scores, len(bad) / len(y), method="midpoint")))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A text column's score; the model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(x) for x in texts], dtype="float64")

    return scores


def with_quality(docs: DataFrame, model: Model, text: str = "text", to: str = "quality") -> DataFrame:
    """Every row with the score of its whole text."""
    return with_made(docs, text, to, scorer(docs.sparkSession, model))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that score 0.5 or more, with the columns they had."""
    return kept_by(docs, text, scorer(docs.sparkSession, model), "_made >= 0.5")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    out = with_quality(pick(docs, "doc_id", "text"), model, to="score").select("doc_id", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def known_labels(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """The bounded sample of labelled documents outside the held-out fold."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return labelled_sample(docs, pick(labels, "doc_id", "quality").filter(~out), "quality", sample)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Learn labels outside the held-out fold and score every row: (doc_id, held_out, score, predicted)."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return score(docs, train(known_labels(docs, labels, folds, held, sample), sample)).select("doc_id", out.alias("held_out"), "score", "predicted")
