"""Toxicity by a factorization machine over hashed terms.

Terms of a whole text: its lower-cased words (runs of letters) and their first four, five
and six letters, hashed to 32-bit numbers; each counts once a text. On a bounded sample
of labelled rows (``sample``), the ``terms`` that differ most between the labels, measured
in standard errors, are selected; a factorization machine with a weight and ``rank``
factors for each learns additive and pairwise effects by the logistic loss.

Edge cases: null, empty and letterless texts have no terms, and get the score of the
machine's bias; without both labels every score is the share of toxic rows (0 if there are
none); repeated rows are learned from once and each get their score; a null id is outside
the held-out fold and never labelled; empty tables give empty results; extra columns stay
where rows are returned whole and are ignored elsewhere, also with clashing names. Very
long texts are read in blocks that end between words; a word longer than a block counts in
each of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .characters import blocks, letters
from .common import fold, labelled_sample, materialize, pick, with_made

SAMPLE = 20_000


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[1], np.full(n, 0x01000193)]).astype(np.uint32), dtype=np.uint32)


_POWER = _powers(64)


def terms(text: str | None) -> np.ndarray:
    """The different hashed terms, sorted."""
    found = []
    for block in blocks(text):
        c = letters(block)
        gap = np.flatnonzero(c == 32)
        start = gap[:-1] + 1
        start = start[start < gap[1:]]
        if not len(start):
            continue
        at = np.arange(len(c)) - np.maximum.accumulate(np.where(c == 32, np.arange(len(c)), 0)) - 1  # place in the word
        with np.errstate(over="ignore"):
            value = np.where(c == 32, 0, c * _POWER[np.minimum(at, 63)]).astype(np.uint32)
            whole = np.add.reduceat(value, start)
            found.append(whole * np.uint32(3))
            for size in (4, 5, 6):
                found.append(np.add.reduceat(np.where(at < size, value, 0).astype(np.uint32), start) + np.uint32(size))
    if not found:
        return np.zeros(0, np.int32)
    with np.errstate(over="ignore"):
        numbers = np.sort(np.concatenate(found).astype(np.uint32).view(np.int32))
    return numbers[np.append(True, numbers[1:] != numbers[:-1])]


@dataclass(frozen=True)
class Model:
    chosen: np.ndarray  # sorted term numbers
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def places(self, found: np.ndarray) -> np.ndarray:
        if not len(self.chosen):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.chosen, found), len(self.chosen) - 1)
        return at[self.chosen[at] == found]

    def score(self, text: str | None) -> float:
        at = self.places(terms(text))
        v = self.factors[at]
        z = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, n, t): how many rows, and how many toxic ones, have each term of ``found``; combined in each batch before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, length = b.column(0).flatten().to_numpy(), b.column(0).value_lengths().to_numpy()
            order = np.argsort(found, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(found[order]) != 0)) if len(found) else order
            toxic = np.repeat(b.column(1).to_numpy(), length)[order].astype(np.int64)
            n = np.diff(np.append(first, len(found)))
            t = np.add.reduceat(toxic, first) if len(first) else toxic
            yield pa.RecordBatch.from_arrays([pa.array(found[order][first], pa.int32()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], ["term", "n", "t"])

    parts = rows.select("found", "label").mapInArrow(counted, "term int, n long, t long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def select_terms(rows: DataFrame, total: int, toxic: int, most: int, least_docs: int = 3) -> np.ndarray:
    """The terms whose share of toxic documents is most standard errors from that of all."""
    share = toxic / total
    error = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    ranked = count_terms(rows).filter(F.col("n") >= least_docs).withColumn("error", F.abs(error)).filter("error >= 4")
    return np.sort(ranked.orderBy(F.desc("error"), "term").limit(most).toPandas()["term"].to_numpy().astype(np.int32))


def train(labelled: DataFrame, sample: int = SAMPLE, most: int = 2048, rank: int = 8, epochs: int = 60, batch: int = 128, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Model:
    """Fit on ``sample`` rows at most of (doc_id, text, label); terms are found and counted on the executors."""
    empty = np.zeros(0, np.int32)

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(x) for x in texts])

    # Written once: the terms are read three times, and making them costs most.
    rows = labelled.select("doc_id", "label", F.xxhash64("text").alias("hash"), hashed("text").alias("found"))
    rows = materialize(rows.dropDuplicates(["doc_id", "label", "hash"]), "terms")
    both = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if both[1] in (0, both[0]):
        return Model(empty, 40.0 if both[1] else -40.0, np.zeros(0), np.zeros((0, rank)))
    chosen = select_terms(rows, both[0], both[1], most)
    lookup = Model(chosen, 0.0, np.zeros(len(chosen)), np.zeros((len(chosen), rank)))

    @F.pandas_udf("array<int>")
    def selected(found: pd.Series) -> pd.Series:
        return pd.Series([lookup.places(np.asarray(x)).astype(np.int32) for x in found])

    data = rows.select("doc_id", "label", "hash", selected("found").alias("at")).orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash", "label").limit(sample).toPandas()
    y = data["label"].to_numpy().astype(float)
    lists = [np.asarray(x, np.int64) for x in data["at"]]
    k, rng = len(chosen), np.random.default_rng(seed)
    v, w, b = rng.normal(0, 0.01, (k + 1, rank)), np.zeros(k + 1), float(np.log(y.mean() / (1 - y.mean())))
    v[k] = 0  # the last row ends every list, so that none is empty
    lists = [np.append(x, k) for x in lists]
    length = np.asarray([len(x) for x in lists])
    gw, gv, gb = np.full(k + 1, 1e-8), np.full((k + 1, rank), 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            rows_ = order[i : i + batch]
            at, n = np.concatenate([lists[r] for r in rows_]), length[rows_]
            start, vs = np.cumsum(n) - n, v[at]
            total = np.add.reduceat(vs, start)
            z = b + np.add.reduceat(w[at], start) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vs**2).sum(1), start))
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows_]) / len(rows_)
            # Of one term, all documents pull at the same factors, so those are taken off once.
            pull = np.bincount(at, np.repeat(e, n), k + 1)
            pulls = np.stack([np.bincount(at, np.repeat(x, n), k + 1) for x in (e[:, None] * total).T], 1)
            dw, dv = pull + decay * w, pulls - v * pull[:, None] + decay * v
            dw[k], dv[k] = 0, 0
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + e.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= 0.2 * rate * dv / np.sqrt(gv)
            b -= rate * e.sum() / np.sqrt(gb)
    return Model(chosen, b, w[:k], v[:k])


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A text column's score; the model has a fixed size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(x) for x in texts], dtype="float64")

    return scores


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", to: str = "toxicity") -> DataFrame:
    """Every row with the score of its whole text."""
    return with_made(docs, text, to, scorer(docs.sparkSession, model))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    out = with_toxicity(pick(docs, "doc_id", "text"), model, to="score").select("doc_id", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Learn labels outside the held-out fold and score every row: (doc_id, held_out, score, predicted)."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    known = labelled_sample(docs, pick(labels, "doc_id", "toxic").filter(~out), "toxic", sample)
    return score(docs, train(known, sample)).select("doc_id", out.alias("held_out"), "score", "predicted")
