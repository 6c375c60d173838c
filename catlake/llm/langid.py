"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its runs of one to four letters, word boundaries included, hashed
to 2**BITS rows of an embedding; the mean of their embeddings goes through a linear layer
and a softmax. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (``sample``), each with a few short windows of its text beside
the whole, so that short texts are known too. As both layers are linear, prediction
uses their product, one number for each row and language.

Calibration: a temperature is fitted on the windows of a tenth of the sampled documents,
none of which training sees; a text is rejected if its probability is under ``reject``,
or it has no letter.

Edge cases: null or letterless texts are "und" with score 0 and rejected; without any
labelled row every text is "und"; ties between languages go to the first in order of name;
a null id is outside the held-out fold; repeated rows are learned from once and each get
their prediction; empty tables give empty results; extra columns stay where rows are
returned whole and are ignored elsewhere, also with clashing names. Whole texts are read,
in blocks that end between words if very long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .characters import blocks, letters, mixed
from .common import bounded_sample, fold, kept_by, pick, with_made

BITS = 15
SAMPLE = 3000


def subwords(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs; None if there is no letter."""
    out = None
    for block in blocks(text):
        c = letters(block)
        if len(c) < 2:
            continue
        h, parts = c, []
        with np.errstate(over="ignore"):
            for n in range(1, 5):
                parts.append(mixed(h + np.uint32(n * 0x51ED27), BITS))
                if len(c) <= n:
                    break
                h = h[:-1] * np.uint32(0x01000193) ^ c[n:]
        counts = np.bincount(np.concatenate(parts), minlength=1 << BITS)
        if out is None:
            out = counts
        else:
            out += counts
    return out


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logits: np.ndarray  # bucket by language
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, text: str | None) -> tuple[str, float]:
        # Marks belong to words, but a text of marks alone has no letter.
        counts = subwords(text) if self.langs and any(map(str.isalpha, text or "")) else None
        if counts is None:
            return "und", 0.0
        at = np.flatnonzero(counts)
        z = (counts[at] @ self.logits[at] / counts.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.langs[int(p.argmax())], float(p.max())


def _examples(text: str) -> list[np.ndarray]:
    """The whole text and windows of several lengths at places given by its length."""
    out = [subwords(text)]
    for size, step in ((12, 3), (30, 5), (90, 7)):
        at = (len(text) * step // 11) if len(text) > 2 * size else 0
        out.append(subwords(text[at : at + size]))
    return [x for x in out if x is not None]


def _packed(counts: np.ndarray) -> bytes:
    """The buckets that occur, in two bytes each, and their shares."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + (counts[at] / counts.sum()).astype("<f4").tobytes()


def _unpacked(packed) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u2", n).astype(np.int64), np.frombuffer(packed, np.uint8, 4 * n, 2 * n).view("<f4")


def train(labelled: DataFrame, sample: int = SAMPLE, size: int = 16, epochs: int = 5, rate: float = 40.0, reject: float = 0.4, seed: int = 1) -> Model:
    """Fit on at most ``sample`` rows of (doc_id, text, lang); features are made on the executors."""

    @F.pandas_udf("array<binary>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([[_packed(x) for x in _examples(t)] for t in texts])

    rows = bounded_sample(pick(labelled, "doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL"), sample)
    # The sample is dealt out again, as its sort leaves it in one partition.
    made = rows.repartition(32, "doc_id", "text").select("doc_id", "lang", F.xxhash64("text").alias("hash"), F.posexplode(features("text")).alias("window", "x"))
    found = made.toArrow().combine_chunks().sort_by([(c, "ascending") for c in ("doc_id", "lang", "hash", "window")])
    langs = tuple(sorted(found["lang"].unique().to_pylist()))
    if not langs:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, reject)
    y = np.searchsorted(np.array(langs), found["lang"].to_numpy().astype(str))
    x = [v.as_buffer() for v in found["x"]]
    rng = np.random.default_rng(seed)
    document = np.cumsum(found["window"].to_numpy() == 0)
    apart = np.isin(document, rng.permutation(np.arange(1, document[-1] + 1))[: document[-1] // 10])
    seen, unseen = (np.flatnonzero(~apart), np.flatnonzero(apart)) if apart.any() else (np.arange(len(x)),) * 2
    e = rng.normal(0, 0.1, (1 << BITS, size)).astype(np.float32)
    w, b = np.zeros((size, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, k = epochs * len(seen), 0
    for _ in range(epochs):
        for i in rng.permutation(seen):
            at, share = _unpacked(x[i])
            mean = share @ e[at]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = np.float32(1 - k / steps)
            back = w @ p
            w -= lr * 0.2 * np.outer(mean, p)
            b -= lr * 0.02 * p
            e[at] -= np.float32(lr * rate * 0.2) * share[:, None] * back[None, :]
            k += 1
    product = e @ w
    raw = np.stack([s @ product[a] + b for a, s in (_unpacked(x[i]) for i in unseen)])

    def loss(t: float) -> float:
        z = raw / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), y[unseen]]).mean())

    return Model(langs, product, b, min((0.25 * 1.15**k for k in range(30)), key=loss), reject)


def classifier(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A text column's struct (lang_pred, score, rejected). The model's size is fixed by BITS and the number of languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def languages(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        found = [m.predict(x) for x in texts]
        return pd.DataFrame([(a, b, a == "und" or b < m.reject) for a, b in found], columns=["lang_pred", "score", "rejected"])

    return languages


def with_language(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """Every row with a struct (lang_pred, score, rejected) of its whole text."""
    return with_made(docs, text, to, classifier(docs.sparkSession, model))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language isn't rejected, with the columns they had."""
    return kept_by(docs, text, classifier(docs.sparkSession, model), "NOT _made.rejected")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    return with_language(pick(docs, "doc_id", "text"), model).select("doc_id", "language.*")


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Train on the rows outside the held-out fold and predict every row: (doc_id, held_out, lang_pred, score, rejected)."""
    rows = pick(docs, "doc_id", "text", "lang")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    return predict(rows, train(rows.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
