"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the mean, the eigenvalues and the eigenvectors of the scatter of its
vectors, and takes up one vector (a repeated one of a batch once, by its weight) by a centred
rank-one update: in the basis of the eigenvectors it solves the secular equation, after
deflation of what the vector doesn't change, and turns the basis. Spectra of partitions are
combined, a few at a time, by taking up the other's components and the difference of the
means as rank-one updates again. What that loses in digits is mended at the end by one
distributed Rayleigh-Ritz step: the covariance, exactly centred, projected on the basis
found, summed over all rows, and decomposed.

Vectors are taken as integers, floor(scale * entry) + shift, so that sums and squared
deviations are exact.

Edge cases: rows whose vector is null, empty, or holds a null or non-finite entry, or one of
2^32 or more in size, which the integers can't hold, take no part; where lengths differ, the
commonest one counts (of equally common ones the longest), as vectors of different lengths
have no covariance; null and repeated ids and repeated rows are rows of their own; a component
without spread has null ``whitened``, explains 0 and is left out of the identity; one row, or
equal ones, have no spread at all, and ``explained`` is null; a vector of fewer entries than
``components`` has as many components as entries; an empty table gives an empty result; extra
columns, also with clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialize, pick

SCALE, SHIFT = 1024, 100_000
#: Entries of this size or more have no place in the integers.
LARGEST = float(1 << 32)
#: Spectra that one task combines.
FAN_IN = 16
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - root) = 0 for rising, different d and positive z2.

    Each root lies between its d and the next (the last one below d + sum z2). Returns the
    nearer of the two as the origin, and the root's distance from it, which keeps the
    differences d - root exact where they are small. All roots take their steps at once: a
    step solves the equation with the two nearest poles kept and the rest as a constant, and
    falls back to bisection of the bracket.
    """
    n = len(d)
    above = np.append(d[1:], d[-1] + z2.sum())
    gap = above - d
    f_mid = 1 + (z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    right = (f_mid < 0) & (np.arange(n) < n - 1)
    origin = np.where(right, above, d)
    delta = d[None, :] - origin[:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(f_mid < 0, gap, gap / 2))
    low = np.where(~right & (f_mid < 0), gap / 2, low)
    tau = (low + high) / 2
    own, after = d - origin, above - origin
    left_side = np.tri(n, dtype=bool)
    live = np.arange(n)
    for _ in range(80):
        if not len(live):
            break
        t, diff = tau[live], delta[live] - tau[live][:, None]
        terms = z2 / diff
        f = 1 + terms.sum(1)
        slope = terms / diff
        psi = np.where(left_side[live], slope, 0).sum(1)
        phi = slope.sum(1) - psi
        up = f < 0
        low[live[up]], high[live[~up]] = t[up], t[~up]
        noise = EPS * n * (1 + np.abs(terms).sum(1))
        a1, a2 = own[live] - t, after[live] - t
        c = f - a1 * psi - a2 * phi
        a = (a1 + a2) * f - a1 * a2 * (psi + phi)
        b = a1 * a2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t + step
        bad = ~np.isfinite(new) | (new <= low[live]) | (new >= high[live])
        new = np.where(bad, (low[live] + high[live]) / 2, new)
        done = (np.abs(f) <= noise) | (new == t) | (high[live] - low[live] <= 2 * EPS * np.maximum(np.abs(low[live]), np.abs(high[live])))
        tau[live[~done]] = new[~done]
        live = live[~done]
    return origin, tau


@dataclass
class Spectrum:
    """Count, mean, and eigenvalues (rising) and eigenvectors (columns) of the scatter about the mean."""

    n: float
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0.0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray, weight: float = 1.0) -> None:
        """Take up ``weight`` copies of a vector: a rank-one update about the new mean."""
        off, total = x - self.mean, self.n + weight
        if self.n:
            self.update(off, self.n * weight / total)
        self.mean = self.mean + off * (weight / total)
        self.n = total

    def combine(self, other: Spectrum) -> None:
        """Take up another spectrum, one component at a time, and the difference of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.update(vector, value)
        off, total = other.mean - self.mean, self.n + other.n
        if self.n:
            self.update(off, self.n * other.n / total)
        self.mean = self.mean + off * (other.n / total)
        self.n = total

    def update(self, v: np.ndarray, weight: float) -> None:
        """Add weight * v v' to the scatter."""
        d, q = self.values, self.vectors
        z = (v @ q) * np.sqrt(weight)
        size = np.sqrt(z @ z)
        if not size:
            return
        small = 8 * EPS * max(d[-1], size * size)
        # Deflation: where eigenvalues agree, a rotation leaves all of z on one of them; what z doesn't reach stays as it is.
        for i in np.flatnonzero(np.diff(d) <= small).tolist():
            r = np.hypot(z[i], z[i + 1])
            if r:
                c, s = z[i + 1] / r, z[i] / r
                q[:, [i, i + 1]] = np.column_stack([c * q[:, i] - s * q[:, i + 1], s * q[:, i] + c * q[:, i + 1]])
                z[i], z[i + 1] = 0.0, r
        live = np.flatnonzero(np.abs(z) * size > small)
        dl, zl = d[live], z[live]
        if len(live) == 1:
            d[live] += zl * zl
        elif len(live):
            origin, tau = secular_roots(dl, zl * zl)
            diff = (dl[None, :] - origin[:, None]) - tau[:, None]  # [root, pole]: d - root
            # The vector of which these roots are exact (Gu and Eisenstat) keeps the eigenvectors orthogonal.
            ratio = -diff / np.where(np.eye(len(dl), dtype=bool), 1.0, dl[None, :] - dl[:, None])
            z_hat = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(zl)
            w = z_hat[None, :] / diff
            w /= np.sqrt((w * w).sum(1))[:, None]
            q[:, live] = q[:, live] @ w.T
            d[live] = origin + tau
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = np.maximum(d[order], 0), q[:, order]


def integers(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the rows that take part, and their integers."""
    at = np.array([i for i, n in enumerate(pc.list_value_length(vectors).to_pylist()) if n == length], np.int64)
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), length)
    fit = (np.abs(x) < LARGEST).all(1)
    return at[fit], np.floor(x[fit] * SCALE).astype(np.int64) + SHIFT


def _length(vectors: DataFrame) -> int | None:
    """The commonest number of entries of the vectors that take part; of equally common ones the largest."""
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    row = vectors.filter(F.coalesce(good, F.lit(False)) & (F.size("vector") > 0)).groupBy(F.size("vector").alias("size")).count()
    row = row.agg(F.max(F.struct("count", "size")).alias("best")).first()
    return row["best"]["size"] if row["best"] else None


_NUMBERS = T.ArrayType(T.DoubleType())
_SPECTRUM = (
    T.StructType().add("part", "long").add("n", "long").add("sums", T.ArrayType(T.DecimalType(38, 0)))
    .add("mean", _NUMBERS).add("eigenvalues", _NUMBERS).add("eigenvectors", _NUMBERS)
)


def _spectra(vectors: DataFrame, length: int) -> DataFrame:
    """One row a partition: its count, exact sums and spectrum, about the vector SHIFT."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = Spectrum.empty(length), np.zeros(length, object)
        for batch in batches:
            _, x = integers(batch.column(1), length)
            if len(x):
                different, counts = np.unique(x, axis=0, return_counts=True)
                sums = sums + x.sum(0).astype(object)
                for row, n in zip((different - SHIFT).astype(float), counts.tolist(), strict=True):
                    own.add(row, n)
        if own.n:
            row = [TaskContext.get().partitionId(), int(own.n), [Decimal(int(s)) for s in sums], own.mean, own.values, own.vectors.ravel()]
            yield pa.RecordBatch.from_pylist([dict(zip(_SPECTRUM.names, row, strict=True))], schema=arrow)

    arrow = to_arrow_schema(_SPECTRUM)
    return vectors.mapInArrow(of_partition, _SPECTRUM)


def _read(row) -> Spectrum:
    size = len(row["mean"])
    return Spectrum(float(row["n"]), np.array(row["mean"], float), np.array(row["eigenvalues"], float), np.array(row["eigenvectors"], float).reshape(size, size))


def _combined(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("part").to_dict("records")
    own = _read(rows[0])
    for row in rows[1:]:
        own.combine(_read(row))
    sums = [sum(x, start=rows[0]["sums"][0] * 0) for x in zip(*(r["sums"] for r in rows), strict=True)]
    return pd.DataFrame([[key[0], int(own.n), sums, own.mean, own.values, own.vectors.ravel()]], columns=_SPECTRUM.names)


def _summed(vectors: DataFrame, length: int, of) -> np.ndarray:
    """The sum over all rows of the matrices that ``of`` makes of blocks of integers; partitions' sums are added up in Spark, by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, x = integers(batch.column(1), length)
            for k in range(0, len(x), 4096):
                part = of(x[k : k + 4096])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["entry", "value"])

    entries = vectors.mapInArrow(partial, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    return np.array([r["value"] for r in sorted(entries.collect())])  # one number an entry of the matrix, whatever the rows


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, components as columns (falling eigenvalue), eigenvalues and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        """Whitened rows: centred exactly as n * x - sums where that fits, then projected and scaled; no spread gives NaN."""
        q = self.vectors[:, :components]
        e = self.values[:components]
        with np.errstate(all="ignore"):
            return (self.centred(x) @ q) / np.where(e > 0, np.sqrt(e), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - sums)^2, exact."""
        near = np.abs(self.centred(x)).max(initial=0) * self.n
        if near * near * x.shape[1] < 2.0**62 and abs(self.n) * (np.abs(x).max(initial=0) + 1) < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return (off * off).sum(1).tolist()
        return [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def fit(vectors: DataFrame, length: int) -> Whitening:
    """The whitening of (id, vector)."""
    now = materialize(_spectra(vectors, length), "spectra")
    count = now.count()
    while count > 1:
        now = materialize(now.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(_combined, _SPECTRUM), "spectra")
        count = now.count()
    row = now.first()
    found = _read(row)
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    first = Whitening(row["n"], [int(s) for s in row["sums"]], basis, found.values, 0.0)

    def projected(x: np.ndarray) -> np.ndarray:
        y = first.centred(x) @ basis
        return y.T @ y

    ritz = _summed(vectors, length, projected).reshape(length, length) / first.n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values = np.where(values > EPS * length * max(values[-1], 0.0), values, 0.0)
    return Whitening(first.n, first.sums, basis @ turn[:, ::-1], values[::-1], float(np.trace(ritz)))


def identity_error(vectors: DataFrame, length: int, model: Whitening, components: int) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured over all rows; null without any spread."""
    k = int((model.values[:components] > 0).sum())
    if not k:
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        y = np.column_stack([model.project(x, k), np.ones(len(x))])
        return y.T @ y

    m = _summed(vectors, length, moments).reshape(k + 1, k + 1) / model.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that takes part; deviation is a decimal."""
    rows = pick(vectors, id_column, vector_column).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    out = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), *T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    length = _length(rows)
    if length is None:
        return rows.sparkSession.createDataFrame([], out)
    model, k = fit(rows, length), min(components, length)
    error = identity_error(rows, length, model, k)
    share = (model.values[:k] / model.trace).tolist() if model.trace > 0 else [None] * k

    arrow = to_arrow_schema(out)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), length)
            n = len(at)
            deviation = [Decimal(d) for d in model.deviations(x) for _ in range(k)]
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, model.n)),
                pa.array(deviation, arrow.field("deviation").type), pa.array(model.project(x, k).ravel(), from_pandas=True),
                pa.array(share * n, pa.float64()), pa.array([error] * (n * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(apply, out)
