"""Whitening against exact integer sums and a dense eigendecomposition."""

import math

import numpy as np
import pytest

from catlake.llm import whitening
from catlake.llm.whitening import Spectrum, secular_roots


def test_secular_roots():
    rng = np.random.default_rng(1)
    for n in (2, 3, 17, 64):
        for spread in (1.0, 1e-6):
            d = np.sort(np.cumsum(rng.uniform(0.1, 1, n) * np.where(rng.random(n) < 0.5, 1, spread)))
            z = rng.normal(size=n) * np.where(rng.random(n) < 0.3, 1e-4, 1)
            origin, tau = secular_roots(d, z * z)
            assert np.allclose(origin + tau, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-13, atol=1e-14 * (d[-1] + z @ z))
            assert (origin + tau >= d).all() and (origin[:-1] + tau[:-1] <= d[1:]).all()


@pytest.mark.parametrize(("size", "n"), [(1, 5), (4, 3), (6, 50), (40, 300)])
def test_spectrum(size, n):
    rng = np.random.default_rng(size)
    x = np.floor(rng.normal(size=(n, size)) * 90)
    x[n // 2] = x[0]
    if size > 2:
        x[:, 2] = x[:, 1]  # no spread in one direction
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    one, other, weighted = (Spectrum.empty(size) for _ in range(3))
    for row in x[: n // 3]:
        one.add(row)
    for row in x[n // 3 :]:
        other.add(row)
    one.combine(other)
    one.combine(Spectrum.empty(size))
    for row, k in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
        weighted.add(row, k)
    for s in (one, weighted):
        assert s.n == n and np.allclose(s.mean, x.mean(0))
        assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() <= 1e-12 * max(1, scatter.max())
        assert np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() < 1e-12
        assert (np.diff(s.values) >= 0).all()


def check(found, rows):
    """The result against whole numbers and numpy, up to the sign of each component."""
    ids = [i for i, _ in rows]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, min(8, x.shape[1]) + 1))
    off = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    for c, at in by.items():
        whitened = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        expected = sorted(zip(ids, off, whitened.tolist(), strict=True))
        for sign in (1, -1):
            got = sorted((r["vec_id"], int(r["deviation"]), sign * r["whitened"]) for r in at)
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, expected, strict=True)):
                break
        else:
            raise AssertionError(c)
        assert all(r["n"] == n and abs(r["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in at)


def test_whiten(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    check(whitening.whiten(frame.repartition(7)).collect(), rows)


def test_strange_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(3)
    good = [(i // 2, [float(c) for c in rng.normal(size=3)]) for i in range(30)] + [(5, [0.0, 1.0, -2.0])] * 12
    odd = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0]), (7, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in good + odd], "vec_id long, embedding array<float>, EMBEDDING int").repartition(9)
    check(whitening.whiten(frame).collect(), good)
    plain = frame.toDF("vec_id", "embedding", "more")
    assert whitening.whiten(plain.filter("embedding IS NULL")).collect() == []
    one = whitening.whiten(plain.filter("vec_id = 9").limit(1)).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    found = sorted(whitening.whiten(flat).collect(), key=lambda r: (r["component"], str(r["vec_id"])))
    assert [r["explained"] for r in found] == [1.0] * 3 + [0.0] * 3 and [r["whitened"] for r in found[3:]] == [None] * 3
    assert sorted(round(abs(r["whitened"]), 6) for r in found[:3]) == [0.0, 1.224745, 1.224745] and found[0]["identity_error"] < 1e-12


def test_deviations_beyond_a_long():
    model = whitening.Whitening(10**10, [10**15 + 7, 3], np.eye(2), np.ones(2), 1.0)
    x = np.array([[100_500, 1], [99_999, -1]])
    assert model.deviations(x) == [sum((10**10 * int(a) - s) ** 2 for a, s in zip(row, model.sums, strict=True)) for row in x]
