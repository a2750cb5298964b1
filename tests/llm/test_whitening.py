"""Whitening against exact fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from siftwork.llm import whitening
from siftwork.llm.common import table


def plain(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    y = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, sums)] for row in x])
    values, own = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:8]
    return deviation, y, values[order], own[:, order], values.sum()


def check(rows, vectors):
    deviation, y, values, own, trace = plain(vectors)
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    k = min(8, y.shape[1])
    assert len(rows) == k * len(vectors) and {r["n"] for r in rows} == {len(vectors)}
    assert [r["deviation"] for r in rows[::k]] == deviation
    w = np.array([r["whitened"] for r in rows]).reshape(len(vectors), k)
    want = y @ own / np.sqrt(values)
    sign = np.sign((w * want).sum(0))
    assert np.allclose(w * sign, want, atol=1e-6)
    assert np.allclose([r["explained"] for r in rows[:k]], values / trace, rtol=1e-9)
    assert np.allclose((w - w.mean(0)).T @ (w - w.mean(0)) / len(w), np.eye(k), atol=1e-9)
    assert {r["identity_error"] for r in rows}.pop() < 1e-9


def test_given_table(spark, sf):
    rows = table(spark, sf, "embeddings")
    vectors = [r["embedding"] for r in rows.orderBy("vec_id").collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    check(whitening.whitening(rows).collect(), vectors)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_any_partitioning(spark, parts):
    r = np.random.default_rng(parts)
    vectors = (r.normal(size=(300, 10)) @ np.diag(np.linspace(3, 0.1, 10)) + 7).tolist()
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(parts)
    check(whitening.whitening(docs).collect(), vectors)


def test_tree_of_factors(spark):
    vectors = np.random.default_rng(1).normal(size=(200, 4)).tolist()
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(30)
    rows = docs.select("vec_id", whitening.grid(docs["embedding"]).alias("x"))
    exact = whitening.totals(rows)
    r = whitening.factor(rows, exact, fan=2)
    y = exact.means_off(np.array([np.floor(np.array(v) * 1024).astype(int) + 100_000 for v in vectors]))
    assert np.allclose(r.T @ r, y.T @ y)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (10, [1e30, 1.0])]
    vectors = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, component string, n int")
    found = whitening.whitening(vectors).collect()
    assert sorted({r["vec_id"] or 0 for r in found}) == [0, 1] and len(found) == 6
    first, second = ([r for r in found if r["component"] == c] for c in (1, 2))
    assert all(r["whitened"] is None and r["explained"] == 0 for r in second)  # three points on a line
    assert abs(sum(r["whitened"] ** 2 for r in first) / 3 - 1) < 1e-9 and first[0]["identity_error"] < 1e-9
    assert whitening.whitening(vectors.limit(0)).count() == 0
    assert whitening.whitening(vectors.where("vec_id IN (4, 5, 8)")).count() == 0
    equal = whitening.whitening(vectors.where("vec_id = 1")).collect()
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in equal)


def test_large_sums_stay_exact():
    exact = whitening.Exact(1 << 40, [1 << 60, 5], 1 << 30)
    assert not exact.small and exact.centred(np.array([[1 << 30, 3]])).tolist() == [[(1 << 70) - (1 << 60), 3 * (1 << 40) - 5]]
    assert exact.deviations(np.array([[1 << 30, 3]])) == [((1 << 70) - (1 << 60)) ** 2 + (3 * (1 << 40) - 5) ** 2]
