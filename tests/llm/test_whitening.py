"""op13 against numpy's eigenvectors, and the solver on hard matrices."""

import math

import numpy as np
import pytest

from seqlake.llm.bidiagonal import right_singular
from seqlake.llm.whitening import whiten

rng = np.random.default_rng(3)
ORTHO = np.linalg.qr(rng.standard_normal((60, 20)))[0]
TURN = np.linalg.qr(rng.standard_normal((20, 20)))[0]
MATRICES = {
    "gauss": rng.standard_normal((100, 24)), "graded": rng.standard_normal((100, 24)) * np.logspace(0, -7, 24),
    "equal": ORTHO, "clusters": ORTHO @ np.diag([5.0] * 4 + [3.0] * 6 + [1.0] * 10) @ TURN,
    "rank one": np.ones((30, 6)), "few rows": rng.standard_normal((4, 12)), "identity": np.eye(5), "one": np.array([[3.0]]),
    "blocks": np.kron(np.eye(4), rng.standard_normal((3, 3))),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    a = MATRICES[name]
    r = np.linalg.qr(np.vstack((a, np.zeros((a.shape[1], a.shape[1])))), mode="r")
    values, v = right_singular(r, r.shape[0])
    want = np.linalg.svd(a, compute_uv=False) ** 2
    want = np.concatenate((want, np.zeros(len(values) - len(want))))
    assert np.abs(values - want).max() <= 1e-13 * want[0]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-10
    assert np.abs(r.T @ (r @ v) - v * values).max() <= 1e-12 * want[0]


def _rows(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)],
                                 f"vec_id long, embedding array<{kind}>, component string").repartition(5)


def _check(out, vectors):
    fit = {i: v for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    x = {i: [math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for i, v in fit.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[j] for v in x.values()) for j in range(d)]
    y = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x.values()])
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    got = out.collect()
    k = max(r["component"] for r in got)
    assert k == min(8, d) and len(got) == n * k
    white = {(r["vec_id"], r["component"]): r for r in got}
    assert set(white) == {(i, c) for i in x for c in range(1, k + 1)}
    w = np.array([[white[i, c]["whitened"] for c in range(1, k + 1)] for i in x])
    want = y @ q[:, :k] / np.sqrt(e[:k])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-7
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8
    for (i, c), r in white.items():
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
        assert abs(r["explained"] - e[c - 1] / np.trace(cov)) < 1e-10 and r["identity_error"] < 1e-8


def test_whitened_rows(spark):
    v = (rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12)).tolist()
    v[7], v[8], v[9][3], v[10][0], v[11] = v[6], None, None, float("nan"), [float("inf")] * 12
    _check(whiten(_rows(spark, v)), v)


def test_few_dimensions_and_merge(spark):
    v = rng.standard_normal((400, 3)).tolist()
    _check(whiten(_rows(spark, v).repartition(70)), v)


def test_edges(spark):
    assert whiten(_rows(spark, [])).count() == 0
    assert whiten(_rows(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whiten(_rows(spark, [None, [], [None, 1.0]])).count() == 0
    flat = whiten(_rows(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1}
    odd = whiten(_rows(spark, [[1.0], [2.0], [1.0, 2.0], [4.0]])).collect()
    assert {r["vec_id"] for r in odd} == {0, 1, 3} and all(r["n"] == 3 for r in odd)
    huge = whiten(_rows(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 5.0]], "double")).collect()
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != 2)
