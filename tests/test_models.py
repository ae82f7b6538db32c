"""Property checks for the learned models (no equality with other libraries)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.operators.models.autoencoder import MLP, fit_autoencoder
from seqlake.operators.models.centroid import fit_centroid
from seqlake.operators.models.iforest import fit_isolation_forest
from seqlake.operators.models.ocsvm import fit_oneclass_svm


def _blob(spark, n=300, d=5, outliers=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, size=(n, d))
    X[:outliers] += 8.0
    rows = [(f"r{i}", X[i].tolist(), int(i < outliers)) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, features array<double>, y_true int")


def test_isolation_forest_ranks_planted_outliers(spark):
    df = _blob(spark)
    m = fit_isolation_forest(df, n_trees=50, max_samples=128)
    s = m.score(df).orderBy(F.col("score").desc()).limit(5).collect()
    assert {r["sample_id"] for r in s} == {f"r{i}" for i in range(5)}
    vals = [r["score"] for r in m.score(df).collect()]
    assert all(0 < v < 1 for v in vals)


def test_isolation_forest_partition_independent(spark):
    df = _blob(spark)
    a = fit_isolation_forest(df, n_trees=20)
    b = fit_isolation_forest(df.repartition(3), n_trees=20)
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.feature, b.feature)


def test_mlp_gradient_matches_finite_differences():
    m = MLP([4, 5, 3, 4]).init(1)
    X = np.random.default_rng(0).normal(size=(7, 4))
    g, loss = m.grad(X, X)
    num = np.zeros_like(m.theta)
    for i in range(len(m.theta)):
        t = m.theta.copy()
        t[i] += 1e-6
        num[i] = (MLP(m.sizes, t).grad(X, X)[1] - loss) / 1e-6
    assert np.max(np.abs(num - g)) < 1e-4


def test_autoencoder_loss_falls_and_flags_outliers(spark):
    df = _blob(spark, n=200)
    m = fit_autoencoder(df, steps=25, hidden_layers=(8, 4), encoding_dim=4)
    assert m.history[-1] < m.history[0]
    s = m.score(df)
    err = {r["y_true"]: r["e"] for r in s.groupBy("y_true").agg(F.avg("reconstruction_error").alias("e")).collect()}
    assert err[1] > err[0]
    assert m.threshold is not None


def test_ocsvm_outlier_share_close_to_nu(spark):
    df = _blob(spark, n=400, outliers=0)
    m = fit_oneclass_svm(df, nu=0.1, steps=20, n_components=100)
    share = m.score(df).agg(F.avg((F.col("score") > 0).cast("double"))).first()[0]
    assert share == pytest.approx(0.1, abs=0.03)


def test_centroid_detector(spark):
    df = _blob(spark)
    det = fit_centroid(df, method="euclidean")
    top = det.score(df).orderBy(F.col("score").desc()).limit(5).collect()
    assert {r["sample_id"] for r in top} == {f"r{i}" for i in range(5)}
    with pytest.raises(ValueError):
        fit_centroid(df, method="chebyshev")
    flagged = det.predict(df).where("is_novel").count()
    assert 0 < flagged <= 16


def test_autoencoder_local_steps_loss_falls(spark):
    df = _blob(spark, n=200)
    m = fit_autoencoder(df.repartition(4), steps=40, local_steps=5, hidden_layers=(8, 4), encoding_dim=4)
    enc_hist = m.history[: len(m.history) // 2]
    assert enc_hist[-1] < enc_hist[0]


def test_autoencoder_equal_at_any_partitioning(spark, monkeypatch):
    from seqlake.operators.models import autoencoder

    monkeypatch.setattr(autoencoder, "BUCKET", 60)  # several buckets
    monkeypatch.setattr(autoencoder, "FAN", 2)  # averaged in two levels
    df = _blob(spark, n=250)
    df = df.union(df.limit(30))
    few = fit_autoencoder(df.repartition(2), steps=12, local_steps=3, hidden_layers=(6, 4), encoding_dim=3)
    many = fit_autoencoder(df.repartition(16), steps=12, local_steps=3, hidden_layers=(6, 4), encoding_dim=3)
    assert np.array_equal(few.encoder.theta, many.encoder.theta) and np.array_equal(few.decoder.theta, many.decoder.theta)
    assert few.history == many.history and few.threshold == many.threshold


def test_autoencoder_carries_moments_and_stops(spark):
    from seqlake.operators.models.autoencoder import _layout, train_mlp

    rows, buckets = _layout(_blob(spark, n=120), "features")
    assert buckets == 1
    one, split = MLP([5, 4, 5]).init(3), MLP([5, 4, 5]).init(3)
    a = train_mlp(rows, 1, one, 12, 1e-2, per_round=12)
    b = train_mlp(rows, 1, split, 12, 1e-2, per_round=3)
    assert np.array_equal(one.theta, split.theta) and a == b  # rounds go on where the last ended
    assert len(train_mlp(rows, 1, MLP([5, 4, 5]).init(3), 500, 1e-9, per_round=10)) == 20  # no progress: stops


def test_weighted_rows_equal_repeated_rows():
    m = MLP([3, 4, 3]).init(2)
    X = np.random.default_rng(1).normal(size=(5, 3))
    w = np.array([1.0, 3.0, 1.0, 2.0, 1.0])
    g, loss = m.grad(X, X, w)
    R = np.repeat(X, w.astype(int), axis=0)
    g2, loss2 = m.grad(R, R)
    assert np.abs(g - g2).max() < 1e-12 and abs(loss - loss2) < 1e-12


def _exact_svm(K, nu, steps=60000):
    """Dual one-class SVM on the full kernel by pairwise steps."""
    n = len(K)
    cap = 1.0 / (nu * n)
    a = np.full(n, 1.0 / n)
    g = K @ a
    for _ in range(steps):
        up, down = np.flatnonzero(a < cap - 1e-15), np.flatnonzero(a > 1e-15)
        i, j = up[np.argmin(g[up])], down[np.argmax(g[down])]
        if g[j] - g[i] < 1e-9:
            break
        t = min(cap - a[i], a[j], (g[j] - g[i]) / max(K[i, i] + K[j, j] - 2 * K[i, j], 1e-12))
        a[i] += t
        a[j] -= t
        g += t * (K[i] - K[j])
    return a


def test_ocsvm_ranks_like_the_exact_solver(spark):
    rng = np.random.default_rng(9)
    X = np.vstack([rng.normal(size=(250, 4)), rng.normal(size=(200, 4)) * 0.5 + 3, rng.uniform(-5, 8, size=(50, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id int, features array<double>").repartition(4)
    m = fit_oneclass_svm(df, nu=0.1, n_components=200)
    assert m.gaps[-1] <= 1e-3 * float(m.w @ m.w) and len(m.gaps) < 100
    K = np.exp(-m.gamma * ((X[:, None] - X[None]) ** 2).sum(axis=2))
    want = -(K @ _exact_svm(K, 0.1))
    got = np.array([r["score"] for r in m.score(df).orderBy("id").collect()])
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    assert np.corrcoef(rank(got), rank(want))[0, 1] > 0.95
    assert abs(m.gamma - 1 / (4 * X.var())) < 1e-9 * m.gamma
