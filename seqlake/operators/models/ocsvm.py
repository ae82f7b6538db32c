"""One-class SVM with an RBF kernel (F6), solved on landmark (Nystroem) features with a duality-gap test.

Landmarks are distinct training rows chosen by hash; a row's features are its kernel values at the landmarks
times the inverse square root of the landmarks' own kernel matrix, so with all rows as landmarks the
kernel is exact. The dual problem, the shortest convex combination of the rows' features with no row above 1 / (nu n),
is solved by corrective block steps: each step puts all weight on the share nu of rows with the lowest margins (a
vertex of the dual), then the best combination of all vertices so far is found on the driver. The gap between the
last vertex and the combination bounds the distance to the optimum, and the training stops on it. A step is two
Spark jobs: a histogram of margins for the cut, and the sum of the features below it. gamma='scale' is
1 / (d * var(X)). Score = -(w.phi(x) - rho), higher = more novel; rho is the exact nu-quantile of the training margins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.operators.models.distributed import batch_matrix, sum_over_partitions
from seqlake.operators.models.threshold import percentile_threshold

CELLS = 1 << 14


def scale_gamma(df: DataFrame, vec_col: str) -> tuple[float, int]:
    """``(1 / (entries per row x population variance of all entries), entries per row)``, from sums per task."""
    d = len(df.select(vec_col).first()[0])

    def moments(batches):
        n, mean, far = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = batch_matrix(pdf, vec_col).ravel()
                m, k = x.mean(), len(x)
                far += ((x - m) ** 2).sum() + (m - mean) ** 2 * n * k / (n + k)
                mean += (m - mean) * k / (n + k)
                n += k
        # per task: count, sum, and squares about the task's own mean
        return np.array([n, n * mean, far, n * mean * mean]), 0.0, n

    (n, total, far, squares), _, _ = sum_over_partitions(df.select(vec_col), moments)
    var = max((far + squares - total * total / n) / n, 0.0)
    return (1.0 / (d * var) if var > 0 else 1.0), d


@dataclass
class OneClassSVMModel:
    landmarks: np.ndarray
    whiten: np.ndarray
    w: np.ndarray
    rho: float
    gamma: float
    nu: float
    gaps: list[float] = field(default_factory=list)

    def features(self, X: np.ndarray) -> np.ndarray:
        far = (X * X).sum(axis=1)[:, None] + (self.landmarks * self.landmarks).sum(axis=1)[None] - 2.0 * X @ self.landmarks.T
        return np.exp(-self.gamma * np.maximum(far, 0.0)) @ self.whiten

    def decision(self, X: np.ndarray) -> np.ndarray:
        return self.features(X) @ self.w - self.rho

    def score(self, df: DataFrame, vec_col: str = "features", out_col: str = "score") -> DataFrame:
        bc = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.DoubleType())])

        def run(batches):
            m = bc.value
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(**{out_col: -m.decision(batch_matrix(pdf, vec_col))})

        return df.mapInPandas(run, schema)


def choose_landmarks(train: DataFrame, vec_col: str, count: int, seed: int) -> np.ndarray:
    """The ``count`` distinct rows first by seeded content hash."""
    rows = train.select(vec_col).distinct().orderBy(F.xxhash64(F.lit(seed), vec_col), vec_col).limit(count).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def shortest(atoms: np.ndarray, start: np.ndarray, steps: int = 4000) -> np.ndarray:
    """Weights of the shortest convex combination of the rows of ``atoms``, by pairwise steps with exact line search."""
    gram = atoms @ atoms.T
    lam = start.copy()
    grad = gram @ lam
    for _ in range(steps):
        to = int(np.argmin(grad))
        held = np.flatnonzero(lam > 0)
        away = int(held[np.argmax(grad[held])])
        gain = grad[away] - grad[to]
        curve = gram[to, to] + gram[away, away] - 2.0 * gram[to, away]
        if gain <= 1e-14 or curve <= 0:
            break
        step = min(lam[away], gain / curve)
        lam[to] += step
        lam[away] -= step
        grad += step * (gram[to] - gram[away])
    return lam


def _margin_histogram(data: DataFrame, vec_col: str, model: OneClassSVMModel) -> np.ndarray:
    """Rows per cell of the margin, from -1 to 1 (features and weights are no longer than 1)."""
    bc = data.sparkSession.sparkContext.broadcast(model)

    def part(batches):
        m, counts, n = bc.value, np.zeros(CELLS), 0
        for pdf in batches:
            if len(pdf):
                counts += np.bincount(_cell(m.features(batch_matrix(pdf, vec_col)) @ m.w), minlength=CELLS)
                n += len(pdf)
        return counts, 0.0, n

    return sum_over_partitions(data, part)[0]


def _cell(margin: np.ndarray) -> np.ndarray:
    return np.clip(((margin + 1.0) * (CELLS / 2)).astype(np.int64), 0, CELLS - 1)


def _feature_sums(data: DataFrame, vec_col: str, model: OneClassSVMModel, cut: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Summed features of the rows below cell ``cut`` and in it, and the number of rows."""
    bc = data.sparkSession.sparkContext.broadcast(model)
    k = len(model.w)

    def part(batches):
        m, total, n = bc.value, np.zeros(2 * k), 0
        for pdf in batches:
            if len(pdf):
                phi = m.features(batch_matrix(pdf, vec_col))
                cell = _cell(phi @ m.w)
                total[:k] += phi[cell < cut].sum(axis=0)
                total[k:] += phi[cell == cut].sum(axis=0)
                n += len(pdf)
        return total, 0.0, n

    total, _, n = sum_over_partitions(data, part)
    return total[:k], total[k:], n


def fit_oneclass_svm(train: DataFrame, vec_col: str = "features", nu: float = 0.1, gamma="scale",
                     n_components: int = 300, steps: int = 100, tol: float = 1e-3, seed: int = 42) -> OneClassSVMModel:
    """Fit with ``n_components`` landmarks; stops when the duality gap is at most ``tol`` of the squared length, or after ``steps``."""
    g = scale_gamma(train, vec_col)[0] if gamma == "scale" else float(gamma)
    marks = choose_landmarks(train, vec_col, n_components, seed)
    far = ((marks[:, None] - marks[None]) ** 2).sum(axis=2)
    values, vectors = np.linalg.eigh(np.exp(-g * far))
    keep = values > values[-1] * 1e-10
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    model = OneClassSVMModel(marks, whiten, np.zeros(int(keep.sum())), 0.0, g, nu)
    data = train.select(vec_col).persist()
    try:
        _, every, n = _feature_sums(data, vec_col, model, CELLS // 2)  # all margins are 0: every row is in the middle cell
        atoms, lam = (every / n)[None], np.ones(1)
        model.w = atoms[0].copy()
        for _ in range(steps):
            counts = _margin_histogram(data, vec_col, model)
            upto = np.cumsum(counts)
            share = nu * n
            cut = int(np.searchsorted(upto, share - 1e-9))
            below, inside, _ = _feature_sums(data, vec_col, model, cut)
            before = upto[cut] - counts[cut]
            atom = (below + inside * ((share - before) / counts[cut])) / share
            gap = float(model.w @ model.w - model.w @ atom)
            model.gaps.append(gap)
            if gap <= tol * float(model.w @ model.w):
                break
            atoms, lam = np.vstack((atoms, atom)), np.append(lam, 0.0)
            lam = shortest(atoms, lam)
            atoms, lam = atoms[lam > 0], lam[lam > 0]
            model.w = lam @ atoms
        # for a fixed w the optimal rho is the nu-quantile of the training
        # margins, set exactly (the nu-property holds)
        margins = model.score(data, vec_col, "_neg_margin")
        model.rho = -percentile_threshold(margins, "_neg_margin", 100.0 * (1.0 - nu)) + model.rho
    finally:
        data.unpersist()
    return model
