"""Embedding whitening: blockwise QR of the centred rows, then a bidiagonal qd solver for R.

Each task reduces its centred rows block by block to one triangular R; the R of all
tasks are merged in groups of ``FAN`` by further Spark stages until at most ``FAN`` d x d
matrices are left, whose QR is the R of the whole table. ``bidiagonal`` finds its
singular values (dqds) and right vectors (twisted factorisations) on d x d arrays.
No covariance matrix is formed, so small directions keep their accuracy.

Entries are taken as whole numbers ``floor(1024 c) + 100000``, so sums and
deviations are exact; an entry beyond 2^62 is held at that bound.

Edge cases: rows whose vector is null or holds a null or non-finite entry are left out,
as are vectors of another length than the most frequent one (ties: the shorter);
repeated rows count as often as they occur; an empty table, or one whose vectors are all
equal, gives an empty result; directions of no variance (singular value below
64 d eps of the largest) have no component; a deviation beyond 64 bits is null; equal eigenvalues
get some orthonormal basis; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlake.llm.bidiagonal import EPS, right_singular
from seqlake.session import materialize

SCALE, SHIFT, COMPONENTS, BLOCK, FAN, BOUND = 1024.0, 100_000, 8, 4096, 32, 1 << 62


def _whole(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, whole-number vectors)`` per vector length (or of ``dim`` only) of a batch of (id, vector)."""
    col = batch.column(1)
    lengths = np.array(col.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    for d in np.unique(lengths).tolist():
        if d < 1 or (dim is not None and d != dim):
            continue
        at = np.flatnonzero(lengths == d)
        flat = col.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        c = np.asarray(flat, dtype=np.float64).reshape(-1, d)
        fine = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * c[fine]) + SHIFT, -float(BOUND), float(BOUND))
        yield at[fine], x.astype(np.int64)


def _from_centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``: exact whole numbers, as Python integers where 64 bits could overflow."""
    if len(x) and n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in sums) >= BOUND:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * np.int64(n) - np.array(sums, dtype=np.int64)


def _deviations(far: np.ndarray) -> pa.Array:
    """Exact sums of squares per row, null beyond 64 bits."""
    if far.dtype != object and len(far):
        top = int(np.abs(far).max())
        if top * top * far.shape[1] < 1 << 63:
            return pa.array((far * far).sum(axis=1), pa.int64())
    totals = [sum(int(v) ** 2 for v in row) for row in far]
    return pa.array([t if t < 1 << 63 else None for t in totals], pa.int64())


def _sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """``(rows, vector length, exact sum per dimension)`` of the usable vectors."""

    def parts(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in _whole(batch):
                for s in range(0, len(x), 1 << 20):
                    part = x[s:s + (1 << 20)]
                    k, have = total.get(x.shape[1], (0, np.zeros(x.shape[1], dtype=object)))
                    big = len(part) and max(abs(int(part.max())), abs(int(part.min()))) >= 1 << 42
                    add = part.astype(object).sum(axis=0) if big else part.sum(axis=0).astype(object)
                    total[x.shape[1]] = k + len(part), have + add
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([k for k, _ in total.values()], pa.int64()),
                 pa.array([[str(v) for v in s] for _, s in total.values()], pa.list_(pa.string()))], names=["dim", "k", "s"])

    found = materialize(vectors.mapInArrow(parts, "dim int, k long, s array<string>"), "whiten-sums")
    best = found.groupBy("dim").agg(F.sum("k").alias("n")).filter("n > 0").orderBy(F.desc("n"), "dim").first()
    if best is None:
        return 0, 0, []
    per = found.filter(F.col("dim") == best["dim"]).select(F.posexplode("s").alias("i", "v"))
    per = per.groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("i")  # one row per dimension
    return int(best["n"]), int(best["dim"]), [int(r["v"]) for r in per.collect()]


def _reduce(rows: np.ndarray) -> np.ndarray:
    """Square R of a QR of ``rows``, padded with zero rows."""
    d = rows.shape[1]
    if len(rows) < d:
        rows = np.vstack((rows, np.zeros((d - len(rows), d))))
    return np.linalg.qr(rows, mode="r")


def triangular(vectors: DataFrame, n: int, dim: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows of the whole table, merged over tasks in groups of ``FAN``."""

    def blocks(batches):
        r = np.zeros((0, dim))
        for batch in batches:
            for _, x in _whole(batch, dim):
                y = (_from_centre(x, n, sums) / n).astype(np.float64)
                for s in range(0, len(y), BLOCK):
                    r = _reduce(np.vstack((r, y[s:s + BLOCK])))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    def merge(pdf):
        import pandas as pd

        r = np.zeros((0, dim))
        for raw in pdf["r"]:
            r = _reduce(np.vstack((r, np.frombuffer(raw).reshape(dim, dim))))
        return pd.DataFrame({"r": [r.tobytes()]})

    parts = materialize(vectors.mapInArrow(blocks, "r binary"), "whiten-r")
    count = parts.count()
    while count > FAN:
        # a task holds at most some FAN matrices: the groups are dealt by a hash of the matrix
        groups = -(-count // FAN)
        parts = materialize(parts.groupBy(F.pmod(F.xxhash64("r"), F.lit(groups)).alias("g")).applyInPandas(merge, "r binary"), "whiten-r")
        merged = parts.count()
        if merged == count:
            break
        count = merged
    return _reduce(np.vstack([np.frombuffer(row["r"]).reshape(dim, dim) for row in parts.collect()]))


def directions(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``(eigenvalues falling, unit directions as columns, trace)`` of the covariance, divisor ``n``."""
    squared, v = right_singular(r, min(components, r.shape[0]))
    keep = squared > (squared[0] if len(squared) else 0.0) * (64 * r.shape[0] * EPS) ** 2
    v = v[:, keep]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0) if v.shape[1] else v
    return squared[keep] / n, v, float((r * r).sum() / n)


def _identity_error(vectors: DataFrame, project, dim: int, k: int, n: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""

    def moments(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _whole(batch, dim):
                w = project(x)[1]
                total[0] += w.sum(axis=0)
                total[1:] += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    per = vectors.mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    got = per.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # (k + 1) k rows
    m = np.array([row["v"] for row in got]).reshape(k + 1, k) / n
    return float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())


def whiten(vectors: DataFrame, column: str | Column = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per usable vector and component."""
    source = vectors.select(vectors["vec_id"], vectors[column] if isinstance(column, str) else column)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    spark = vectors.sparkSession
    n, dim, sums = _sums(source)
    if not n:
        return spark.createDataFrame([], schema)
    e, v, trace = directions(triangular(source, n, dim, sums), n, components)
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = v / np.sqrt(e)

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = _from_centre(x, n, sums)
        return far, (far / n).astype(np.float64) @ scaled

    error = _identity_error(source, project, dim, k, n)
    explained = e / trace

    def rows(batches):
        for batch in batches:
            for at, x in _whole(batch, dim):
                if not len(at):
                    continue
                far, w = project(x)
                m = len(at)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n, np.int64)), _deviations(far).take(each), pa.array(w.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(rows, schema)
