"""Singular values and right singular vectors of a small square matrix by the bidiagonal qd route.

Householder reflections reduce R to an upper bidiagonal matrix, dqds finds its
singular values to high relative accuracy, and twisted factorisations of the
tridiagonal B^T B give the vectors. All arrays here are d x d for d vector
entries; nothing in this module depends on the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
CLUSTER = 1e-3  # relative gap of squared values below which vectors are kept orthogonal by hand


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, superdiagonal, V)`` with ``r = U B V^T`` for orthogonal U (not formed) and V."""
    a = np.array(r, dtype=np.float64)
    d = a.shape[0]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray:
        top = np.abs(x).max(initial=0.0)
        w = x / top if top else x.copy()
        norm = np.sqrt((w * w).sum())
        if not norm:
            return np.zeros_like(x)
        w[0] += norm if w[0] >= 0 else -norm
        return w / np.sqrt((w * w).sum())

    for k in range(d):
        w = reflector(a[k:, k])
        a[k:, k:] -= 2.0 * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2.0 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2.0 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_block(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of one unreduced block, by differential qd with shifts."""
    out, sigma = [], 0.0
    scale = max(max(q), max(e, default=0.0), np.finfo(np.float64).tiny)
    while q:
        n = len(q)
        if n == 1:
            out.append(max(q[0], 0.0) + sigma)
            break
        # deflate at the end; a tiny inner e cuts the block
        if e[-1] <= EPS * EPS * (sigma + q[-1]) or e[-1] <= EPS * EPS * EPS * scale:
            out.append(max(q[-1], 0.0) + sigma)
            q.pop(), e.pop()
            continue
        cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * EPS * scale), None)
        if cut is not None:
            tail = _dqds_block(q[cut + 1:], e[cut + 1:])
            out.extend(t + sigma for t in tail)
            q, e = q[:cut + 1], e[:cut]
            continue
        # shift: below the least eigenvalue of the last 2 x 2 block, cut back until the sweep stays positive
        a, b, c = q[-2], q[-1], e[-1]
        t = 0.5 * (a + b + c)
        disc = max(t * t - a * b, 0.0) ** 0.5
        low = a * b / (t + disc) if t + disc else 0.0
        shift = max(min(low, min(q)) * (1 - 4 * EPS), 0.0)
        for attempt in range(4):
            nq, ne, d, ok = [], [], q[0] - shift, True
            for i in range(n - 1):
                if d < 0:
                    ok = False
                    break
                s = d + e[i]
                if s <= 0.0:
                    s = np.finfo(np.float64).tiny
                ratio = q[i + 1] / s
                nq.append(s)
                ne.append(e[i] * ratio)
                d = d * ratio - shift
            if ok and d >= 0:
                nq.append(d)
                q, e = nq, ne
                sigma += shift
                break
            shift = shift * 0.25 if attempt < 2 else 0.0
    return out


def squared_singular_values(diag: np.ndarray, sup: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling."""
    top = max(np.abs(diag).max(initial=0.0), np.abs(sup).max(initial=0.0))
    if not top:
        return np.zeros(len(diag))
    q, e = list((diag / top) ** 2), list((sup / top) ** 2)
    return np.sort(np.array(_dqds_block(q, e)))[::-1] * top * top


def _twisted(q2: np.ndarray, off: np.ndarray, lam: float, start: np.ndarray | None = None) -> np.ndarray:
    """Vector of the tridiagonal with diagonal ``q2`` and off-diagonal ``off`` at the eigenvalue ``lam``.

    The stationary (top-down) and progressive (bottom-up) factorisations meet at the
    row of the least twist; without ``start`` the twisted system has that unit
    vector as right side, with it one step of inverse iteration is done.
    """
    n = len(q2)
    tiny = EPS * EPS * max(np.abs(q2).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    up, down = np.empty(n), np.empty(n)
    s = q2[0] - lam
    for i in range(n):
        if i:
            s = (q2[i] - lam) - off[i - 1] * off[i - 1] / up[i - 1]
        up[i] = s if abs(s) > tiny else (tiny if s >= 0 else -tiny)
    p = q2[-1] - lam
    for i in range(n - 1, -1, -1):
        if i < n - 1:
            p = (q2[i] - lam) - off[i] * off[i] / down[i + 1]
        down[i] = p if abs(p) > tiny else (tiny if p >= 0 else -tiny)
    gamma = up + down - (q2 - lam)
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if start is None:
        z[k] = 1.0
    else:  # N_k D_k N_k^T z = start
        y = start.astype(np.float64).copy()
        for i in range(1, k + 1):
            y[i] -= off[i - 1] / up[i - 1] * y[i - 1]
        below = 0.0
        w = start.astype(np.float64).copy()
        for i in range(n - 2, k - 1, -1):
            w[i] -= off[i] / down[i + 1] * w[i + 1]
        below = w[k] - start[k]
        g = gamma[k] if abs(gamma[k]) > tiny else tiny
        z[k] = (y[k] + below) / g
        for i in range(k - 1, -1, -1):
            z[i] = y[i] / up[i] - off[i] / up[i] * z[i + 1]
        for i in range(k + 1, n):
            z[i] = w[i] / down[i] - off[i - 1] / down[i] * z[i - 1]
        top = np.abs(z).max()
        return z / top / np.sqrt(((z / top) ** 2).sum())
    for i in range(k - 1, -1, -1):
        z[i] = -off[i] / up[i] * z[i + 1]
    for i in range(k + 1, n):
        z[i] = -off[i - 1] / down[i] * z[i - 1]
    top = np.abs(z).max()
    z /= top
    return z / np.sqrt((z * z).sum())


def right_vectors(diag: np.ndarray, sup: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squared singular values, unit right singular vectors as columns)`` of the ``count`` largest."""
    d = len(diag)
    top = max(np.abs(diag).max(initial=0.0), np.abs(sup).max(initial=0.0))
    if not top:
        return np.zeros(0), np.zeros((d, 0))
    b, s = diag / top, sup / top
    # B splits where the superdiagonal vanishes; equal values of different blocks have disjoint vectors
    cuts = [0] + [i + 1 for i in range(d - 1) if abs(s[i]) <= EPS * max(EPS, min(abs(b[i]), abs(b[i + 1])))] + [d]
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        bb, ss = b[lo:hi], s[lo:hi - 1]
        for lam in squared_singular_values(bb, ss):
            found.append((float(lam), lo, hi))
    found.sort(key=lambda f: -f[0])
    values, vectors = [], []
    done: list[tuple[float, int, np.ndarray]] = []
    for lam, lo, hi in found[:count]:
        bb, ss = b[lo:hi], s[lo:hi - 1]
        main = bb * bb
        main[1:] += ss * ss
        off = bb[:-1] * ss
        z = np.ones(1) if hi - lo == 1 else _twisted(main, off, lam)
        near = [v for l2, at, v in done if at == lo and abs(l2 - lam) <= CLUSTER * max(l2, lam) + EPS]
        if near:
            rng = np.random.default_rng((lo, len(done)))
            for attempt in range(8):
                if attempt:
                    z = _twisted(main, off, lam, z)
                size = 1.0
                for _ in range(3):
                    for v in near:
                        z = z - (v @ z) * v
                    part = np.sqrt((z * z).sum())
                    size *= part
                    z = z / part if part > 1e-12 else rng.standard_normal(hi - lo)
                if size > 0.5:
                    break
        done.append((lam, lo, z))
        full = np.zeros(d)
        full[lo:hi] = z
        values.append(lam * top * top)
        vectors.append(full)
    return np.array(values), np.array(vectors).T.reshape(d, len(values))


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squared singular values falling, unit right singular vectors as columns)`` of a square matrix."""
    diag, sup, v = bidiagonalise(r)
    values, z = right_vectors(diag, sup, count)
    return values, v @ z
