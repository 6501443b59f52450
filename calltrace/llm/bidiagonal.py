"""Singular values and right singular vectors of a small upper triangle: Householder bidiagonalisation, dqds, twisted factorisations.

Everything here works on one matrix of d x d numbers, d being the dimension of the vectors, whatever the number of rows was.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Eigenvalues closer than this share of the larger one are a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(a, b, p)``: diagonal and superdiagonal of B, and p, with ``r = u B p.T`` for some orthogonal u."""
    x = np.array(r, float)
    n = x.shape[1]
    p = np.eye(n)
    for k in range(n):
        for right in (False, True):
            v = x[k, k + 1 :].copy() if right else x[k:, k].copy()
            if len(v) < 2 or not (norm := np.linalg.norm(v)):
                continue
            v[0] += norm if v[0] >= 0 else -norm
            v /= np.linalg.norm(v)
            if right:
                x[k:, k + 1 :] -= 2 * np.outer(x[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
            else:
                x[k:, k:] -= 2 * np.outer(v, v @ x[k:, k:])
    return np.diag(x).copy(), np.diag(x, 1).copy(), p


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform, with its auxiliary ``d``; None where the shift passes the smallest eigenvalue."""
    n = len(q)
    d = q[0] - shift
    qq, ee, ds = [0.0] * n, [0.0] * (n - 1), [d]
    for i in range(n - 1):
        if d < 0:
            return None
        qq[i] = d + e[i]
        if qq[i] <= 0:
            return None
        t = q[i + 1] / qq[i]
        ee[i] = e[i] * t
        d = d * t - shift
        ds.append(d)
    qq[-1] = d
    return None if d < 0 else (qq, ee, ds)


def dqds(q, e) -> np.ndarray:
    """Eigenvalues, falling, of B'B for a bidiagonal B with squared diagonal ``q`` and squared off-diagonal ``e``.

    Each sweep is the differential quotient-difference transform; subtractions of like signs don't occur in it, so small eigenvalues keep
    their relative accuracy. A shift below the smallest eigenvalue is tried first close to the sweep's upper bound, and where that
    fails, one over the trace of the inverse, which can't pass it.
    """
    out: list[float] = []
    top = max([*map(float, q), *map(float, e), 0.0])
    floor = top * EPS**3 + np.finfo(float).tiny  # a zero would divide; it stays far below what counts as zero
    work = [([max(float(v), floor) for v in q], [float(v) for v in e], 0.0)] if len(q) else []
    while work:
        q, e, sigma = work.pop()
        while True:
            n = len(q)
            if n == 1:
                out.append(sigma + q[0])
                break
            cut = next((i for i in range(n - 1) if e[i] <= (EPS * EPS) * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if n == 2:  # trace and determinant of the 2 x 2 block, without cancellation
                a, b, c = q[0], e[0], q[1]
                s = a + b + c
                big = (s + ((a - c + b) ** 2 + 4 * b * c) ** 0.5) / 2
                out += [sigma + big, sigma + c * (a / big)]
                break
            if q[0] < q[-1]:  # small ones to the end
                q, e = q[::-1], e[::-1]
            probe = _sweep(q, e, 0.0)
            upper = min(probe[2])
            safe = 1.0 / sum(1.0 / max(d, floor) for d in probe[2]) * (1 - 4 * n * EPS)
            near = e[-1] / (q[-2] + e[-1])
            done = None
            for shift in (upper * (1 - 4 * near), upper * 0.75, safe):
                if shift >= safe and shift > 0 and (done := _sweep(q, e, shift)):
                    break
            if done is None:
                done, shift = probe, 0.0
            q, e, sigma = [max(v, floor) for v in done[0]], done[1], sigma + shift
    return np.array(sorted(out, reverse=True))


class _Twisted:
    """The twisted factorisation of B'B - x at its best index, B'B with diagonal ``t`` and off-diagonal ``s``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, x: float):
        n = len(a)
        self.n, tiny = n, EPS * max(float(np.max(np.abs(a))) ** 2, np.finfo(float).tiny) * EPS
        q, e = a * a, b * b
        # stationary transform from the top: B'B - x = L+ D+ L+'
        self.top, self.low = np.zeros(n), np.zeros(max(n - 1, 0))
        s = -x
        begin = np.zeros(n)
        for i in range(n):
            begin[i] = s
            self.top[i] = q[i] + s
            if abs(self.top[i]) < tiny:
                self.top[i] = tiny
            if i < n - 1:
                self.low[i] = a[i] * b[i] / self.top[i]
                s = e[i] * s / self.top[i] - x
        # progressive transform from the bottom: B'B - x = U- D- U-'
        self.bottom, self.up = np.zeros(n), np.zeros(max(n - 1, 0))
        p = q[n - 1] - x
        end = np.zeros(n)
        for i in range(n - 1, -1, -1):
            end[i] = p
            if i:
                d = e[i - 1] + p
                if abs(d) < tiny:
                    d = tiny
                self.bottom[i] = d
                self.up[i - 1] = a[i - 1] * b[i - 1] / d
                p = q[i - 1] * p / d - x
        self.gamma = begin + end + x
        order = np.argsort(np.abs(self.gamma), kind="stable")
        self.k = int(order[0])

    def vector(self, k: int | None = None) -> np.ndarray:
        """z with (B'B - x) z = gamma_k e_k and z_k = 1."""
        k = self.k if k is None else k
        z = np.zeros(self.n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(k, self.n - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        """(B'B - x) z = y through the twisted factors."""
        k, y = self.k, y.copy()
        for i in range(k):
            y[i + 1] -= self.low[i] * y[i]
        for i in range(self.n - 1, k, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        gamma = self.gamma[k] if abs(self.gamma[k]) > 0 else EPS * EPS
        z = np.zeros(self.n)
        z[k] = y[k] / gamma
        for i in range(k - 1, -1, -1):
            z[i] = y[i] / self.top[i] - self.low[i] * z[i + 1]
        for i in range(k, self.n - 1):
            z[i + 1] = y[i + 1] / self.bottom[i + 1] - self.up[i] * z[i]
        return z


def _vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Columns: eigenvectors of B'B of an unreduced B for its ``values``, falling."""
    out = np.zeros((len(a), len(values)))
    seeded = np.random.default_rng(7)
    first = 0
    for j, x in enumerate(values):
        if j and values[j - 1] - x > CLUSTER * values[j - 1]:
            first = j
        held = out[:, first:j]
        f = _Twisted(a, b, float(x))
        z = f.vector()
        for attempt in range(4):
            before = np.linalg.norm(z)
            z = z - held @ (held.T @ z)
            if not held.shape[1] or np.linalg.norm(z) > 0.5 * before:
                break
            # the cluster's earlier vectors hold most of this one: inverse iteration from a seeded start finds another
            z = f.solve(seeded.standard_normal(len(a)) if attempt == 0 else z / max(np.linalg.norm(z), np.finfo(float).tiny))
            z /= np.linalg.norm(z)
        for _ in range(3):
            z /= max(np.linalg.norm(z), np.finfo(float).tiny)
            z = z - held @ (held.T @ z)
        out[:, j] = z / max(np.linalg.norm(z), np.finfo(float).tiny)
    return out


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The up to ``most`` largest squared singular values of ``r`` that are not zero in its precision, their right singular vectors as
    columns, and the sum of all squared singular values."""
    n = r.shape[1]
    scale = float(np.max(np.abs(r), initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0)), 0.0
    r = np.vstack([r, np.zeros((max(0, n - len(r)), n))]) / scale
    a, b, p = bidiagonalise(r)
    norm = max(np.max(np.abs(a)), np.max(np.abs(b), initial=0.0))
    b = np.where(np.abs(b) <= EPS * norm, 0.0, b)
    values, places = [], []
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    for lo, hi in zip(edges, edges[1:], strict=False):
        own = dqds(a[lo:hi] ** 2, b[lo : hi - 1] ** 2)
        values += own.tolist()
        places += [(lo, hi, i, own) for i in range(hi - lo)]
    order = sorted(range(len(values)), key=lambda i: -values[i])[:most]
    order = [i for i in order if values[i] > (n * EPS) ** 2 * max(values)]
    v, made = np.zeros((n, len(order))), {}
    for c, i in enumerate(order):
        lo, hi, k, own = places[i]
        if lo not in made:
            made[lo] = _vectors(a[lo:hi], b[lo : hi - 1], own[: max(places[j][2] for j in order if places[j][0] == lo) + 1])
        v[lo:hi, c] = made[lo][:, k]
    return np.array([values[i] for i in order]) * scale**2, p @ v, float(np.sum(values)) * scale**2
