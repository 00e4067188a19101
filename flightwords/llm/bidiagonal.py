"""Singular values and right singular vectors of a small square matrix, by qd.

Householder reflections make the matrix upper bidiagonal, dqds finds the
squares of its singular values (each to high relative accuracy, as no step
subtracts more than a proven lower bound), and twisted factorisations of
B'B - x give each vector from the side where it is best determined.  Only plain
helpers here: a matrix is one R factor of ``whitening``, as large as a vector is
long.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
#: Relative distance below which vectors are made orthogonal to their neighbours explicitly.
CLOSE = 1e-3


def bidiagonalise(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal, and the right reflections that bring ``a`` there."""
    a = a.copy()
    n = len(a)
    right = []
    for k in range(n):
        v = _reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = _reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflection(x: np.ndarray) -> np.ndarray:
    """Unit v such that x - 2 v v'x has its first entry alone; 0 where nothing is to do."""
    v, size = x.copy(), float(np.linalg.norm(x))
    if size == 0 or not x[1:].any():
        return np.zeros_like(x)
    v[0] += math.copysign(size, v[0])
    return v / np.linalg.norm(v)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an unreduced bidiagonal matrix, falling."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found, moved = [], 0.0
    while q:
        n = len(q)
        if n == 1:
            found.append(moved + q.pop())
            break
        if e[-1] <= EPS * EPS * (moved + q[-1]):
            found.append(moved + q.pop())
            e.pop()
            continue
        split = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (moved + min(q[k], q[k + 1]))), None)
        if split is not None:  # two matrices of their own, both moved as far
            for a, b in ((q[: split + 1], e[:split]), (q[split + 1 :], e[split + 1 :])):
                found.extend(moved + x for x in dqds(np.sqrt(a), np.sqrt(b)))
            break
        # without a shift the pivots are diagonal entries of the inverse: 1 / their sum bounds the smallest square
        pivots = _sweep(q, e, 0.0)
        total = sum(1 / d if d > 0 else math.inf for d in pivots)
        shift = (1 - 8 * n * EPS) / total
        if shift > EPS * moved and shift > 0:
            kept = q[:], e[:]
            if min(_sweep(q, e, shift)) < 0:  # rounding only
                q[:], e[:] = kept
            else:
                moved += shift
    return np.sort(np.array(found))[::-1]


def _sweep(q: list[float], e: list[float], shift: float) -> list[float]:
    """One differential qd transform with a shift, in place; its pivots."""
    d = q[0] - shift
    pivots = [d]
    for k in range(len(e)):
        q[k] = d + e[k]
        t = q[k + 1] / q[k] if q[k] else 0.0
        e[k] *= t
        d = d * t - shift
        pivots.append(d)
    q[-1] = d
    return pivots


class Twisted:
    """B'B - x as N D N', N unit lower above the twist and unit upper below it, at the best twist."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, x: float):
        n = len(diagonal)
        big = [float(v) ** 2 for v in diagonal]
        low = [float(b / a) for a, b in zip(diagonal, above)]
        self.plus, self.down = [0.0] * n, [0.0] * n
        head, tail, s, p = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        s[0], p[-1] = -x, big[-1] - x
        for k in range(n - 1):
            head[k] = s[k] + big[k] or EPS * EPS * big[k]
            self.plus[k] = big[k] * low[k] / head[k]
            s[k + 1] = self.plus[k] * low[k] * s[k] - x
        for k in range(n - 2, -1, -1):
            tail[k + 1] = big[k] * low[k] * low[k] + p[k + 1] or EPS * EPS * big[k]
            t = big[k] / tail[k + 1]
            self.down[k] = low[k] * t
            p[k] = p[k + 1] * t - x
        twist = [a + b + x for a, b in zip(s, p)]
        self.r = min(range(n), key=lambda k: abs(twist[k]))
        self.gap = twist[self.r]
        self.middle = head[: self.r] + [self.gap or EPS * x] + tail[self.r + 1 :]

    def _back(self, w: np.ndarray) -> np.ndarray:
        """z of N'z = w."""
        z = w.copy()
        for k in range(self.r - 1, -1, -1):
            z[k] -= self.plus[k] * z[k + 1]
        for k in range(self.r, len(z) - 1):
            z[k + 1] -= self.down[k] * z[k]
        return z

    def vector(self) -> np.ndarray:
        """z with (B'B - x) z = gap in the twist's place, 1 there."""
        return self._back(np.eye(len(self.middle))[self.r])

    def solve(self, b: np.ndarray) -> np.ndarray:
        u = b.copy()
        for k in range(self.r):
            u[k + 1] -= self.plus[k] * u[k]
        for k in range(len(u) - 2, self.r - 1, -1):
            u[k] -= self.down[k] * u[k + 1]
        return self._back(u / self.middle)


def twisted(diagonal: np.ndarray, above: np.ndarray, x: float, avoid: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Unit vector of B'B at its eigenvalue near x, and that eigenvalue made more exact.

    ``avoid``: vectors of close eigenvalues found before; beside them the vector
    is found by inverse iteration with the twisted factors, which keeps it
    orthogonal to them.
    """
    n = len(diagonal)
    if avoid:
        f = Twisted(diagonal, above, x)
        z = np.random.default_rng(len(avoid)).standard_normal(n)
        for _ in range(6):
            for v in avoid * 2:
                z = z - v * (v @ z)
            z = f.solve(z / np.linalg.norm(z))
            z /= np.abs(z).max()
        for v in avoid * 2:
            z = z - v * (v @ z)
        return z / np.linalg.norm(z), x
    best = None
    for _ in range(4):
        f = Twisted(diagonal, above, x)
        z = f.vector()
        size = np.linalg.norm(z)
        if not np.isfinite(size):
            break
        miss = abs(f.gap) / size
        if best is None or miss < best[0]:
            best = miss, z / size, x
        if miss <= 4 * EPS * x:
            break
        x += f.gap / size**2
    return best[1:] if best else (np.eye(n)[0], x)


def right_singular(a: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values (falling, all) of a square matrix and the right vectors (as rows) of the first ``most``."""
    n = len(a)
    scale = float(np.abs(a).max(initial=0.0))
    if scale == 0:
        return np.zeros(n), np.eye(n)[: n if most is None else most]
    diagonal, above, right = bidiagonalise(a / scale)
    size = np.linalg.norm(a / scale)
    # entries below rounding of the whole matrix are none
    above = np.where(np.abs(above) <= EPS * size / n, 0.0, above)
    diagonal = np.where(np.abs(diagonal) <= EPS * size / n, EPS * size / n, diagonal)
    cuts = np.append(np.append(0, np.flatnonzero(above == 0) + 1), n)
    blocks = [(int(i), int(j)) for i, j in zip(cuts[:-1], cuts[1:])]
    values = sorted(((x, i, j) for i, j in blocks for x in dqds(diagonal[i:j], above[i : j - 1])), key=lambda v: (-v[0], v[1]))
    out, done = [], []
    for x, i, j in values[: n if most is None else most]:
        near = [v[i:j] for y, k, v in done if k == i and abs(y - x) <= CLOSE * y]
        z, x = twisted(diagonal[i:j], above[i : j - 1], x, near)
        whole = np.zeros(n)
        whole[i:j] = z
        done.append((x, i, whole))
    for _, _, z in done:
        z = z.copy()
        for k in range(len(right) - 1, -1, -1):
            z[k + 1 :] -= 2 * right[k] * (right[k] @ z[k + 1 :])
        out.append(z)
    squares = np.array([x for x, _, _ in values])
    squares[: len(done)] = [x for x, _, _ in done]
    return squares * scale**2, np.array(out).reshape(-1, n)
