"""Eigendecompositions of scatter matrices, kept up to date by rank-one changes.

A :class:`Spectrum` holds row count, mean and the eigendecomposition of the scatter (the sum of outer products of the centred rows).
Adding rows or another spectrum never forms a matrix to be decomposed anew: each change ``rho * v v'`` solves the secular equation
``1 + rho * sum(z_i**2 / (d_i - x)) = 0`` with ``z = Q'v`` between the old eigenvalues ``d``, after deflation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps
#: Rows that :meth:`Spectrum.add` reduces together.
BLOCK = 1024


def deflate(d: np.ndarray, z: np.ndarray, vectors: np.ndarray, rho: float) -> np.ndarray:
    """The places that the change reaches. Entries of ``z`` at equal eigenvalues are turned into one; negligible ones are left out.

    Changes ``d``, ``z`` and ``vectors`` in place. ``d`` ascends.
    """
    limit = 8 * EPS * max(abs(d[-1]), rho * float(z @ z))
    first = 0
    for end in [*(np.flatnonzero(np.diff(d) > limit) + 1), len(d)]:
        if end - first > 1 and (norm := float(np.linalg.norm(z[first:end]))) > 0:
            # A reflection within the eigenspace that maps its part of z onto the last of its vectors.
            turn = z[first:end].copy()
            turn[-1] += norm if turn[-1] >= 0 else -norm
            turn /= np.linalg.norm(turn)
            space = vectors[:, first:end]
            space -= 2 * np.outer(space @ turn, turn)
            z[first:end] -= 2 * turn * (turn @ z[first:end])
            z[first : end - 1] = 0
        first = end
    return np.flatnonzero(rho * np.abs(z) * np.linalg.norm(z) > limit / 8)


def roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pole, distance from it) of each root of the secular equation; ``d`` ascends strictly, no ``z`` is zero, ``rho`` > 0.

    One root lies above each pole and below the next; the last one's upper bound is ``rho * z'z`` above its pole. Each step fits
    a pole on either side to the function and its slope, and halves the bracket where that leaves it.
    """
    k = len(d)
    weight = rho * z * z
    upper = np.append(d[1:], d[-1] + weight.sum())
    gap = upper - d
    middle = 1 + (weight[:, None] / ((d[:, None] - d) - gap / 2)).sum(axis=0)
    right = (middle < 0) & (np.arange(k) < k - 1)
    pole = np.arange(k) + right
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(np.arange(k) < k - 1, gap / 2, gap))
    origin = d[pole]
    away = d[:, None] - origin
    left = np.arange(k)[:, None] <= np.arange(k)
    to_left, to_right = d - origin, upper - origin
    x = (low + high) / 2
    open_ = np.ones(k, bool)
    for _ in range(100):
        parts = weight[:, None] / (away - x)
        value = 1 + parts.sum(axis=0)
        slopes = parts / (away - x)
        below = np.where(left, slopes, 0).sum(axis=0)
        slope = slopes.sum(axis=0)
        # Done where the value is rounding error, of the sum or of the root itself.
        open_ &= np.abs(value) > EPS * (1 + np.abs(parts).sum(axis=0) + slope * np.abs(x))
        if not open_.any():
            break
        low, high = np.where(value < 0, x, low), np.where(value >= 0, x, high)
        at_left, at_right = to_left - x, to_right - x
        c = value - at_left * below - at_right * (slope - below)
        a = (at_left + at_right) * value - at_left * at_right * slope
        b = at_left * at_right * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new == x) | ((new > low) & (new < high)), new, (low + high) / 2)
        open_ &= new != x
        x = np.where(open_, new, x)
    return pole, x


def update(d: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of ``vectors diag(d) vectors' + rho v v'``."""
    z = vectors.T @ v
    if rho <= 0 or not z.any():
        return d, vectors
    d, vectors = d.copy(), vectors.copy()
    reached = deflate(d, z, vectors, rho)
    if not len(reached):
        return d, vectors
    poles, weights = d[reached], z[reached]
    pole, x = roots(poles, weights, rho)
    # distance[i, j] is pole i less root j, without cancellation.
    distance = (poles[:, None] - poles[pole]) - x
    # The z of which these roots are exact ones: with it the eigenvectors are orthogonal to working accuracy.
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    i = np.arange(len(poles))
    ratio = np.abs(distance)
    ratio[:, :-1] /= np.abs(np.where(i[:, None] > i[:-1], between[:, :-1], between[:, 1:]))
    exact = np.sqrt(np.prod(ratio, axis=1) / rho) * np.where(weights < 0, -1.0, 1.0)
    turn = exact[:, None] / distance
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, reached] = vectors[:, reached] @ turn
    d[reached] = poles[pole] + x
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


@dataclass
class Spectrum:
    """Rows seen, their mean, and ascending eigenvalues and the eigenvectors (columns) of their scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, np.zeros(dimension), np.zeros(dimension), np.eye(dimension))

    def _move(self, n: int, mean: np.ndarray) -> None:
        """Take in ``n`` rows that lie on their mean: a change along the line between the means."""
        both = self.n + n
        apart = mean - self.mean
        if self.n:
            self.values, self.vectors = update(self.values, self.vectors, apart, self.n * n / both)
        self.mean = self.mean + apart * (n / both)
        self.n = both

    def add(self, rows: np.ndarray, block: int = BLOCK) -> None:
        """Take in rows, in blocks. One centred change per row, after a block of more rows than
        dimensions has been turned into as many rows as it has dimensions (its triangular factor, of the same scatter)."""
        for first in range(0, len(rows), block):
            part = rows[first : first + block]
            mean = part.mean(axis=0)
            centred = part - mean
            if len(part) > part.shape[1]:
                centred = np.linalg.qr(centred, mode="r")
            if len(part) > 1:
                for row in centred:
                    self.values, self.vectors = update(self.values, self.vectors, row)
            self._move(len(part), mean)

    def merge(self, other: Spectrum) -> None:
        """Take in the rows of another spectrum: a change for each of its eigenvectors, and one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = update(self.values, self.vectors, vector, float(value))
        self._move(other.n, other.mean)
