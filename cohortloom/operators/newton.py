"""Logistic regressions of several training sides fitted together, by Newton's method.

A pass over the rows gives loss, gradient and Hessian of every side at its own point: a
task keeps their sums and sends one row for each side, and the sums are added by side.
The driver only solves systems of as many unknowns as a model has. A side's rows are
those outside its own part (a fold, a held-out type), or all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .moments import matrix_of

# Largest absolute gradient per training row that counts as zero.
TOLERANCE = 1e-11
# Bytes of Hessians that a task may hold for all sides.
HESSIAN_BYTES = 128 << 20
SLOPE = 1e-4


@dataclass(frozen=True)
class Side:
    """One fit: its part (its rows are those of all others; None: all), columns, scaler, classes, weights."""

    part: int | None
    columns: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    n: int

    @property
    def rows(self) -> int:
        """Rows of coefficients: one for two classes (the second's), else one for each."""
        return 1 if len(self.classes) == 2 and self.binary else len(self.classes)

    binary: bool = False


@dataclass(frozen=True)
class Solution:
    theta: np.ndarray
    passes: int
    residual: float


def fits(sides: Sequence[Side]) -> bool:
    """Whether the Hessians of all sides are small enough for this method."""
    return sum(8 * (s.rows * (len(s.columns) + 1)) ** 2 for s in sides) <= HESSIAN_BYTES


def terms(side: Side, x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of a side over some of its rows, without the penalty."""
    z = np.column_stack([(x[:, side.columns] - side.mean) / side.scale, np.ones(len(x))])
    own = np.searchsorted(side.classes, y)
    w = side.weights[own]
    u = z.shape[1]
    if side.rows == 1:
        s = z @ theta[0]
        # log(1 + exp(-m)) of the margin, without overflow
        m = np.where(own == 1, s, -s)
        loss = float((w * np.logaddexp(0.0, -m)).sum())
        p = np.exp(-np.logaddexp(0.0, -s))
        gradient = (z.T @ (w * (p - (own == 1))))[None]
        return loss, gradient, (z * (w * p * (1 - p))[:, None]).T @ z
    s = z @ theta.T
    top = s.max(axis=1, keepdims=True)
    e = np.exp(s - top)
    total = e.sum(axis=1, keepdims=True)
    p = e / total
    at = np.arange(len(x))
    loss = float((w * (np.log(total[:, 0]) + top[:, 0] - s[at, own])).sum())
    d = p.copy()
    d[at, own] -= 1
    gradient = (d * w[:, None]).T @ z
    k = side.rows
    hessian = np.empty((k * u, k * u))
    for a in range(k):
        for b in range(a + 1):
            q = w * p[:, a] * ((a == b) - p[:, b])
            hessian[a * u : (a + 1) * u, b * u : (b + 1) * u] = h = (z * q[:, None]).T @ z
            hessian[b * u : (b + 1) * u, a * u : (a + 1) * u] = h.T
    return loss, gradient, hessian


def _sums(rows: DataFrame, sides: dict[int, Side], points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """``terms`` of each side at its point over all its rows (``part, y, x``)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, y = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            x, _ = matrix_of(batch.column(2))
            for i, theta in points.items():
                use = np.ones(len(y), bool) if sides[i].part is None else part != sides[i].part
                if use.any():
                    loss, gradient, hessian = terms(sides[i], x[use], y[use], theta)
                    own = np.concatenate([[loss], gradient.ravel(), hessian.ravel()])
                    held[i] = held[i] + own if i in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["side", "sums"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table["sums"])
        return pa.table({"side": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    found = rows.select("part", "y", "x").mapInArrow(partial, "side int, sums binary").groupBy("side").applyInArrow(add, "side int, sums binary")
    out = {}
    for r in found.collect():  # one row per side
        v, shape = np.frombuffer(r["sums"], np.float64), points[r["side"]].shape
        u = shape[0] * shape[1]
        out[r["side"]] = (float(v[0]), v[1 : 1 + u].reshape(shape), v[1 + u :].reshape(u, u))
    return out


def solve(rows: DataFrame, sides: Sequence[Side], c: float, max_passes: int) -> list[Solution]:
    """Coefficients (last column: intercept) that minimise sum of weighted losses + |coefficients|^2 / (2c).

    ``rows`` is a written table of ``part int, y int, x array<double>``. All sides take
    their steps in the same passes; one that is done drops out. A step that does not
    lower the objective enough is halved. A side that needs more than ``max_passes``
    fails the fit.
    """
    by = dict(enumerate(sides))
    point = {i: np.zeros((s.rows, len(s.columns) + 1)) for i, s in by.items()}
    base: dict[int, tuple[np.ndarray, float, np.ndarray, float, float]] = {}
    done: dict[int, Solution] = {}
    for n_pass in range(1, max_passes + 1):
        for i, (loss, gradient, hessian) in _sums(rows, by, point).items():
            side, theta = by[i], point[i]
            pulled = theta.copy()
            pulled[:, -1] = 0.0  # the intercept is free
            loss += float((pulled**2).sum()) / (2 * c)
            gradient = gradient + pulled / c
            residual = float(np.abs(gradient).max()) / side.n
            if i in base:
                start, before, step, size, slope = base[i]
                # Near the optimum losses agree to rounding; there the gradient decides.
                if residual > TOLERANCE and loss > before + SLOPE * size * slope + 1e-12 * abs(before):
                    base[i] = (start, before, step, size / 2, slope)
                    point[i] = start + size / 2 * step
                    continue
            u = theta.shape[1]
            if residual <= TOLERANCE:
                done[i] = Solution(theta, n_pass, residual)
                del point[i]
                continue
            free = np.tile(np.append(np.ones(u - 1), 0.0), theta.shape[0])
            hessian = hessian + np.diag(free) / c
            if theta.shape[0] > 1:
                # Equal shifts of all intercepts change nothing; they are held at sum zero.
                at = np.arange(theta.shape[0]) * u + u - 1
                hessian[np.ix_(at, at)] += side.n / theta.shape[0]
            step = -np.linalg.solve(hessian, gradient.ravel()).reshape(theta.shape)
            if np.abs(step).max() <= 1e-14 * max(1.0, np.abs(theta).max()):
                done[i] = Solution(theta, n_pass, residual)  # no further digit to gain
                del point[i]
                continue
            base[i] = (theta, loss, step, 1.0, float((gradient * step).sum()))
            point[i] = theta + step
        if not point:
            return [done[i] for i in range(len(sides))]
    raise RuntimeError(f"{len(point)} of {len(sides)} fits did not converge in {max_passes} passes")
