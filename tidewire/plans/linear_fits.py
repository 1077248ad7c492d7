"""Many penalised logistic models over the same rows, fitted together.

A fit that runs one job per gradient step reads the rows hundreds of times, and a
cross-validated path does so for every fold and strength. With few features the
second-order sums are small, so here one pass over the rows gives loss, gradient
and curvature of all models at once, and Newton steps need about ten passes in
all. Tasks add up their rows; only sums, whose size depends on the number of
models and features but not of rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FitSpec:
    """One model: its features, penalties, class weights and the fold it must not see.

    Minimises the weighted log loss plus l2 / 2 * |w|^2 + l1 * |w|; the intercept is
    free.
    """

    features: tuple[str, ...]
    class_weights: tuple[float, float] = (1.0, 1.0)
    l2: float = 0.0
    l1: float = 0.0
    left_out: int = -1


class NotConverged(RuntimeError):
    """A fit whose optimality conditions do not hold within the tolerance."""


def _partial_sums(columns: Sequence[str], weights: np.ndarray, left_out: np.ndarray, coefficients: np.ndarray):
    n_models, width = coefficients.shape

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss = np.zeros(n_models)
        gradient = np.zeros((n_models, width))
        curvature = np.zeros((n_models, width, width))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), batch[list(columns)].to_numpy(dtype=float)])
            y = batch["_y"].to_numpy(dtype=float)[:, None]
            margin = x @ coefficients.T
            weight = np.where(y == 1, weights[:, 1], weights[:, 0])
            weight = weight * (batch["_fold"].to_numpy()[:, None] != left_out)
            prob = 0.5 * (1 + np.tanh(margin / 2))
            loss += (weight * (np.logaddexp(0, margin) - y * margin)).sum(axis=0)
            gradient += (weight * (prob - y)).T @ x
            spread = weight * prob * (1 - prob)
            for m in range(n_models):
                curvature[m] += (x * spread[:, m : m + 1]).T @ x
        flat = np.concatenate([loss[:, None], gradient, curvature.reshape(n_models, -1)], axis=1)
        yield pd.DataFrame({"model": np.arange(n_models, dtype=np.int32), "sums": list(flat)})

    return add_up


def _all_sums(rows: DataFrame, columns, weights, left_out, coefficients) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_models, width = coefficients.shape
    partial = rows.mapInPandas(
        _partial_sums(columns, weights, left_out, coefficients), "model int, sums array<double>"
    )
    totals = (
        partial.select("model", array_to_vector("sums").alias("sums"))
        .groupBy("model")
        .agg(vector_to_array(Summarizer.sum(F.col("sums"))).alias("sums"))
        .collect()
    )
    flat = np.zeros((n_models, 1 + width + width * width))
    for row in totals:
        flat[row["model"]] = row["sums"]
    return flat[:, 0], flat[:, 1 : 1 + width], flat[:, 1 + width :].reshape(n_models, width, width)


def _best_steps(coefficients, gradient, curvature, l2, l1, used) -> np.ndarray:
    """The minimum of each model's quadratic approximation, less the current point."""
    penalised = np.where(np.arange(coefficients.shape[1]) > 0, 1.0, 0.0)
    gradient = gradient + l2[:, None] * penalised * coefficients
    curvature = curvature + l2[:, None, None] * np.diag(penalised)
    if not l1.any():
        off = ~used
        square = curvature.copy()
        square[off[:, :, None] | off[:, None, :]] = 0.0
        model, place = np.nonzero(off)
        square[model, place, place] = 1.0
        return -np.linalg.solve(square, np.where(used, gradient, 0.0)[:, :, None])[:, :, 0]
    return np.stack(
        [_l1_step(*m) for m in zip(coefficients, gradient, curvature, l1[:, None] * penalised, used)]
    )


def _l1_step(start, gradient, curvature, penalty, used) -> np.ndarray:
    """One model's step by an active set: solve for the nonzero coefficients with
    their signs held, drop the first one that would change sign, and let in the zero
    that most wants to move, until neither happens."""
    point = start.copy()
    support = used & ((point != 0) | (penalty == 0))
    signs = np.sign(point) * (penalty > 0)
    for turn in range(100 * len(point) + 1):
        if turn == 100 * len(point):
            raise NotConverged(f"active set of {len(point)} coefficients after {turn} rounds")
        step = np.where(support, 0.0, -start)
        wanted = -(gradient + penalty * signs + curvature @ step)[support]
        step[support] = np.linalg.lstsq(curvature[np.ix_(support, support)], wanted, rcond=None)[0]
        target = np.where(support, start + step, 0.0)
        crossing = support & (penalty > 0) & (np.sign(target) != signs)
        if crossing.any():
            reach = np.full(len(point), np.inf)
            reach[crossing] = point[crossing] / (point - target)[crossing]
            first = int(np.argmin(reach))
            point = point + reach[first] * (target - point)
            point[first], signs[first], support[first] = 0.0, 0.0, False
            continue
        point = target
        slope = gradient + curvature @ (point - start)
        excess = np.where(used & ~support, np.abs(slope) - penalty, -np.inf)
        most = int(np.argmax(excess))
        if excess[most] <= 1e-9 * (1 + penalty[most]):
            break
        support[most], signs[most] = True, -np.sign(slope[most])
    return point - start


def kkt_residual(point, gradient, l2, l1, used) -> np.ndarray:
    """The largest violation of each model's optimality conditions."""
    penalised = np.where(np.arange(point.shape[1]) > 0, 1.0, 0.0)
    slope = gradient + l2[:, None] * penalised * point
    bound = l1[:, None] * penalised
    at_zero = np.maximum(np.abs(slope) - bound, 0)
    violation = np.where(point != 0, np.abs(slope + bound * np.sign(point)), at_zero)
    return np.where(used, violation, 0.0).max(axis=1)


def fit_together(
    rows: DataFrame,
    columns: Sequence[str],
    label: str,
    specs: Sequence[FitSpec],
    fold: str | None = None,
    max_steps: int = 60,
    tolerance: float = 1e-8,
) -> list[tuple[float, dict[str, float]]]:
    """Intercept and coefficients by feature name for every spec.

    ``rows`` should be cached: every step reads them once. A step that makes a
    model worse is halved for that model. Fits end when the optimality conditions
    of all models hold: no partial derivative is above ``tolerance`` times the total
    weight of the rows (for an L1 penalty, beyond what the penalty holds back).
    NotConverged is raised when ``max_steps`` do not get there.
    """
    ready = rows.select(
        *columns,
        F.col(label).cast("double").alias("_y"),
        (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold"),
    )
    used = np.array([[True, *[c in s.features for c in columns]] for s in specs])
    weights = np.array([s.class_weights for s in specs])
    left_out = np.array([s.left_out for s in specs])
    l2, l1 = np.array([s.l2 for s in specs]), np.array([s.l1 for s in specs])

    def measure(point):
        loss, gradient, curvature = _all_sums(ready, columns, weights, left_out, point)
        size = point[:, 1:]
        return loss + l2 / 2 * (size**2).sum(axis=1) + l1 * np.abs(size).sum(axis=1), gradient, curvature

    point = np.zeros((len(specs), len(columns) + 1))
    value, gradient, curvature = measure(point)
    step = _best_steps(point, gradient, curvature, l2, l1, used)
    total = value / np.log(2)  # at zero every row loses ln 2 times its weight
    share = np.ones(len(specs))
    for turn in range(max_steps + 1):
        residual = kkt_residual(point, gradient, l2, l1, used) / np.maximum(total, 1e-300)
        if (residual <= tolerance).all():
            break
        if turn == max_steps:
            raise NotConverged(f"{int((residual > tolerance).sum())} of {len(specs)} models after {max_steps} steps, residual {residual.max():.3g}")
        tried = point + share[:, None] * step
        new_value, new_gradient, new_curvature = measure(tried)
        better = new_value <= value + 1e-12 * np.abs(value)
        point = np.where(better[:, None], tried, point)
        value = np.where(better, new_value, value)
        gradient = np.where(better[:, None], new_gradient, gradient)
        curvature = np.where(better[:, None, None], new_curvature, curvature)
        share = np.where(better, 1.0, share / 2)
        step = _best_steps(point, gradient, curvature, l2, l1, used)
    return [(float(p[0]), {c: float(v) for c, v in zip(columns, p[1:]) if c in s.features}) for p, s in zip(point, specs)]
