"""Logistic regression with a penalised intercept by Newton steps (M8).

Minimises ``C * sum(log loss) + |w|^2 / 2`` over the weights and the
intercept, which is one more weight (of a constant 1).  A step is one
aggregate of the (d + 1) x (d + 1) weighted Gram matrix and the gradient over
the rows, for all fit sets at once; the small systems are solved on the
driver.  A step that would raise the objective is halved.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import matrix, partitions_of, summed

STEPS = 200


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    def importance(self, features: int) -> np.ndarray:
        return np.abs(self.weights)


def loss_terms(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log loss, gradient and Hessian of some rows (a constant 1 is added to ``x``)."""
    x = np.column_stack([x, np.ones(len(x))])
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return float(np.logaddexp(0, np.where(y == 1, -z, z)).sum()), x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def _pass(blocks: DataFrame, at: dict[int, np.ndarray], partitions: int) -> dict[int, tuple]:
    shared = blocks.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        totals: dict[int, list] = {}
        for batch in batches:
            for s, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("fit_set", "n", "x", "y"))):
                if s in shared.value:
                    f, g, h = loss_terms(shared.value[s], matrix(x, n), np.frombuffer(y, np.uint8))
                    own = np.concatenate([[f], g, h.ravel()])
                    totals[s] = totals[s] + own if s in totals else own
        for s, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["fit_set", "values"])

    out = {}
    for (s,), v in summed(blocks.mapInArrow(run, "fit_set int, values binary"), ["fit_set"], partitions, np.float64):
        d = len(at[s])
        out[s] = v[0], v[1:d + 1], v[d + 1:].reshape(d, d)
    return out


def train(blocks: DataFrame, c: float = 1.0, steps: int = STEPS, tolerance: float = 1e-12) -> dict[int, Linear]:
    """A model per fit set; the passes are shared by all that have not converged."""
    sizes = {r["fit_set"]: len(r["x"]) // 8 // r["n"] for r in blocks.groupBy("fit_set").agg({"x": "first", "n": "first"}).toDF(
        *["fit_set", "x", "n"]).collect()} if blocks.limit(1).count() else {}
    partitions = partitions_of(blocks)
    best = {s: None for s in sizes}     # (weights, objective, gradient, Hessian)
    trial = {s: np.zeros(d + 1) for s, d in sizes.items()}
    step: dict[int, np.ndarray] = {}
    for _ in range(steps):
        if not trial:
            break
        for s, (loss, g, h) in _pass(blocks, trial, partitions).items():
            w = trial.pop(s)
            value = c * loss + w @ w / 2
            if best[s] is None or value <= best[s][1]:
                g, h = c * g + w, c * h + np.eye(len(w))
                best[s] = w, value
                # Solved in units of each weight's own curvature: features may differ by many powers of ten.
                unit = 1 / np.sqrt(np.diag(h))
                step[s] = unit * np.linalg.solve(h * np.outer(unit, unit), unit * g)
                if step[s] @ g <= tolerance * (1 + abs(value)):
                    continue
            else:
                step[s] = step[s] / 2
                if np.abs(step[s]).max() <= 1e-16 * (1 + np.abs(best[s][0]).max()):
                    continue
            trial[s] = best[s][0] - step[s]
    return {s: Linear(b[0][:-1], float(b[0][-1])) for s, b in best.items()}
