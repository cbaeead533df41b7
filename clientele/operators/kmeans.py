"""k-means with k-means++ starts, many fits in shared passes (M5, M6).

Every pass over the points serves all fits that are still moving, so the
number of jobs does not depend on how many k and starts are tried.

Starts: the first centre is a hashed draw, each further one a draw with odds
in proportion to the squared distance D from the centres so far.  The draw is
the point of the least ``-ln(u) / D`` (u hashed from the point's md5 key, the
start and the step), which has exactly these odds and is one minimum over the
points.  The centres of a start are drawn one after the other, so the first k
of them start the fit for k.

Lloyd steps: sums per (fit, cluster) of coordinates rounded to multiples of
2^-24, so that centres do not depend on partitions or retries.  A fit ends
when its centres move by no more than ``tol`` times the mean variance of the
features, or after ``max_iter`` steps; a cluster that loses all its points
keeps its centre.  Ties go to the cluster drawn first.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import flat_lists, matrix, partitions_of, summed
from .boosting import uniform

SCALE = float(1 << 24)


@dataclass
class Clusters:
    centers: np.ndarray
    inertia: float

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return nearest(np.ascontiguousarray(x.T), self.centers)[0]


def nearest(columns: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of every point, given by columns; ties go to the first centre.

    One centre after the other on whole columns: all temporaries are one number a point and stay in the cache.
    """
    at, far = np.zeros(columns.shape[1], np.int64), None
    for i, center in enumerate(centers):
        distance = np.zeros(columns.shape[1])
        for column, c in zip(columns, center):
            part = column - c
            part *= part
            distance += part
        if far is None:
            far = distance
            continue
        np.putmask(at, distance < far, i)
        np.minimum(far, distance, out=far)
    return at, far


def race(keys: np.ndarray, start: int, step: int, weight: np.ndarray) -> np.ndarray:
    """Times of a race the points win with odds in proportion to ``weight``; infinite for weight 0."""
    u = (uniform(keys, start * 4096 + step) + np.uint64(1)).astype(np.float64) / float((1 << 53) + 1)
    return np.where(weight > 0, -np.log(u) / np.where(weight > 0, weight, 1), np.inf)


def _starts(points: DataFrame, k: int, starts: list[int]) -> dict[int, np.ndarray]:
    """The first ``k`` centres of every start, one pass per centre."""
    drawn: dict[int, list] = {i: [] for i in starts}
    for step in range(k):
        shared = points.sparkSession.sparkContext.broadcast({i: np.array(c) for i, c in drawn.items()})

        def run(batches):
            best: dict[int, tuple] = {}
            for batch in batches:
                for n, x, key in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "key"))):
                    m, keys = matrix(x, n), np.frombuffer(key, np.int64)
                    columns = np.ascontiguousarray(m.T)
                    for i, centers in shared.value.items():
                        time = race(keys, i, step, nearest(columns, centers)[1] if len(centers) else np.ones(n))
                        ties = np.flatnonzero(time == time.min())
                        first = ties[keys[ties].argmin()]
                        found = (float(time[first]), int(keys[first]), m[first].tolist())
                        if i not in best or found < best[i]:
                            best[i] = found
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), *[pa.array([b[j] for b in best.values()], t) for j, t in enumerate(
                (pa.float64(), pa.int64(), pa.list_(pa.float64())))]], names=["start", "time", "key", "x"])

        # one row per task and start; the least of them per start is kept in executors
        found = points.mapInArrow(run, "start int, time double, key long, x array<double>").groupBy("start").agg(
            F.min(F.struct("time", "key", "x")).alias("b")).collect()
        for r in found:
            # With fewer distinct points than centres the last centre repeats.
            drawn[r["start"]].append(r["b"]["x"] if np.isfinite(r["b"]["time"]) else drawn[r["start"]][-1])
    return {i: np.array(c) for i, c in drawn.items()}


def _step(points: DataFrame, fits: dict[tuple, np.ndarray], partitions: int) -> dict[tuple, np.ndarray]:
    """{fit: (clusters, coordinates + 2) whole numbers}: coordinate sums, points and squared distances per cluster."""
    shared = points.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist()):
                columns = np.ascontiguousarray(matrix(x, n).T)
                whole = np.rint(columns * SCALE)
                for fit, centers in shared.value.items():
                    at, far = nearest(columns, centers)
                    sums = [np.bincount(at, weights=w, minlength=len(centers)) for w in (*whole, np.rint(far * SCALE))]
                    own = np.stack([*sums[:-1], np.bincount(at, minlength=len(centers)), sums[-1]], axis=1).astype(np.int64)
                    totals[fit] = totals[fit] + own if fit in totals else own
        for (k, i), v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary())],
                                             names=["k", "start", "values"])
    found = summed(points.mapInArrow(run, "k int, start int, values binary"), ["k", "start"], partitions)
    return {fit: v.reshape(fit[0], -1) for fit, v in found}


def train(points: DataFrame, ks: list[int], starts: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> dict[int, Clusters]:
    """Best of ``starts`` fits for each k; ``points`` are blocks (one fit set)."""
    numbers = [seed * 1000 + i for i in range(starts)]
    partitions = partitions_of(points)
    if not partitions:
        return {}
    points = points.select("n", "x", "key").persist()
    first = _starts(points, max(ks), numbers)
    moving = {(k, i): first[i][:k] for k in ks for i in numbers}
    done: dict[tuple, Clusters] = {}
    limit, resting = None, {}
    for step in range(max_iter + 1):
        if not moving and not resting:
            break
        sums = _step(points, moving | resting, partitions)
        if limit is None:
            limit = tol * _mean_variance(points)
        for fit in resting:
            done[fit] = Clusters(resting[fit], float(sums[fit][:, -1].sum()) / SCALE)
        following, resting = {}, {}
        for fit, centers in moving.items():
            total = sums[fit]
            if step == max_iter:
                done[fit] = Clusters(centers, float(total[:, -1].sum()) / SCALE)
                continue
            n = total[:, -2:-1]
            new = np.where(n > 0, total[:, :-2] / SCALE / np.maximum(n, 1), centers)
            (resting if ((new - centers) ** 2).sum() <= limit else following)[fit] = new
        moving = following
    points.unpersist()
    return {k: min((done[k, i] for i in numbers), key=lambda c: c.inertia) for k in ks}


def _mean_variance(points: DataFrame) -> float:
    def run(batches):
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist()):
                m = matrix(x, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1]), pa.int64()), pa.array(m.sum(axis=0)), pa.array((m * m).sum(axis=0)),
                                                  pa.array([n] * m.shape[1], pa.int64())], names=["j", "s", "q", "n"])
    found = points.mapInArrow(run, "j long, s double, q double, n long").groupBy("j").agg(F.sum("s"), F.sum("q"), F.sum("n")).collect()
    return float(np.mean([q / n - (s / n) ** 2 for _, s, q, n in found]))


def with_cluster(model: Clusters, rows: DataFrame, x_col: str, out_col: str) -> DataFrame:
    """``rows`` with the number of each row's nearest centre."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    inner = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("kept"), F.col(x_col).alias("x"))

    def run(batches):
        for batch in batches:
            at = shared.value.nearest(flat_lists(batch.column("x"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(at.astype(np.int32))], names=["kept", "out"])
    out = inner.mapInArrow(run, f"kept {inner.schema['kept'].dataType.simpleString()}, out int")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in rows.columns], F.col("out").alias(out_col))
