"""Tree ensembles as flat arrays: scoring and exact path-dependent attributions, in Arrow batches.

Attributions (M28): a leaf reached over m distinct features adds to feature j,
for a row that passes the splits of a subset of them, the Shapley value of the
game in which the other features follow the row or, left out, split by the
training rows' shares.  As a leaf's m splits are passed or not, there are at
most 2^m such games per leaf; their values are worked out once per leaf and
batch of rows, and every row looks its own up.  They add up to the row's score
less the expected score.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import flat_lists


@dataclass
class Trees:
    """Nodes of all trees in a row: ``feature`` < 0 marks a leaf; a row goes left if x[feature] <= threshold.

    ``cover`` is the training weight of a node, ``gain`` that of its split; ``value`` counts for leaves only.
    """
    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray
    base: float = 0.0
    logistic: bool = True
    info: dict = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values."""
        out = np.full(len(x), self.base)
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        # A leaf leads to itself, so all rows take as many steps as the deepest tree has levels.
        own, leaf = np.arange(len(self.feature)), self.feature < 0
        feature, following = np.maximum(self.feature, 0), np.column_stack([np.where(leaf, own, self.left), np.where(leaf, own, self.right)]).ravel()
        for root, levels in zip(self.root.tolist(), self.depths()):
            at = np.full(len(x), root)
            for _ in range(levels):
                goes_left = flat[first + feature[at]] <= self.threshold[at]
                at = following[2 * at + ~goes_left]
            out += self.value[at]
        return out

    def depths(self) -> list[int]:
        """Levels below the root of every tree."""
        out, tree = [0] * len(self.root), np.arange(len(self.root))
        at, level = self.root, 0
        while len(at):
            inner = self.feature[at] >= 0
            at, tree, level = at[inner], tree[inner], level + 1
            for t in np.unique(tree).tolist():
                out[t] = level
            at, tree = np.concatenate([self.left[at], self.right[at]]), np.tile(tree, 2)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return 1 / (1 + np.exp(-raw)) if self.logistic else raw

    def importance(self, features: int, average: bool = False) -> np.ndarray:
        """Share of each feature in the gains of all splits, or in the average gain per split."""
        inner = self.feature >= 0
        gains = np.bincount(self.feature[inner], weights=self.gain[inner], minlength=features)
        if average:
            gains = gains / np.maximum(np.bincount(self.feature[inner], minlength=features), 1)
        return gains / gains.sum() if gains.sum() > 0 else gains

    def expected(self) -> float:
        """Expected raw score when no feature is known."""
        share, total = {int(r): 1.0 for r in self.root}, self.base
        stack = [int(r) for r in self.root]
        while stack:
            at = stack.pop()
            if self.feature[at] < 0:
                total += share[at] * float(self.value[at])
                continue
            for child in (int(self.left[at]), int(self.right[at])):
                share[child] = share[at] * float(self.cover[child] / self.cover[at])
                stack.append(child)
        return total

    def paths(self):
        """(value, features, lower bounds, upper bounds, shares) of every leaf; a row passes a feature if
        lower < x <= upper, and ``shares`` says how the training rows divide at its splits."""
        for root in self.root.tolist():
            stack = [(root, {})]
            while stack:
                at, path = stack.pop()
                if self.feature[at] < 0:
                    f = sorted(path)
                    yield (float(self.value[at]), np.array(f, np.int64), np.array([path[j][0] for j in f]),
                           np.array([path[j][1] for j in f]), np.array([path[j][2] for j in f]))
                    continue
                j, cut = int(self.feature[at]), float(self.threshold[at])
                low, high, share = path.get(j, (-np.inf, np.inf, 1.0))
                for child, bounds in ((int(self.left[at]), (low, min(high, cut))), (int(self.right[at]), (max(low, cut), high))):
                    stack.append((child, {**path, j: (*bounds, share * float(self.cover[child] / self.cover[at]))}))


# Leaves whose games are worked out together (16 MB of values at 8 features).
LEAVES = 1024


def leaf_games(value: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Attribution of leaves to each of their m features for all 2^m sets of passed features (bit j: feature j passed).

    A subset of k of the other m - 1 features weighs k! (m - 1 - k)! / m!, which is the integral over 0..1 of
    t^k (1 - t)^(m - 1 - k).  So the weighted sum over the subsets is the integral of the product, over the other
    features, of share * (1 - t) + passed * t: a polynomial of degree m - 1, for which ceil(m / 2) points are exact.
    """
    m = shares.shape[1]
    passed = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    out = np.zeros((len(shares), 1 << m, m))
    for t, weight in zip((points + 1) / 2, weights / 2):
        factors = shares[:, None, :] * (1 - t) + passed * t
        out += weight * factors.prod(axis=2, keepdims=True) / factors
    return value[:, None, None] * (passed - shares[:, None, :]) * out


def attributions(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Exact path-dependent attribution of the raw score of every row to every feature."""
    out = np.zeros(x.shape)
    for features, low, high, table in leaf_tables(trees):
        inside = (x[:, features] > low) & (x[:, features] <= high)
        out[:, features] += table[inside @ (1 << np.arange(len(features)))]
    return out


def leaf_tables(trees: Trees) -> Iterable[tuple]:
    """(features, lower bounds, upper bounds, games) of every leaf below a split, LEAVES at a time."""
    held: dict[int, list] = {}

    def ready(leaves):
        games = leaf_games(np.array([v for v, *_ in leaves]), np.array([shares for *_, shares in leaves]))
        yield from ((f, low, high, table) for (_, f, low, high, _), table in zip(leaves, games))
    for leaf in trees.paths():
        if m := len(leaf[1]):
            held.setdefault(m, []).append(leaf)
            if len(held[m]) == LEAVES:
                yield from ready(held.pop(m))
    for leaves in held.values():
        yield from ready(leaves)


def with_score(model: Trees, rows: DataFrame, x_col: str, score_col: str = "score") -> DataFrame:
    """``rows`` with the model's probability of class 1; one pass, the model is broadcast (a few MB)."""
    return _with_column(rows, model, x_col, score_col, "double", lambda m: m.probability)


def with_attributions(model: Trees, rows: DataFrame, x_col: str, out_col: str = "attribution") -> DataFrame:
    """``rows`` with the attribution of each row's raw score to each feature (array<double>)."""
    return _with_column(rows, model, x_col, out_col, "array<double>", lambda m: lambda x: attributions(m, x))


def _with_column(rows: DataFrame, model, x_col: str, out_col: str, out_type: str, bind) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)
    inner = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("kept"), F.col(x_col).cast("array<double>").alias("x"))

    def run(batches):
        apply = bind(shared.value)
        for batch in batches:
            got = apply(flat_lists(batch.column("x"))) if batch.num_rows else np.zeros(0)
            values = pa.array(got) if got.ndim == 1 else pa.array(got.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), values], names=["kept", "out"])

    out = inner.mapInArrow(run, f"kept {inner.schema['kept'].dataType.simpleString()}, out {out_type}")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in rows.columns], F.col("out").alias(out_col))
