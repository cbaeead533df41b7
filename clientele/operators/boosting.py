"""Gradient boosting of many models in shared passes.

All fit sets of a booster grow together: a round grows one tree of each, level
by level, and a level is one pass over the rows for all of them, so the number
of jobs a round depends on the depth of the trees alone.  Boosters run side by
side in threads of their own.  A pass gives, per (fit set, node, feature,
bin), the sums of gradients, hessians and rows; only the smaller of two siblings is summed, the other is the
parent's less its sibling's.  Splits are chosen on the driver from these sums
(their size is set by boosters, leaves and bins, not by the rows).

Gradients are rounded to multiples of 2^-30 before they are added, so sums are
whole numbers: the trees do not depend on partitions or retries, and any other
program that adds the same numbers finds the same splits.  (At most 8 * 10^9
rows of one sign per fit set fit the sums.)

Features share a byte as long as its 256 values are enough for all their bins (eight columns of zeros and ones, say): a
pass sums over the values of the bytes, and the sums of a feature's bins are added up from these.  The rows of a node
are a list of row numbers, cut in two by each split, so a row is only looked at for the nodes that it is summed for.

A pass is one job over a persisted RDD of numpy arrays.  Fit sets of at most
``FIT_ROWS`` rows take no passes: a task grows all trees of one of them.  Scores of all rows are carried in it
from round to round and checkpointed every ``CHECKPOINT_ROUNDS`` rounds; a lost executor costs the
rounds since.

Two kinds of trees:
  * best-first: of all splits down to ``depth`` the best by gain is made first, until there are ``leaves`` leaves
    (gains do not depend on the order, so the levels are searched first and the queue is run on the driver)
  * level by level to ``depth``, on a share of rows and of features drawn by hash for each tree
"""
from __future__ import annotations

import heapq
import hashlib
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import matrix
from .trees import Trees

SCALE = float(1 << 30)
MAX_BINS = 255
CHECKPOINT_ROUNDS = 25
# Fit sets of up to so many rows (about 100 MB with gradients and row numbers) are boosted whole, a task per fit set and
# booster: on a few cores the jobs of their passes would take longer than the sums.  Larger ones stay dealt over all
# tasks; both ways give the same trees.
FIT_ROWS = 1 << 21
# Rows dealt together; rows of a task at most (fewer while there are idle cores) and at least.
SLICE_ROWS, TASK_ROWS, LEAST_ROWS = 256, 1 << 20, 2048
# Tasks whose histograms may come to the driver unsummed; of more they are summed in executors first.
DIRECT_PARTITIONS = 16
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Booster:
    name: str
    rounds: int
    rate: float
    depth: int
    leaves: int | None = None      # best-first up to so many leaves; None: level by level
    min_rows: int = 1              # rows of a leaf at least
    min_hessian: float = 1e-3      # hessian sum of a leaf at least
    l2: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    prior: bool = True             # start from the log-odds of the labels, else from 0


def bin_edges(blocks: DataFrame, max_bins: int = MAX_BINS) -> dict[int, list[np.ndarray]]:
    """Thresholds between the bins of every (fit set, feature): midpoints between its ``max_bins`` quantiles.

    The quantiles' rank error is below 1 / 100,000; on smaller tables they are exact.
    """
    def cells(batches):
        for batch in batches:
            for s, n, x in zip(batch.column("fit_set").to_pylist(), batch.column("n").to_pylist(), batch.column("x").to_pylist()):
                m = matrix(x, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m.size, s, np.int32)), pa.array(np.tile(np.arange(m.shape[1], dtype=np.int32), n)), pa.array(m.ravel())],
                    names=["fit_set", "j", "value"])
    levels = F.array(*[F.lit(i / (max_bins - 1)) for i in range(max_bins)])
    found = blocks.select("fit_set", "n", "x").mapInArrow(cells, "fit_set int, j int, value double").groupBy("fit_set", "j").agg(
        F.percentile_approx("value", levels, 100_000).alias("q"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in found.collect():  # fit sets x features rows
        q = np.unique(r["q"])
        out.setdefault(r["fit_set"], {})[r["j"]] = (q[:-1] + q[1:]) / 2
    return {s: [by[j] for j in sorted(by)] for s, by in out.items()}


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (wraps modulo 2^64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def uniform(keys: np.ndarray, tree: int) -> np.ndarray:
    """A draw from [0, 2^53) per row from its md5 key and the tree's number."""
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.uint64) + _GOLDEN * np.uint64(tree + 1)) >> np.uint64(11)


def drawn(keys: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree is grown on."""
    return uniform(keys, tree) < int(share * (1 << 53))


def drawn_columns(features: int, tree: int, share: float) -> np.ndarray:
    """Features a tree may split on: the first share of them by md5 of (feature, tree)."""
    order = sorted(range(features), key=lambda j: hashlib.md5(f"{j}|{tree}".encode()).hexdigest())
    return np.sort(order[:max(1, int(share * features))])


def gradients(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss in multiples of 1 / SCALE."""
    p = 1 / (1 + np.exp(-f))
    return np.rint((p - y) * SCALE), np.rint(p * (1 - p) * SCALE)


@dataclass
class Growing:
    """A tree while it grows; nodes are numbered 0, 1, ... with the children of a split behind each other."""
    feature: list
    bin: list
    child: list          # left child, right is the next; -1: none yet
    sums: list           # (gradient, hessian, rows) in whole numbers
    gain: list
    sibling: dict        # node to be summed next -> (its sibling, their parent)

    @classmethod
    def start(cls):
        return cls([-1], [0], [-1], [None], [0.0], {})

    def arrays(self):
        return np.array(self.feature), np.array(self.bin), np.array(self.child)


@dataclass(frozen=True)
class Packing:
    """How the bins of several features share a byte: byte ``group[j]`` holds ``unit[j]`` times the bin of feature j."""
    group: np.ndarray
    unit: np.ndarray
    first: np.ndarray    # first bin of each feature, and the end

    @classmethod
    def of(cls, first: np.ndarray):
        width = np.diff(first)
        group, unit, groups, size = np.zeros(len(width), np.int64), np.ones(len(width), np.int64), -1, 257
        for j in np.argsort(width, kind="stable").tolist():  # few bins first
            if size * int(width[j]) > 256:
                groups, size = groups + 1, 1
            group[j], unit[j] = groups, size
            size *= int(width[j])
        return cls(group, unit, np.asarray(first))

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """The bytes (groups x rows) of the rows' bins (features x rows)."""
        out = np.zeros((int(self.group.max()) + 1, bins.shape[1]), np.uint8)
        for j, own in enumerate(bins):
            out[self.group[j]] += own * np.uint8(self.unit[j])
        return out

    def dealt(self, codes: np.ndarray, rows: np.ndarray, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the left and of the right child of a split."""
        right = np.arange(256) // self.unit[feature] % (self.first[feature + 1] - self.first[feature]) > cut
        goes = right.take(codes[self.group[feature]].take(rows))
        return rows.compress(~goes), rows.compress(goes)  # several times as fast as a mask as an index

    def sums(self, codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(bins of all features, 3) sums of gradients, hessians and rows of a node's rows."""
        out, g, h = np.empty((int(self.first[-1]), 3), np.int64), g.take(rows), h.take(rows)
        for i, own in enumerate(codes):
            own, members = own.take(rows).astype(np.intp), np.flatnonzero(self.group == i)
            size = math.prod((self.first[members + 1] - self.first[members]).tolist())
            found = np.stack([np.bincount(own, weights, size) for weights in (g, h, None)]).astype(np.int64)
            for j in members.tolist():
                lo, hi = int(self.first[j]), int(self.first[j + 1])
                out[lo:hi] = found.reshape(3, -1, hi - lo, int(self.unit[j])).sum(axis=(1, 3)).T
        return out

    def values(self, tree: tuple, codes: np.ndarray) -> np.ndarray:
        """Value of every row in a finished tree."""
        feature, cut, child, value = tree
        out, todo = np.empty(codes.shape[1]), [(0, np.arange(codes.shape[1]))]
        while todo:
            at, rows = todo.pop()
            if child[at] < 0:
                out[rows] = value[at]
            else:
                todo += zip((child[at], child[at] + 1), self.dealt(codes, rows, feature[at], cut[at]))
        return out


def rows_of(packing: Packing, tree: Growing, codes: np.ndarray, nodes: list[int], rows: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of some nodes of a tree as it is; ``rows`` are those of its root."""
    above = {c + i: at for at, c in enumerate(tree.child) if c >= 0 for i in (0, 1)}
    needed = set(nodes)
    for at in nodes:
        while at in above:
            at = above[at]
            needed.add(at)
    found, todo = {}, [(0, rows)]
    while todo:
        at, rows = todo.pop()
        if at in nodes:
            found[at] = rows
        elif at in needed:
            todo += zip((tree.child[at], tree.child[at] + 1), packing.dealt(codes, rows, tree.feature[at], tree.bin[at]))
    return found


def best_split(hist: np.ndarray, starts: np.ndarray, config: Booster, columns: np.ndarray | None):
    """(gain, feature, bin, sums of the left child) of a node's best split, or None.

    ``hist``: (bins of all features, 3) whole numbers; ``starts``: first bin of each feature, and the end.
    Ties go to the first feature, then the first bin.
    """
    run = np.cumsum(hist, axis=0)
    total = run[starts[1] - 1]
    before = np.vstack([np.zeros((1, 3), np.int64), run])[starts[:-1]]
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    left = run - before[of]
    right = total - left
    gl, hl, gr, hr = left[:, 0] / SCALE, left[:, 1] / SCALE, right[:, 0] / SCALE, right[:, 1] / SCALE
    ok = (left[:, 2] >= config.min_rows) & (right[:, 2] >= config.min_rows) & (hl >= config.min_hessian) & (hr >= config.min_hessian)
    ok[starts[1:] - 1] = False
    if columns is not None:
        ok &= np.isin(of, columns)
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    g, h = total[0] / SCALE, total[1] / SCALE
    gain = gl[at] ** 2 / (hl[at] + config.l2) + gr[at] ** 2 / (hr[at] + config.l2) - g * g / (h + config.l2)
    k = int(np.argmax(gain))
    if gain[k] <= 1e-6:
        return None
    b = int(at[k])
    return float(gain[k]), int(of[b]), int(b - starts[of[b]]), left[b].copy()


def finished(tree: Growing, config: Booster) -> list[bool]:
    """Which nodes of a fully searched tree are split: all, or the best first up to the number of leaves."""
    made = [False] * len(tree.feature)
    if config.leaves is None:
        return [c >= 0 for c in tree.child]
    queue, leaves = [(-tree.gain[0], 0)] if tree.child[0] >= 0 else [], 1
    while queue and leaves < config.leaves:
        _, at = heapq.heappop(queue)
        made[at] = True
        leaves += 1
        for child in (tree.child[at], tree.child[at] + 1):
            if tree.child[child] >= 0:
                heapq.heappush(queue, (-tree.gain[child], child))
    return made


def closed(tree: Growing, config: Booster) -> tuple:
    """(feature, bin, child, value, cover, gain) arrays of the finished tree, unmade splits taken back."""
    made = finished(tree, config)
    order, at = [0], 0
    while at < len(order):
        if made[order[at]]:
            order += [tree.child[order[at]], tree.child[order[at]] + 1]
        at += 1
    place = {node: i for i, node in enumerate(order)}
    sums = np.array([tree.sums[n] for n in order], np.float64) / [SCALE, SCALE, 1]
    return (np.array([tree.feature[n] if made[n] else -1 for n in order]), np.array([tree.bin[n] for n in order]),
            np.array([place[tree.child[n]] if made[n] else -1 for n in order]),
            -config.rate * sums[:, 0] / (sums[:, 1] + config.l2), sums[:, 2], np.array([tree.gain[n] if made[n] else 0.0 for n in order]))


def _packings(edges: dict) -> dict[int, Packing]:
    return {s: Packing.of(np.append(0, np.cumsum([len(e) + 1 for e in own]))) for s, own in edges.items()}


def _slices(blocks: DataFrame, edges: dict) -> RDD:
    """(number, (fit set, packed bins, labels, keys)) of every SLICE_ROWS rows of a block."""
    shared = blocks.sparkSession.sparkContext.broadcast((edges, _packings(edges)))

    def sliced(index, rows):
        number, (edges, packings) = index, shared.value
        for s, n, x, y, key in rows:
            m, y, key = matrix(x, n), np.frombuffer(y, np.uint8), np.frombuffer(key, np.int64)
            codes = packings[s].codes(np.stack([np.searchsorted(e, m[:, j], side="left") for j, e in enumerate(edges[s])]).astype(np.uint8))
            for lo in range(0, n, SLICE_ROWS):
                part = slice(lo, lo + SLICE_ROWS)
                yield number, (s, codes[:, part], y[part], key[part])
                number += 1

    # Blocks are stored, so a slice has the same number in every attempt.
    return blocks.select("fit_set", "n", "x", "y", "key").rdd.mapPartitionsWithIndex(sliced)


def _state(blocks: DataFrame, edges: dict, partitions: int) -> RDD:
    """(fit set, packed bins, labels, keys) of the blocks' rows, dealt evenly to ``partitions``.

    A partition holds one entry per fit set, so that a pass makes few and large numpy calls."""
    def joined(slices):
        held: dict[int, list] = {}
        for _, (s, *part) in slices:
            held.setdefault(s, []).append(part)
        for s in sorted(held):
            codes, y, key = zip(*held.pop(s))
            yield s, np.concatenate(codes, axis=1), np.concatenate(y), np.concatenate(key)

    return _slices(blocks, edges).partitionBy(partitions).mapPartitions(joined)


def drawn_rows(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Numbers of the rows a tree is grown on."""
    return np.flatnonzero(drawn(key, tree, share)) if share < 1 else np.arange(len(key))


def _scored(s: int, codes: np.ndarray, y: np.ndarray, key: np.ndarray, f: np.ndarray) -> tuple:
    """A fit set's rows of a partition with their scores, and the gradients (both fit four bytes) that a round's passes share."""
    return s, codes, y, key, f, *(v.astype(np.int32) for v in gradients(f, y))


def _started(state: RDD, bases: dict, config: Booster) -> RDD:
    """The state with the booster's starting score of every row."""
    def run(rows):
        for s, codes, y, key in rows:
            # Keys are carried only if rows are drawn.
            yield _scored(s, codes, y, key if config.row_share < 1 else y, np.full(len(y), bases[s]))
    return state.mapPartitions(run, True)


def _updated(state: RDD, trees: dict, packings: dict) -> RDD:
    """The state after a round: scores plus the new trees' values."""
    def run(rows):
        for s, codes, y, key, f, _, _ in rows:
            yield _scored(s, codes, y, key, f + packings[s].values(trees[s], codes))
    return state.mapPartitions(run, True)


def _histograms(state: RDD, growing: dict, wanted: dict, packings: dict, config: Booster, round_: int) -> dict:
    """{fit set: (nodes wanted, bins, 3) sums} of one level, in one pass."""
    plan = {s: (growing[s], nodes, packings[s]) for s, nodes in wanted.items() if nodes}

    def run(rows):
        for s, codes, _, key, _, g, h in rows:
            if s not in plan:
                continue
            tree, nodes, packing = plan[s]
            held = rows_of(packing, tree, codes, nodes, drawn_rows(key, round_, config.row_share))
            g, h = g.astype(np.float64), h.astype(np.float64)
            sums = np.concatenate([packing.sums(codes, held[node], g, h) for node in nodes])
            used = np.flatnonzero(sums[:, 2])
            yield s, (used.astype(np.int32), sums[used]) if 2 * len(used) < len(sums) else (None, sums)

    def dense(s, part):
        used, sums = part
        if used is None:
            return sums
        out = np.zeros((len(plan[s][1]) * int(plan[s][2].first[-1]), 3), np.int64)
        out[used] = sums
        return out

    parts = state.mapPartitions(run)
    if state.getNumPartitions() > DIRECT_PARTITIONS:
        parts = parts.map(lambda r: (r[0], dense(*r))).reduceByKey(np.add, len(plan)).map(lambda r: (r[0], (None, r[1])))
    found: dict[int, np.ndarray] = {}
    # One entry per task and fit set at most; their size is set by leaves and bins.
    for s, (used, sums) in parts.collect():
        if s not in found:
            found[s] = dense(s, (used, sums)).copy()
        elif used is None:
            found[s] += sums
        else:
            found[s][used] += sums
    return {s: v.reshape(len(plan[s][1]), -1, 3) for s, v in found.items()}


def _grow(histograms, starts: dict, config: Booster, round_: int, features: int) -> dict:
    """One tree of every fit set; ``histograms(growing, wanted)`` gives the sums of a level."""
    columns = drawn_columns(features, round_, config.column_share) if config.column_share < 1 else None
    growing = {s: Growing.start() for s in starts}
    wanted = {s: [0] for s in growing}
    level_hist: dict[int, dict[int, np.ndarray]] = {s: {} for s in growing}
    for level in range(config.depth):
        if not any(wanted.values()):
            break
        found = histograms(growing, wanted)
        for s, tree in growing.items():
            nodes, hists = wanted[s], {}
            wanted[s] = []
            if not nodes:
                continue
            got = found.get(s)
            for i, node in enumerate(nodes):
                hists[node] = got[i] if got is not None else np.zeros((int(starts[s][-1]), 3), np.int64)
                if level:
                    sibling, parent = tree.sibling[node]
                    hists[sibling] = level_hist[s][parent] - hists[node]
            level_hist[s] = hists
            own = starts[s]
            tree.sibling = {}
            for node in sorted(hists):
                if level == 0:
                    tree.sums[0] = hists[0][:own[1]].sum(axis=0)
                split = best_split(hists[node], own, config, columns)
                if split is None:
                    continue
                gain, j, b, left = split
                child = len(tree.feature)
                tree.feature[node], tree.bin[node], tree.child[node], tree.gain[node] = j, b, child, gain
                right = tree.sums[node] - left
                for sums in (left, right):
                    tree.feature.append(-1)
                    tree.bin.append(0)
                    tree.child.append(-1)
                    tree.sums.append(sums)
                    tree.gain.append(0.0)
                if level + 1 < config.depth:
                    small = child if left[2] <= right[2] else child + 1
                    wanted[s].append(small)
                    tree.sibling[small] = (2 * child + 1 - small, node)
    return growing


def _boost(state: RDD, starts: dict, bases: dict, config: Booster, features: int) -> dict[int, list]:
    """All rounds of one booster on every fit set: {fit set: closed trees}."""
    done: dict[int, list] = {s: [] for s in starts}
    packings = {s: Packing.of(first) for s, first in starts.items()}
    state, previous, lineage = _started(state, bases, config).persist(StorageLevel.MEMORY_AND_DISK), None, 0
    for round_ in range(config.rounds):
        passed = state
        grown = {s: closed(t, config) for s, t in _grow(
            lambda growing, wanted: _histograms(passed, growing, wanted, packings, config, round_), starts, config, round_, features).items()}
        for s, tree in grown.items():
            done[s].append(tree)
        if previous is not None:
            previous.unpersist()  # the passes above have filled ``state``
        if round_ + 1 == config.rounds:
            break
        previous, lineage = state, lineage + 1
        state = _updated(state, {s: t[:4] for s, t in grown.items()}, packings).persist(StorageLevel.MEMORY_AND_DISK)
        if lineage == CHECKPOINT_ROUNDS:
            state.checkpoint()
            lineage = 0
    state.unpersist()
    return done


def boost_rows(codes: np.ndarray, y: np.ndarray, key: np.ndarray, first: np.ndarray, base: float, config: Booster) -> list[tuple]:
    """All rounds of one booster on the rows of one fit set, in memory: the closed trees.  ``codes`` are packed bins."""
    f, done, packing = np.full(len(y), base), [], Packing.of(first)
    for round_ in range(config.rounds):
        g, h = gradients(f, y)
        held = {0: drawn_rows(key, round_, config.row_share)}

        def histograms(growing, wanted):
            tree, nodes = growing[0], wanted[0]
            for node in nodes:
                if node:  # its parent's rows are dealt to both children
                    parent = tree.sibling[node][1]
                    child = tree.child[parent]
                    held[child], held[child + 1] = packing.dealt(codes, held.pop(parent), tree.feature[parent], tree.bin[parent])
            return {0: np.stack([packing.sums(codes, held[node], g, h) for node in nodes])}
        done.append(closed(_grow(histograms, {0: first}, config, round_, len(first) - 1)[0], config))
        f = f + packing.values(done[-1][:4], codes)
    return done


def _boost_small(blocks: DataFrame, edges: dict, starts: dict, bases: list[dict], configs: list[Booster]) -> list[dict[int, list]]:
    """The boosters of fit sets of at most FIT_ROWS rows: a task per fit set and booster, one job."""
    fits = [(s, c) for s in starts for c in range(len(configs))]
    place = {fit: i for i, fit in enumerate(fits)}
    slices = _slices(blocks.where(F.col("fit_set").isin(list(starts))), edges).flatMap(
        lambda r: [(place[r[1][0], c], r[1][1:]) for c in range(len(configs))])

    def fit(index, rows):
        parts = [part for _, part in rows]
        if parts:
            codes, y, key = zip(*parts)
            s, c = fits[index]
            yield index, boost_rows(np.concatenate(codes, axis=1), np.concatenate(y), np.concatenate(key), starts[s], bases[c][s], configs[c])
    done: list[dict[int, list]] = [{} for _ in configs]
    for index, trees in slices.partitionBy(len(fits), int).mapPartitionsWithIndex(fit).collect():  # the models
        s, c = fits[index]
        done[c][s] = trees
    return done


def train(blocks: DataFrame, configs: list[Booster], max_bins: int = MAX_BINS) -> dict[tuple[int, str], Trees]:
    """All ``configs`` fitted on every fit set of ``blocks``: {(fit set, name): trees}."""
    edges = bin_edges(blocks, max_bins)
    if not edges:
        return {}
    features = len(next(iter(edges.values())))
    sizes = {r["fit_set"]: r["n"] for r in blocks.groupBy("fit_set").agg(F.sum("n").alias("n")).collect()}
    ones = _labels(blocks)
    rate = {s: ones[s] / n for s, n in sizes.items()}
    bases = [{s: float(np.log(rate[s] / (1 - rate[s]))) if c.prior and 0 < rate[s] < 1 else 0.0 for s in sizes} for c in configs]
    starts = {s: np.append(0, np.cumsum([len(e) + 1 for e in edges[s]])) for s in sorted(sizes)}
    small, large = ({s: v for s, v in starts.items() if (sizes[s] <= FIT_ROWS) == few} for few in (True, False))
    done: list[dict[int, list]] = [{} for _ in configs]
    if small:
        done = _boost_small(blocks, edges, small, bases, configs)
    if large:
        spark, rows = blocks.sparkSession, sum(sizes[s] for s in large)
        ensure_checkpoint_dir(spark, local_default=True)
        partitions = min(max(spark.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), math.ceil(rows / LEAST_ROWS))
        state = _state(blocks.where(F.col("fit_set").isin(list(large))), edges, partitions).persist(StorageLevel.MEMORY_AND_DISK)
        # The boosters' passes are independent jobs: while the driver searches the splits of one, the executors sum for another.
        with ThreadPoolExecutor(max_workers=max(len(configs), 1)) as pool:
            passed = list(pool.map(lambda c: _boost(state, large, bases[c], configs[c], features), range(len(configs))))
        done = [own | more for own, more in zip(done, passed)]
        state.unpersist()
    return {(s, c.name): _joined(done[i][s], edges[s], bases[i][s]) for i, c in enumerate(configs) for s in starts}


def _labels(blocks: DataFrame) -> dict[int, int]:
    def run(batches):
        for batch in batches:
            ones = [int(np.frombuffer(y, np.uint8).sum()) for y in batch.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fit_set"), pa.array(ones, pa.int64())], names=["fit_set", "ones"])
    return {r["fit_set"]: r["n"] for r in blocks.select("fit_set", "y").mapInArrow(run, "fit_set int, ones long").groupBy("fit_set").agg(
        F.sum("ones").alias("n")).collect()}


def _joined(trees: list[tuple], edges: list[np.ndarray], base: float) -> Trees:
    sizes = [len(t[0]) for t in trees]
    root = np.cumsum([0, *sizes[:-1]]).astype(np.int64)
    feature, cut, child, value, cover, gain = (np.concatenate([t[i] for t in trees]) for i in range(6))
    shift = np.repeat(root, sizes)
    threshold = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut)])
    left = np.where(child >= 0, child + shift, -1)
    return Trees(root, feature, threshold, left, np.where(child >= 0, left + 1, -1), value, cover, gain, base)
