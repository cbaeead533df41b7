"""Random forests with exact splits, grown in shared passes (M9).

All trees of all fit sets grow together, level by level.  A pass counts, per
(fit set, tree, node, drawn feature, value), the weighted rows and positives
over parts of about a million rows; tasks per (fit set, tree, run of nodes) add
the counts up and find each node's best split by prefix sums.  A level is one
job, or several where the counts of all trees would take more than
``JOB_BYTES`` of disk; a job's shuffle files go when it ends.  A feature with at
most ``VALUES`` distinct values is searched exactly, one with more at quantiles.

Fit sets of at most ``FIT_ROWS`` rows take no passes: their trees are dealt to
tasks that hold all rows of the fit set and grow whole trees; both ways give
the same trees.

A row's weight in a tree is a Poisson(1) draw from its md5 key and the tree's
number (bootstrap).  A node draws its features in a hashed order of its own:
the first ``sqrt(d)`` of them, and while those are all constant the next ones.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffles_released
from .blocks import matrix
from .boosting import _GOLDEN, mix, uniform
from .trees import Trees

VALUES = 1 << 14
# Fit sets of up to so many rows (a few MB as value numbers) are held whole by every task that grows trees of them.
FIT_ROWS = 1 << 16
# Rows counted together (about 60 MB as value numbers); cells searched together; bytes of counts of a job, and of a cell.
PART_ROWS, CELLS, JOB_BYTES, CELL_BYTES = 1 << 20, 1 << 20, 2 << 30, 4
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass(frozen=True)
class Forest:
    trees: int = 300
    depth: int = 8
    min_split: int = 6     # rows (not weights) of a node that may be split


def weights(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    return np.searchsorted(_POISSON, uniform(keys, tree) / float(1 << 53), side="right")


def feature_order(tree: int, path: int, features: int) -> np.ndarray:
    """The order in which a node tries the features; ``path`` is 1 for the root, 2p and 2p + 1 for p's children."""
    with np.errstate(over="ignore"):
        seed = mix(np.array([tree * 1_000_003 + path], np.uint64) * _GOLDEN)
        return np.argsort(mix(seed + np.arange(1, features + 1, dtype=np.uint64) * _GOLDEN), kind="stable")


def feature_orders(tree: int, paths: np.ndarray, features: int) -> np.ndarray:
    """``feature_order`` of several nodes, one a row."""
    with np.errstate(over="ignore"):
        seed = mix((tree * 1_000_003 + paths).astype(np.uint64) * _GOLDEN)
        return np.argsort(mix(seed[:, None] + np.arange(1, features + 1, dtype=np.uint64) * _GOLDEN), axis=1, kind="stable")


def distinct_values(blocks: DataFrame) -> dict[int, list[np.ndarray]]:
    """Sorted values (or quantiles) of every (fit set, feature) among which splits are searched."""
    def cells(batches):
        for batch in batches:
            for s, n, x in zip(*(batch.column(c).to_pylist() for c in ("fit_set", "n", "x"))):
                m = matrix(x, n)
                for j in range(m.shape[1]):
                    v = np.unique(m[:, j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s, np.int32)), pa.array(np.full(len(v), j, np.int32)), pa.array(v)],
                                                     names=["fit_set", "j", "value"])
    found = blocks.select("fit_set", "n", "x").mapInArrow(cells, "fit_set int, j int, value double").distinct()
    # At most VALUES per feature reach the driver: all of them, or evenly spaced ranks of the distinct values.
    ranks = F.array(*[F.lit(i / 1023) for i in range(1024)])
    kept = found.groupBy("fit_set", "j").agg(F.count("*").alias("n"), F.percentile_approx("value", ranks, 100_000).alias("q"))
    few = found.join(kept.where(F.col("n") <= VALUES).select("fit_set", "j"), ["fit_set", "j"], "left_semi").groupBy("fit_set", "j").agg(
        F.sort_array(F.collect_set("value")).alias("q"))
    out: dict[int, dict[int, np.ndarray]] = {}
    with shuffles_released(blocks.sparkSession):
        rows = few.unionByName(kept.where(F.col("n") > VALUES).select("fit_set", "j", "q")).collect()
    for r in rows:
        out.setdefault(r["fit_set"], {})[r["j"]] = np.unique(r["q"])
    return {s: [by[j] for j in sorted(by)] for s, by in out.items()}


def binned(blocks: DataFrame, values: dict) -> DataFrame:
    """(fit_set, n, bins, y, key): rows of one fit set, about PART_ROWS at most, as the numbers of their values.

    What a pass sends on is counted over all rows of such a part, so it is bounded by the nodes' values.
    """
    counts = {r["fit_set"]: max(1, math.ceil(r["n"] / PART_ROWS)) for r in blocks.groupBy("fit_set").agg(F.sum("n").alias("n")).collect()}
    shared = blocks.sparkSession.sparkContext.broadcast((values, counts))

    def numbered(batches):
        values, counts = shared.value
        for batch in batches:
            for s, n, x, y, key in zip(*(batch.column(c).to_pylist() for c in ("fit_set", "n", "x", "y", "key"))):
                if not n:
                    continue
                m = matrix(x, n)
                bins = np.stack([np.minimum(np.searchsorted(v, m[:, j], side="left"), len(v) - 1) for j, v in enumerate(values[s])], axis=1)
                # Blocks are stored, so a block goes to the same part in every attempt.
                part = int(np.frombuffer(key, np.int64)[0]) % counts[s]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array(
                    [bins.astype(np.uint16).tobytes()], pa.binary()), pa.array([y], pa.binary()), pa.array([key], pa.binary())],
                    names=["fit_set", "part", "n", "bins", "y", "key"])

    def joined(table: pa.Table) -> pa.Table:
        whole = {c: pa.array([b"".join(table.column(c).to_pylist())], pa.binary()) for c in ("bins", "y", "key")}
        return pa.table({"fit_set": table.column("fit_set").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int32()), **whole})

    schema = "fit_set int, n int, bins binary, y binary, key binary"
    parts = blocks.select("fit_set", "n", "x", "y", "key").mapInArrow(numbered, "fit_set int, part int, n int, bins binary, y binary, key binary")
    ensure_checkpoint_dir(blocks.sparkSession, local_default=True)
    with shuffles_released(blocks.sparkSession):
        return parts.groupBy("fit_set", "part").applyInArrow(joined, schema).checkpoint(eager=True)


def starts(chosen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First cell of every (node slot, drawn feature), and the end; a cell is one value of it."""
    return np.concatenate([[0], np.cumsum(sizes[chosen].ravel())]).astype(np.int64)


def _packed(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(a.max()))
    return bytes([kind.itemsize]) + a.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1)


def count_cells(tree: tuple, nodes: np.ndarray, chosen: np.ndarray, sizes: np.ndarray, level: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray):
    """(cells, weights, weighted positives, rows) of the rows of a part that are in the given nodes, all at depth ``level``."""
    feature, cut, child = tree
    rows = np.flatnonzero(w)
    at = np.zeros(len(rows), np.int64)
    for _ in range(level):
        inner = child[at] >= 0
        rows, at = rows[inner], at[inner]
        at = child[at] + (bins[rows, feature[at]] > cut[at])
    place = np.full(len(feature), -1)
    place[nodes] = np.arange(len(nodes))
    slot = place[at]
    rows, slot = rows[slot >= 0], slot[slot >= 0]
    first = starts(chosen, sizes)
    k = chosen.shape[1]
    own = w[rows].astype(np.int64)
    # Weights and weighted positives in one sum: both stay below 2^26, as a part has about 2^20 rows.
    both = (own + ((own * y[rows]) << 26)).astype(np.float64)
    cell = np.concatenate([first[slot * k + d] + bins[rows, chosen[slot, d]] for d in range(k)]) if len(rows) else np.zeros(0, np.int64)
    if first[-1] <= max(1 << 20, 4 * len(cell)):
        count = np.bincount(cell, minlength=first[-1])
        found = np.flatnonzero(count)
        count, total = count[found], np.bincount(cell, weights=np.tile(both, k), minlength=first[-1])[found]
    else:
        found, number, count = np.unique(cell, return_inverse=True, return_counts=True)
        total = np.bincount(number, weights=np.tile(both, k), minlength=len(found))
    total = total.astype(np.int64)
    return found, total & ((1 << 26) - 1), total >> 26, count


def _counts(batches, plan, sizes, level, group, groups):
    """Counts of (node slot, drawn feature, value) cells, one row per part, tree and run of CELLS cells."""
    for batch in batches:
        for s, n, bins, y, keys in zip(*(batch.column(c).to_pylist() for c in ("fit_set", "n", "bins", "y", "key"))):
            bins, y, keys = np.frombuffer(bins, np.uint16).reshape(n, -1), np.frombuffer(y, np.uint8).astype(np.int64), np.frombuffer(keys, np.int64)
            for t, (tree, nodes, chosen) in plan.get(s, {}).items():
                if t % groups != group:
                    continue
                cells, *sums = count_cells(tree, nodes, chosen, sizes[s], level, bins, y, weights(keys, t))
                run = run_of(chosen, sizes[s])[np.searchsorted(starts(chosen, sizes[s]), cells, side="right") - 1]
                edges = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(cells))
                for a, b in zip(edges, edges[1:]):
                    gaps = np.diff(cells[a:b], prepend=int(run[a]) * CELLS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x], pa.int32()) for x in (s, t, int(run[a]))] + [pa.array([_packed(v)], pa.binary()) for v in (gaps, *(x[a:b] for x in sums))],
                        names=["fit_set", "tree", "run", "gaps", "w", "ones", "n"])


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, values: list[np.ndarray], number: int, config: Forest) -> dict:
    """A whole tree on the rows of a fit set, in memory: the nodes that passes over the rows give, in the same order.

    ``bins`` is rows x features.  A row that reaches a leaf is not looked at again.
    """
    features, sizes = bins.shape[1], np.array([len(v) for v in values])
    k = max(1, int(math.sqrt(features)))
    flat, cuts, starts_of = np.ascontiguousarray(bins).ravel(), np.concatenate(values), np.cumsum([0, *sizes[:-1]])
    rows = np.flatnonzero(w)
    # Weight and label of a row in the lower bits of what is sorted: weights are below 32.
    low = (w[rows].astype(np.int64) << 1) | y[rows]
    node, base = np.zeros(len(rows), np.int64), rows * features
    tree = {"feature": np.full(1, -1), "bin": np.zeros(1, np.int64), "child": np.full(1, -1), "sums": np.zeros((1, 3), np.int64), "cut": np.zeros(1)}
    path, frontier = np.ones(1, np.int64), np.zeros(1, np.int64)
    for _ in range(config.depth):
        following, tried, at, own = [], 0, node, base
        own_low = low
        while len(frontier) and len(at):
            place = np.full(len(path), -1)
            place[frontier] = np.arange(len(frontier))
            slot = place[at]
            if tried:
                kept = slot >= 0
                slot, at, own, own_low = slot[kept], at[kept], own[kept], own_low[kept]
            chosen = feature_orders(number, path[frontier], features)[:, tried + np.arange(k) % min(k, features - tried)]
            first = starts(chosen, sizes)
            cell = np.concatenate([first[slot * k + d] + flat[own + chosen[slot, d]] for d in range(k)])
            cells, sums = _summed(cell, np.tile(own_low, k), int(first[-1]))
            found = best_splits(cells, sums, first, chosen)
            slots, j, v, after, left, total = found[:, 0], found[:, 1], found[:, 2], found[:, 3], found[:, 4:7], found[:, 7:]
            nodes = frontier[slots]
            tree["sums"][nodes] = total
            open_ = _open(total, config)
            again = nodes[open_ & (j < 0)] if tried + k < features else nodes[:0]
            split = np.flatnonzero(open_ & (j >= 0))
            nodes, j, v, after = nodes[split], j[split], v[split], after[split]
            child = len(path) + 2 * np.arange(len(split))
            tree["feature"][nodes], tree["bin"][nodes], tree["child"][nodes] = j, v, child
            tree["cut"][nodes] = (cuts[starts_of[j] + v] + cuts[starts_of[j] + after]) / 2
            parts = np.stack([left[split], total[split] - left[split]], axis=1).reshape(-1, 3)
            path = np.concatenate([path, (2 * path[nodes][:, None] + [0, 1]).ravel()])
            for name, x in (("feature", -1), ("bin", 0), ("child", -1), ("cut", 0.0)):
                tree[name] = np.concatenate([tree[name], np.full(len(parts), x)])
            tree["sums"] = np.concatenate([tree["sums"], parts])
            following.append((child[:, None] + [0, 1]).ravel()[_open(parts, config)])
            frontier, tried = again, tried + k
        frontier = np.concatenate(following) if following else frontier[:0]
        if not len(frontier):
            break
        wanted = np.zeros(len(path), bool)
        wanted[frontier] = True
        inner = tree["child"][node] >= 0
        node, base, low = node[inner], base[inner], low[inner]
        node = tree["child"][node] + (flat[base + tree["feature"][node]] > tree["bin"][node])
        inner = wanted[node]
        node, base, low = node[inner], base[inner], low[inner]
    return tree


def _open(sums: np.ndarray, config: Forest) -> np.ndarray:
    """Which nodes may be split: (weights, weighted positives, rows) each."""
    return (sums[:, 2] >= config.min_split) & (sums[:, 1] != 0) & (sums[:, 1] != sums[:, 0])


def _summed(cell: np.ndarray, low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells that occur, their weights, weighted positives and rows); ``low`` is twice a row's weight plus its label."""
    if size <= len(cell):
        w = low >> 1
        count = np.bincount(cell, minlength=size)
        found = np.flatnonzero(count)
        # Both sums stay below 2^26, as a fit set grown whole has at most 2^20 rows.
        both = np.bincount(cell, weights=w + ((w * (low & 1)) << 26), minlength=size)[found].astype(np.int64)
        return found, np.column_stack([both & ((1 << 26) - 1), both >> 26, count[found]])
    packed = np.sort((cell << 6) | low)
    cell, low = packed >> 6, packed & 63
    w = low >> 1
    end = np.append(np.flatnonzero(np.diff(cell)), len(cell) - 1)
    run = np.column_stack([np.cumsum(w)[end], np.cumsum(w * (low & 1))[end], end + 1])
    return cell[end], np.diff(run, axis=0, prepend=np.zeros((1, 3), np.int64))


def run_of(chosen: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The run, searched by one task, of every (node slot, drawn feature): whole slots of about CELLS cells."""
    k = chosen.shape[1]
    return np.repeat(starts(chosen, sizes)[:-1:k] // CELLS, k)


def best_splits(cells: np.ndarray, sums: np.ndarray, first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Per node slot with cells: (slot, feature, value, next value, left sums, all sums) of the split with the least Gini impurity.

    ``cells`` are sorted, with (weights, weighted positives, rows) each; ties go to the feature drawn first, then to the
    smallest value.  Feature -1: all are constant.
    """
    k = chosen.shape[1]
    drawn = np.searchsorted(first, cells, side="right") - 1     # slot * k + draw
    begin = np.flatnonzero(np.diff(drawn, prepend=-1))          # every feature of a slot has a cell for each of its rows
    end = np.append(begin[1:], len(cells)) - 1
    run = np.cumsum(sums, axis=0)
    segment = np.repeat(np.arange(len(begin)), end - begin + 1)
    left = run - (run[begin] - sums[begin])[segment]
    total = left[end]
    l, r = left.astype(np.float64), (total[segment] - left).astype(np.float64)
    r[end, 0] = 1
    purity = sum((p[:, 1] ** 2 + (p[:, 0] - p[:, 1]) ** 2) / p[:, 0] for p in (l, r))
    purity[end] = -1.0
    most = np.maximum.reduceat(purity, begin)
    reached = np.flatnonzero(purity == most[segment])
    at = reached[np.unique(segment[reached], return_index=True)[1]].reshape(-1, k)
    draw = most.reshape(-1, k).argmax(axis=1)
    slots = np.arange(len(draw))
    at, slot = at[slots, draw], drawn[begin].reshape(-1, k)[:, 0] // k
    split = purity[at] >= 0
    value, after = cells[at] - first[drawn[at]], cells[np.minimum(at + 1, len(cells) - 1)] - first[drawn[at]]
    total = total.reshape(-1, k, 3)[:, 0]
    return np.column_stack([slot, np.where(split, chosen[slot, draw], -1), np.where(split, value, 0), np.where(split, after, 0),
                            np.where(split[:, None], left[at], total), total])


def _jobs(plan: dict, sizes: dict, rows: dict) -> list[dict]:
    """The plan cut into jobs that send on about JOB_BYTES at most, so that the disk they take does not grow with the trees."""
    out, room = [], 0
    for s, trees in plan.items():
        for t, (tree, nodes, chosen) in trees.items():
            cells = sum(min(int(sizes[s][chosen].sum()), n * chosen.shape[1]) for n in rows[s])
            if not out or room < CELL_BYTES * cells:
                out.append({})
                room = JOB_BYTES
            out[-1].setdefault(s, {})[t] = (tree, nodes, chosen)
            room -= CELL_BYTES * cells
    return out


def _pass(parts: DataFrame, plan: dict, sizes: dict, level: int, groups: int) -> list[tuple]:
    """(fit set, tree, splits) of a plan's nodes, the slots of a tree in one or several rows."""
    shared = parts.sparkSession.sparkContext.broadcast((plan, sizes))

    def counting(group):
        def count(batches):
            yield from _counts(batches, *shared.value, level, group, groups)
        return count

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s, t, run = (x.as_py() for x in key)
        plan, sizes = shared.value
        chosen = plan[s][t][2]
        first = starts(chosen, sizes[s])
        own = np.flatnonzero(run_of(chosen, sizes[s]) == run)
        lo, hi = first[own[0]], first[own[-1] + 1]
        total = np.zeros((hi - lo, 3), np.int64)
        for gaps, *sums in zip(*(table.column(c).to_pylist() for c in ("gaps", "w", "ones", "n"))):
            total[np.cumsum(_unpacked(gaps), dtype=np.int64) + run * CELLS - lo] += np.stack([_unpacked(x) for x in sums], axis=1).astype(np.int64)
        cells = np.flatnonzero(total[:, 2])
        found = best_splits(cells + lo, total[cells], first, chosen)
        return pa.table({"fit_set": pa.array([s], pa.int32()), "tree": pa.array([t], pa.int32()), "splits": pa.array([found.astype(np.int64).tobytes()], pa.binary())})

    schema, counted = "fit_set int, tree int, run int, gaps binary, w binary, ones binary, n binary", None
    for group in range(groups):
        part = parts.mapInArrow(counting(group), schema)
        counted = part if counted is None else counted.unionByName(part)
    with shuffles_released(parts.sparkSession):
        splits = counted.groupBy("fit_set", "tree", "run").applyInArrow(search, "fit_set int, tree int, splits binary").toArrow()
    shared.destroy()
    return list(zip(*(splits.column(c).to_pylist() for c in ("fit_set", "tree", "splits"))))


def _train_small(blocks: DataFrame, values: dict, config: Forest) -> dict[int, Trees]:
    """The forests of fit sets of at most FIT_ROWS rows: a task per fit set and share of the trees, one job."""
    spark = blocks.sparkSession
    # Twice as many shares as cores: they are not of the same length.
    shares = max(1, min(config.trees, -(-2 * spark.sparkContext.defaultParallelism // len(values))))
    tasks = [(s, i) for s in sorted(values) for i in range(shares)]
    place, shared = {task: i for i, task in enumerate(tasks)}, spark.sparkContext.broadcast(values)

    def numbered(rows):
        for s, n, x, y, key in rows:
            m = matrix(x, n)
            bins = np.stack([np.minimum(np.searchsorted(v, m[:, j], side="left"), len(v) - 1) for j, v in enumerate(shared.value[s])], axis=1)
            part = bins.astype(np.uint16), np.frombuffer(y, np.uint8), np.frombuffer(key, np.int64)
            for i in range(shares):
                yield place[s, i], part

    def grown(index, rows):
        parts = [part for _, part in rows]
        if parts:
            s, i = tasks[index]
            bins, y, key = (np.concatenate(x) for x in zip(*parts))
            for t in range(i, config.trees, shares):
                yield s, t, grow(bins, y.astype(np.int64), weights(key, t), shared.value[s], t, config)
    rows = blocks.where(F.col("fit_set").isin(list(values))).select("fit_set", "n", "x", "y", "key").rdd.mapPartitions(numbered)
    trees = {(s, t): tree for s, t, tree in rows.partitionBy(len(tasks), int).mapPartitionsWithIndex(grown).collect()}  # the models
    return {s: _joined([trees[s, t] for t in range(config.trees)]) for s in values}


def train(blocks: DataFrame, config: Forest = Forest()) -> dict[int, Trees]:
    """A forest per fit set."""
    values = distinct_values(blocks)
    if not values:
        return {}
    held = {r["fit_set"]: r["n"] for r in blocks.groupBy("fit_set").agg(F.sum("n").alias("n")).collect()}
    small, large = ({s: v for s, v in values.items() if (held[s] <= min(FIT_ROWS, PART_ROWS)) == few} for few in (True, False))
    done = _train_small(blocks, small, config) if small else {}
    return done | (_train_large(blocks.where(F.col("fit_set").isin(list(large))), large, config) if large else {})


def _train_large(blocks: DataFrame, values: dict, config: Forest) -> dict[int, Trees]:
    """The forests of the other fit sets, in passes over all of their rows."""
    features = len(next(iter(values.values())))
    k = max(1, int(math.sqrt(features)))
    parts = binned(blocks, values)
    rows: dict[int, list] = {}
    for r in parts.select("fit_set", "n").collect():
        rows.setdefault(r["fit_set"], []).append(r["n"])
    sizes = {s: np.array([len(x) for x in v]) for s, v in values.items()}
    # Trees are dealt to so many tasks a part that all cores have work.
    groups = max(1, min(config.trees, -(-blocks.sparkSession.sparkContext.defaultParallelism // sum(map(len, rows.values())))))
    # feature, value, child, sums, threshold and path of every node
    trees = {(s, t): {"feature": [-1], "bin": [0], "child": [-1], "sums": [None], "cut": [0.0], "path": [1]}
             for s in values for t in range(config.trees)}
    frontier = {key: [(0, 0)] for key in trees}   # (node, features tried so far)
    for level in range(config.depth):
        following: dict[tuple, list] = {key: [] for key in trees}
        while any(frontier.values()):
            plan: dict[int, dict] = {}
            for (s, t), nodes in frontier.items():
                if nodes:
                    own = trees[s, t]
                    chosen = np.array([np.resize(feature_order(t, own["path"][n], features)[tried:tried + k], k) for n, tried in nodes])
                    plan.setdefault(s, {})[t] = (tuple(np.array(own[c]) for c in ("feature", "bin", "child")), np.array([n for n, _ in nodes]), chosen)
            found = [x for job in _jobs(plan, sizes, rows) for x in _pass(parts, job, sizes, level, groups)]
            found.sort(key=lambda x: (x[0], x[1], np.frombuffer(x[2], np.int64, 1)[0]))  # nodes are numbered in the order of the slots
            again: dict[tuple, list] = {}
            for s, t, flat in found:
                own, nodes = trees[s, t], frontier[s, t]
                for slot, j, v, after, *sums in np.frombuffer(flat, np.int64).reshape(-1, 10).tolist():
                    node, tried = nodes[slot]
                    left, total = np.array(sums[:3]), np.array(sums[3:])
                    own["sums"][node] = total
                    if total[2] < config.min_split or total[1] in (0, total[0]):
                        continue
                    if j < 0:
                        if tried + k < features:
                            again.setdefault((s, t), []).append((node, tried + k))
                        continue
                    child = len(own["feature"])
                    own["feature"][node], own["bin"][node], own["child"][node] = j, v, child
                    own["cut"][node] = float(values[s][j][v] + values[s][j][after]) / 2
                    for side, part in enumerate((left, total - left)):
                        for name, x in (("feature", -1), ("bin", 0), ("child", -1), ("sums", part), ("cut", 0.0), ("path", 2 * own["path"][node] + side)):
                            own[name].append(x)
                        if part[2] >= config.min_split and part[1] not in (0, part[0]):
                            following[s, t].append((child + side, 0))
            frontier = {key: again.get(key, []) for key in trees}
        frontier = following
    return {s: _joined([trees[s, t] for t in range(config.trees)]) for s in values}


def _joined(trees: list[dict]) -> Trees:
    sizes = [len(t["feature"]) for t in trees]
    root = np.cumsum([0, *sizes[:-1]]).astype(np.int64)
    feature, cut, child = (np.concatenate([t[c] for t in trees]) for c in ("feature", "cut", "child"))
    sums = np.concatenate([np.array([x if x is not None else (0, 0, 0) for x in t["sums"]], np.float64) for t in trees])
    left = np.where(child >= 0, child + np.repeat(root, sizes), -1)
    right = np.where(child >= 0, left + 1, -1)
    w, ones = sums[:, 0], sums[:, 1]
    impurity = w - np.divide(ones ** 2 + (w - ones) ** 2, w, out=np.zeros(len(w)), where=w > 0)
    # Each tree's impurity decreases add up to 1, so that their sum over trees is an average.
    gain = np.where(child >= 0, impurity - impurity[left] - impurity[right], 0.0)
    whole = np.add.reduceat(gain, root)
    gain /= np.repeat(np.where(whole > 0, whole, 1), sizes)
    value = np.divide(ones, w, out=np.full(len(w), 0.5), where=w > 0) / len(trees)
    return Trees(root, feature, cut, left, right, value, np.maximum(w, 1e-300), gain, 0.0, logistic=False)
