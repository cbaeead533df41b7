"""Shared-pass boosting and tree attributions against plain numpy."""
import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators import blocks as B
from clientele.operators import boosting as G
from clientele.operators import trees as T

HIST = G.Booster("hist", rounds=6, rate=0.08, depth=6, leaves=31, min_rows=20)
NEWTON = G.Booster("newton", rounds=6, rate=0.05, depth=4, min_hessian=3.0, l2=1.0, row_share=0.85, column_share=0.85, prior=False)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n).round(1), rng.random(n) < 0.3, rng.exponential(size=n), np.zeros(n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] == 2) - x[:, 4] * x[:, 3])))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def fitted(spark):
    data = {0: sample(500, 1), 3: sample(260, 2)}
    rows = [(s, int(i), int(y), list(map(float, x))) for s, (xs, ys) in data.items() for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "fit_set int, id long, label int, x array<double>").withColumn("key", B.row_key("fit_set", "id"))
    blocks = B.to_blocks(df)
    keys = {(r["fit_set"], r["id"]): r["key"] for r in df.select("fit_set", "id", "key").collect()}
    return data, blocks, G.train(blocks, [HIST, NEWTON]), keys


def brute(x, y, keys, config):
    """One booster, node by node and threshold by threshold: list of trees as {path: (feature, threshold)} and scores."""
    n, d = x.shape
    edges = []
    for j in range(d):
        v = np.sort(x[:, j])
        q = np.unique([v[max(0, math.ceil(p * n) - 1)] for p in (i / 254 for i in range(255))])
        edges.append((q[:-1] + q[1:]) / 2)
    f = np.full(n, math.log(y.mean() / (1 - y.mean())) if config.prior else 0.0)
    forest = []
    for tree in range(config.rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = np.rint((p - y) * 2**30).astype(object), np.rint(p * (1 - p) * 2**30).astype(object)
        use = G.drawn(keys, tree, config.row_share) if config.row_share < 1 else np.ones(n, bool)
        columns = G.drawn_columns(d, tree, config.column_share) if config.column_share < 1 else range(d)

        def best(rows):
            found = None
            total_g, total_h = int(sum(g[rows])), int(sum(h[rows]))
            for j in columns:
                for t in edges[j]:
                    left = rows[x[rows, j] <= t]
                    if not config.min_rows <= len(left) <= len(rows) - config.min_rows:
                        continue
                    gl, hl = int(sum(g[left])) / 2**30, int(sum(h[left])) / 2**30
                    gr, hr = (total_g - int(sum(g[left]))) / 2**30, (total_h - int(sum(h[left]))) / 2**30
                    if min(hl, hr) < config.min_hessian:
                        continue
                    gain = gl**2 / (hl + config.l2) + gr**2 / (hr + config.l2) - (total_g / 2**30)**2 / (total_h / 2**30 + config.l2)
                    if gain > 1e-6 and (found is None or gain > found[0]):
                        found = gain, j, float(t)
            return found
        rows = np.flatnonzero(use)
        splits, leaves, queue, number = {}, {"": rows}, [], itertools.count()
        first = best(rows)
        if first:
            heapq.heappush(queue, (-first[0], next(number), "", first))
        while queue and (config.leaves is None or len(leaves) < config.leaves):
            _, _, path, (_, j, t) = heapq.heappop(queue)
            here = leaves.pop(path)
            splits[path] = (j, t)
            for side, part in (("l", here[x[here, j] <= t]), ("r", here[x[here, j] > t])):
                leaves[path + side] = part
                more = best(part) if len(path) + 1 < config.depth else None
                if more:
                    heapq.heappush(queue, (-more[0], next(number), path + side, more))
        values = {path: -config.rate * (sum(g[r]) / 2**30) / (sum(h[r]) / 2**30 + config.l2) for path, r in leaves.items()}
        for i in range(n):
            path = ""
            while path in splits:
                j, t = splits[path]
                path += "l" if x[i, j] <= t else "r"
            f[i] += values[path]
        forest.append(splits)
    return forest, f


def splits_of(trees):
    out = []
    for root in trees.root:
        found, stack = {}, [(int(root), "")]
        while stack:
            at, path = stack.pop()
            if trees.feature[at] >= 0:
                found[path] = (int(trees.feature[at]), float(trees.threshold[at]))
                stack += [(int(trees.left[at]), path + "l"), (int(trees.right[at]), path + "r")]
        out.append(found)
    return out


@pytest.mark.parametrize("config", [HIST, NEWTON], ids=lambda c: c.name)
@pytest.mark.parametrize("fit_set", [0, 3])
def test_every_split_equals_brute_force(fitted, config, fit_set):
    data, _, models, keys = fitted
    x, y = data[fit_set]
    forest, scores = brute(x, y, np.array([keys[fit_set, i] for i in range(len(y))]), config)
    model = models[fit_set, config.name]
    assert splits_of(model) == forest and sum(map(len, forest)) > 10
    assert np.allclose(model.raw(x), scores, rtol=0, atol=1e-9)


def test_trees_do_not_depend_on_partitions(spark, fitted, monkeypatch):
    data, blocks, models, _ = fitted
    monkeypatch.setattr(B, "DIRECT_PARTITIONS", 1)  # sums made in executors
    spread = blocks.repartition(5).checkpoint()
    again = G.train(spread, [HIST])
    assert all(splits_of(again[s, "hist"]) == splits_of(models[s, "hist"]) for s in data)


def test_jobs_do_not_grow_with_the_models(spark, fitted):
    _, blocks, _, _ = fitted
    tracker = spark.sparkContext.statusTracker()

    def jobs(configs, group):
        spark.sparkContext.setJobGroup(group, group)
        G.train(blocks, configs)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))
    few = [G.Booster(f"b{i}", 3, 0.1, 3, min_rows=5) for i in range(1)]
    many = [G.Booster(f"b{i}", 3, 0.1, 3, min_rows=5) for i in range(8)]
    assert jobs(many, "many") <= jobs(few, "few") + 3


def subset_attributions(model, x, features):
    """Shapley values by enumerating all subsets, absent features split by cover."""
    def value(at, known):
        if model.feature[at] < 0:
            return float(model.value[at])
        j = int(model.feature[at])
        if j in known:
            return value(int(model.left[at] if x[j] <= model.threshold[at] else model.right[at]), known)
        return sum(value(int(c), known) * float(model.cover[c] / model.cover[at]) for c in (model.left[at], model.right[at]))
    game = {s: sum(value(int(r), s) for r in model.root) for k in range(features + 1) for s in map(frozenset, itertools.combinations(range(features), k))}
    out = np.zeros(features)
    for s, v in game.items():
        for j in range(features):
            w = math.factorial(len(s) - (j in s)) * math.factorial(features - len(s) - (j not in s)) / math.factorial(features)
            out[j] += w * v if j in s else -w * v
    return out


@pytest.mark.parametrize("name", ["hist", "newton"])
def test_attributions_equal_subset_enumeration(spark, fitted, name):
    data, _, models, _ = fitted
    model, x = models[0, name], data[0][0][:12]
    got = T.attributions(model, x)
    for row, phi in zip(x, got):
        assert np.allclose(phi, subset_attributions(model, row, x.shape[1]), atol=1e-9)
    assert np.allclose(got.sum(axis=1), model.raw(x) - model.expected(), atol=1e-9)
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, x array<double>")
    rows = sorted(T.with_attributions(model, T.with_score(model, df, "x"), "x").collect())
    assert np.allclose([r["score"] for r in rows], model.probability(x)) and np.allclose([r["attribution"] for r in rows], got)


def test_a_single_class_and_tiny_tables_grow_no_split(spark):
    rows = [(s, i, 0 if s else i % 2, [float(i)]) for s in (0, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "fit_set int, id long, label int, x array<double>").withColumn("key", B.row_key("fit_set", "id"))
    models = G.train(B.to_blocks(df), [HIST])
    assert all(len(m.feature) == HIST.rounds and (m.feature < 0).all() for m in models.values())
    assert models[0, "hist"].probability(np.zeros((2, 1))).tolist() == [0.5, 0.5]


def test_passes_use_all_cores_and_give_the_same_trees(spark, fitted, monkeypatch):
    data, blocks, models, _ = fitted
    rows = sum(len(y) for _, y in data.values())
    seen = []
    make = G._state

    def state(blocks, edges, partitions):
        seen.append(partitions)
        return make(blocks, edges, partitions)
    monkeypatch.setattr(G, "_state", state)
    monkeypatch.setattr(G, "FIT_ROWS", 260)  # one fit set in passes, the other in tasks of its own
    monkeypatch.setattr(G, "LEAST_ROWS", 64)
    monkeypatch.setattr(G, "SLICE_ROWS", 16)
    again = G.train(blocks, [HIST, NEWTON])
    monkeypatch.setattr(G, "DIRECT_PARTITIONS", 1)  # sums added up in executors
    monkeypatch.setattr(G, "FIT_ROWS", 0)
    summed = G.train(blocks, [HIST, NEWTON])
    assert seen == [min(spark.sparkContext.defaultParallelism, math.ceil(n / 64)) for n in (500, rows)] and seen[0] > 1
    for other in (again, summed):
        for k, m in models.items():
            assert all(np.array_equal(getattr(m, c), getattr(other[k], c)) for c in ("feature", "threshold", "value", "cover"))
