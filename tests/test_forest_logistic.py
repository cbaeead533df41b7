"""Exact forests and penalised logistic regression against plain numpy."""
import math

import numpy as np
import pytest

from clientele.operators import blocks as B
from clientele.operators import forest as R
from clientele.operators import logistic as L
from tests.test_boosting import sample, splits_of, subset_attributions
from clientele.operators import trees as T


@pytest.fixture(scope="module")
def tables(spark):
    data = {0: sample(300, 5), 2: sample(120, 6)}
    rows = [(s, int(i), int(y), list(map(float, x))) for s, (xs, ys) in data.items() for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "fit_set int, id long, label int, x array<double>").withColumn("key", B.row_key("fit_set", "id"))
    return data, B.to_blocks(df), {(r["fit_set"], r["id"]): r["key"] for r in df.collect()}


def brute_tree(x, y, w, tree, config):
    features, k = x.shape[1], int(math.sqrt(x.shape[1]))
    splits, values, stack = {}, {}, [("", 1, np.flatnonzero(w > 0))]
    while stack:
        path, code, rows = stack.pop()
        total, ones = w[rows].sum(), (w * y)[rows].sum()
        values[path] = ones / total
        if len(path) == config.depth or len(rows) < config.min_split or ones in (0, total):
            continue
        order, best = R.feature_order(tree, code, features), None
        for at in range(0, features, k):
            for j in order[at:at + k]:
                v = np.unique(x[rows, j])
                for a, b in zip(v, v[1:]):
                    left = x[rows, j] <= a
                    purity = 0.0
                    for part in (rows[left], rows[~left]):
                        n, p = float(w[part].sum()), float((w * y)[part].sum())
                        purity += (p * p + (n - p) * (n - p)) / n
                    if best is None or purity > best[0]:
                        best = purity, int(j), float((a + b) / 2)
            if best:
                break
        if best:
            _, j, cut = best
            splits[path] = (j, cut)
            stack += [(path + "l", 2 * code, rows[x[rows, j] <= cut]), (path + "r", 2 * code + 1, rows[x[rows, j] > cut])]
    return splits, values


def test_every_forest_split_equals_brute_force(tables):
    data, blocks, keys = tables
    config = R.Forest(trees=12, depth=6, min_split=6)
    found = R.train(blocks, config)
    for s, (x, y) in data.items():
        own = np.array([keys[s, i] for i in range(len(y))])
        grown = [brute_tree(x, y, R.weights(own, t), t, config) for t in range(config.trees)]
        assert splits_of(found[s]) == [g[0] for g in grown]

        def mean(row):
            out = 0.0
            for splits, values in grown:
                path = ""
                while path in splits:
                    j, cut = splits[path]
                    path += "l" if row[j] <= cut else "r"
                out += values[path] / config.trees
            return out
        assert np.allclose(found[s].probability(x), [mean(r) for r in x])
        assert found[s].importance(x.shape[1]).sum() == pytest.approx(1) and (found[s].probability(x) > 0.5).astype(int).tolist() != [0] * len(y)
        phi = T.attributions(found[s], x[:3])
        assert np.allclose(phi, [subset_attributions(found[s], r, x.shape[1]) for r in x[:3]], atol=1e-9)


def test_many_values_are_searched_at_quantiles(spark, monkeypatch):
    monkeypatch.setattr(R, "VALUES", 50)
    rows = [(0, i, int(i >= 700), [float(i)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "fit_set int, id long, label int, x array<double>").withColumn("key", B.row_key("id"))
    values = R.distinct_values(B.to_blocks(df))[0][0]
    assert 900 <= len(values) <= 1024 and values[0] == 0 and values[-1] == 999


def test_logistic_weights_equal_plain_newton(tables):
    data, blocks, _ = tables
    found = L.train(blocks)
    for s, (x, y) in data.items():
        w = np.zeros(x.shape[1] + 1)
        one = np.column_stack([x, np.ones(len(x))])
        for _ in range(60):
            p = 1 / (1 + np.exp(-one @ w))
            w -= np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.eye(len(w)), one.T @ (p - y) + w)
        assert np.allclose(np.append(found[s].weights, found[s].intercept), w, atol=1e-8)
        p = found[s].probability(x)
        assert np.allclose(one.T @ (p - y) + w, 0, atol=1e-6)  # stationary, the intercept's penalty included


def test_logistic_with_features_of_very_different_size(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=400) * 1e6, rng.normal(size=400) * 1e-3, rng.integers(0, 2, 400)])
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0] / 4e5 - x[:, 2]))).astype(int)
    df = spark.createDataFrame([(0, i, int(y[i]), list(map(float, x[i]))) for i in range(400)], "fit_set int, id long, label int, x array<double>")
    model = L.train(B.to_blocks(df.withColumn("key", B.row_key("id"))))[0]
    gradient = np.column_stack([x, np.ones(400)]).T @ (model.probability(x) - y) + np.append(model.weights, model.intercept)
    assert np.abs(gradient / [1e6, 1, 1, 1]).max() < 1e-4
