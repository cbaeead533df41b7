"""A query fits the models it reads and no others; small fit sets are grown whole in tasks; attributions in bounded memory."""
import itertools
import types
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clientele.operators import blocks as B
from clientele.operators import forest as R
from clientele.operators import metrics
from clientele.operators import trees as T
from clientele.operators.logistic import Linear
from clientele.plans import materialize, model_queries, model_store, models
from tests.test_boosting import sample

CONFIG = R.Forest(trees=7, depth=6, min_split=6)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(s, i, int(y), list(map(float, x))) for s, n in ((0, 400), (4, 150)) for i, (x, y) in enumerate(zip(*sample(n, s + 1)))]
    df = spark.createDataFrame(rows, "fit_set int, id long, label int, x array<double>").withColumn("key", B.row_key("fit_set", "id"))
    return B.to_blocks(df)


def arrays(models):
    return {s: [getattr(m, c).tolist() for c in ("root", "feature", "threshold", "left", "right", "value", "cover", "gain")] for s, m in models.items()}


def test_small_fit_sets_take_no_passes_and_give_the_same_forests(blocks, monkeypatch):
    passes, own = [], R._pass
    monkeypatch.setattr(R, "_pass", lambda *a: passes.append(a) or own(*a))
    whole = arrays(R.train(blocks, CONFIG))
    assert not passes
    monkeypatch.setattr(R, "FIT_ROWS", 150)  # one fit set in passes, the other in tasks
    assert arrays(R.train(blocks, CONFIG)) == whole and {s for a in passes for s in a[1]} == {0}


def test_cells_are_summed_alike_densely_and_sorted():
    rng = np.random.default_rng(2)
    cell, w, y = rng.integers(0, 40, 500), rng.integers(1, 17, 500), rng.integers(0, 2, 500)
    for size in (40, 5000):
        found, sums = R._summed(cell, (w << 1) | y, size)
        assert found.tolist() == sorted(set(cell.tolist()))
        assert sums.tolist() == [[w[cell == c].sum(), (w * y)[cell == c].sum(), (cell == c).sum()] for c in found]


def test_leaf_games_equal_sums_over_subsets():
    rng = np.random.default_rng(5)
    for m in (1, 2, 5):
        shares, value = rng.uniform(0.01, 1, (3, m)), rng.normal(size=3)
        got = T.leaf_games(value, shares)
        for leaf, bits in itertools.product(range(3), range(1 << m)):
            passed = [bits >> j & 1 for j in range(m)]
            for j in range(m):
                others, want = [i for i in range(m) if i != j], 0.0
                for size in range(m):
                    for known in itertools.combinations(others, size):
                        rest = np.prod([passed[i] if i in known else shares[leaf, i] for i in others])
                        want += factorial(size) * factorial(m - 1 - size) / factorial(m) * rest * (passed[j] - shares[leaf, j])
                assert got[leaf, bits, j] == pytest.approx(value[leaf] * want, abs=1e-12)


def test_games_are_made_a_few_leaves_at_a_time(blocks, monkeypatch):
    model = R.train(blocks, CONFIG)[0]
    x = np.random.default_rng(1).normal(size=(20, 6))
    whole = T.attributions(model, x)
    made, own = [], T.leaf_games
    monkeypatch.setattr(T, "LEAVES", 8)
    monkeypatch.setattr(T, "leaf_games", lambda value, shares: made.append(len(shares)) or own(value, shares))
    assert isinstance(T.leaf_tables(model), types.GeneratorType)
    assert np.allclose(T.attributions(model, x), whole, rtol=0, atol=1e-12) and max(made) == 8 and len(made) > 5


@pytest.fixture
def fits(spark, tmp_path, monkeypatch):
    """Calls of ``fit_family`` on a table of its own, which fits nothing."""
    calls = []

    def fit(family, sets, keys=None):
        calls.append((family, sets, keys))
        return {(s, k): Linear(np.array([float(s)]), float(len(k))) for s in sets for k in keys}
    monkeypatch.setattr(models, "fit_family", fit)
    monkeypatch.setattr(model_queries, "_fit_sets", lambda spark, sf_dir, fit_sets: fit_sets)
    materialize._MATERIALIZED.clear()
    yield calls, str(tmp_path)
    materialize._MATERIALIZED.clear()


def test_only_the_models_asked_for_are_fitted(spark, fits):
    calls, folder = fits
    model_queries._model(spark, folder, "xgboost")
    assert calls == [("boosters", [model_queries.TRAIN_SET], ["xgboost"])]
    found = model_queries._models(spark, folder, ["random_forest", "hist_gradient_boosting", "xgboost"], [2, model_queries.TRAIN_SET, 0])
    assert sorted(map(str, calls[1:])) == sorted(map(str, [
        ("boosters", [0, 2], ["hist_gradient_boosting", "xgboost"]), ("boosters", [5], ["hist_gradient_boosting"]), ("forest", [0, 2, 5], ["random_forest"])]))
    assert len(found) == 9 and found[2, "xgboost"].weights.tolist() == [2.0] and found[0, "random_forest"].intercept == 13.0


def test_the_store_gives_what_it_has_and_the_rest_is_fitted(spark, fits):
    calls, folder = fits
    model_queries._models(spark, folder, ["random_forest"], [0, 1])
    materialize._MATERIALIZED.clear()  # as another application
    assert model_queries._model(spark, folder, "random_forest", 1).weights.tolist() == [1.0] and len(calls) == 1
    assert set(model_queries._models(spark, folder, ["random_forest"], [0, 1, 3])) == {(s, "random_forest") for s in (0, 1, 3)}
    assert calls[1:] == [("forest", [3], ["random_forest"])]
    path = model_store.store_path(spark, folder, "forest", models.settings("forest"))
    assert len(model_store._tables(spark, path)) == 2


def test_test_metrics_of_several_models_in_one_pass(spark, fits, monkeypatch):
    rng = np.random.default_rng(3)
    test = spark.createDataFrame([(i, float(rng.random() < 0.4), float(rng.normal())) for i in range(90)], "customer_id long, label double, v double")
    test = test.select("customer_id", "label", array_to_vector(F.array("v")).alias("features")).checkpoint()
    fitted = {(model_queries.TRAIN_SET, "xgboost"): Linear(np.array([0.7]), 0.1), (model_queries.TRAIN_SET, "random_forest"): Linear(np.array([-2.0]), 0.0)}
    monkeypatch.setattr(model_queries, "_prepared", lambda *_: (None, test, ["v"], 0))
    monkeypatch.setattr(model_queries, "_models", lambda *_: fitted)
    got = {r["model_key"]: r.asDict() for r in model_queries._test_metrics(spark, "none", ["xgboost", "random_forest"]).collect()}
    assert len(got) == 2
    for (_, key), model in fitted.items():
        want = metrics.summary_metrics(models.score(model, test)).first().asDict()
        assert {k: got[key][k] for k in want} == pytest.approx(want) and got[key]["model"] == models.DISPLAY_NAMES[key]
