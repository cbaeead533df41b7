"""The churn workflow end to end: cross-validation, tests, tuning, result documents, and models that outlive a session."""
import subprocess
import sys
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators import metrics
from clientele.plans import churn_run, materialize, model_queries, model_store, models
from tests.conftest import SMOKE_DIR


@pytest.fixture(scope="module")
def short_models():
    """Every fold and every model, of fewer rounds and trees."""
    patch = pytest.MonkeyPatch()
    patch.setattr(models, "BOOSTERS", [replace(b, rounds=5) for b in models.BOOSTERS])
    patch.setattr(models, "FOREST", replace(models.FOREST, trees=10))
    yield
    patch.undo()
    materialize._MATERIALIZED.clear()


@pytest.fixture(scope="module")
def outputs(spark, short_models, tmp_path_factory):
    materialize._MATERIALIZED.clear()
    out = f"file://{tmp_path_factory.mktemp('churn-run')}"
    churn_run.run(spark, SMOKE_DIR, out)
    return out


def test_the_run_writes_five_outputs(spark, outputs):
    board = spark.read.option("header", True).option("inferSchema", True).csv(f"{outputs}/model_comparison").collect()
    assert sorted(r["model_key"] for r in board) == sorted(models.FAMILIES) and sorted(r["rank"] for r in board) == [1, 2, 3, 4]
    by_rank = sorted(board, key=lambda r: r["rank"])
    assert [r["cv_roc_auc_mean"] for r in by_rank] == sorted((r["cv_roc_auc_mean"] for r in board), reverse=True)
    importances = spark.read.option("header", True).csv(f"{outputs}/feature_importances").collect()
    assert len({r["feature"] for r in importances}) == len(importances) > 10
    result = spark.read.json(f"{outputs}/model_results").first()
    assert len(result["cross_validation"]) == len(result["test_results"]) == 4 and len(result["feature_importances"]) <= 20
    assert result["best_model"]["model_key"] == result["test_results"][0]["model_key"]
    assert result["tuned_threshold_result"]["threshold"] == pytest.approx(result["threshold_optimization"]["threshold"])
    info = result["dataset_info"]
    assert info["train_samples"] + info["test_samples"] == info["n_samples"] and info["n_features"] == len(importances)
    insights = spark.read.json(f"{outputs}/business_insights").first()
    rates = spark.read.option("header", True).option("inferSchema", True).csv(f"{outputs}/churn_rates").collect()
    assert 0 < insights["overall_churn_rate"] < 1 and {r["dimension"] for r in rates} == {"segment", "region", "priority"}


def test_the_leaderboard_recomputed_fold_by_fold(spark, outputs):
    """Each fold's held-out rows, scored on the driver by that fold's models, give the leaderboard's means and deviations."""
    rows = model_queries._folds(spark, SMOKE_DIR).collect()
    assert {r["fold"] for r in rows} == set(range(models.CV_FOLDS))
    for key in models.FAMILIES:
        aucs = []
        for f in range(models.CV_FOLDS):
            held = [r for r in rows if r["fold"] == f]
            p = model_queries._model(spark, SMOKE_DIR, key, f).probability(np.array([r["features"].toArray() for r in held]))
            pos, neg = ([s for s, r in zip(p, held) if r["label"] == y] for y in (1, 0))
            aucs.append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
        got = model_queries.cv_leaderboard(spark, SMOKE_DIR).where(F.col("model_key") == key).first()
        assert got["cv_roc_auc_mean"] == pytest.approx(np.mean(aucs)) and got["cv_roc_auc_std"] == pytest.approx(np.std(aucs))


@pytest.mark.parametrize("select_on", ["test", "cv"])
def test_the_best_model_is_tuned_on_rows_it_was_not_fitted_on(spark, outputs, select_on):
    board = model_queries.test_results(spark, SMOKE_DIR) if select_on == "test" else model_queries.cv_leaderboard(spark, SMOKE_DIR)
    best = board.where("rank = 1").first()["model_key"]
    tuning = model_queries.threshold_tuning(spark, SMOKE_DIR, select_on).first()
    tuned = model_queries.tuned_results(spark, SMOKE_DIR, select_on).first()
    assert tuning["model_key"] == tuned["model_key"] == best and tuned["model"].endswith("(Tuned Threshold)")
    fitted, valid = model_queries._subtrain(spark, SMOKE_DIR)
    assert not {r[0] for r in fitted.select("customer_id").collect()} & {r[0] for r in valid.select("customer_id").collect()}
    scored = models.score(model_queries._model(spark, SMOKE_DIR, best, model_queries.TUNING_SET), valid).cache()
    rows = [(r["label"], r["score"]) for r in scored.collect()]

    def f1(t):
        hit = sum(y for y, s in rows if s >= t)
        return 2 * hit / (sum(y for y, _ in rows) + sum(s >= t for _, s in rows))
    assert f1(tuning["threshold"]) == pytest.approx(max(f1(s) for _, s in rows), abs=1e-9)
    test = model_queries._prepared(spark, SMOKE_DIR)[1]
    again = metrics.summary_metrics(models.score(model_queries._model(spark, SMOKE_DIR, best), test), threshold=tuning["threshold"]).first()
    assert (again["f1"], again["recall"]) == pytest.approx((tuned["f1"], tuned["recall"]))


def test_selection_rules_are_checked(spark, outputs):
    with pytest.raises(ValueError):
        model_queries._best_key(spark, SMOKE_DIR, "train")


def test_models_come_back_from_the_store(spark, outputs, monkeypatch):
    before = model_queries.test_results(spark, SMOKE_DIR).collect()
    materialize._MATERIALIZED.clear()
    monkeypatch.setattr(models, "fit_family", lambda *_: pytest.fail("a stored model was fitted again"))
    assert sorted(map(str, model_queries.test_results(spark, SMOKE_DIR).collect())) == sorted(map(str, before))
    # other settings or an unfinished table are not taken for it
    path = model_store.store_path(spark, SMOKE_DIR, "forest", models.settings("forest"))
    assert model_store._exists(spark, path) and path != model_store.store_path(spark, SMOKE_DIR, "forest", "other")
    assert not model_store._exists(spark, f"{path}-never")


def test_a_second_process_answers_without_a_fit(spark, outputs):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    code = f"""
from dataclasses import replace
from clientele.plans import model_queries, models
from clientele.session import build_session
models.BOOSTERS = [replace(b, rounds=5) for b in models.BOOSTERS]
models.FOREST = replace(models.FOREST, trees=10)
def refuse(*_): raise SystemExit("fitted again")
models.fit_family = refuse
spark = build_session("local[2]", shuffle_partitions=2, extra={{"spark.checkpoint.dir": {folder!r}}})
print("rows", model_queries.test_results(spark, {SMOKE_DIR!r}).count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=churn_run.__file__.split("/clientele/")[0])
    assert "rows 4" in done.stdout, done.stderr[-2000:]
