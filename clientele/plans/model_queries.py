"""Model queries.  Fitted models have no SQL form: tests compare the learners with plain numpy, split by split.

Splits, balanced tables, fitted models and small result tables are built
once per application and state of the input files: several queries reuse
the same fit, as the reference's pipeline does inside one run.  A query says
which models it reads on which fit sets; those that are not there yet are
fitted together, and no others.  Fitted models
are also stored below the shared checkpoint folder (``model_store``), where a
later application finds them.
"""
from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import RLock

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, split
from ..operators.smote import smote
from ..sources.churn import ID
from . import churn, model_store, models
from .churn_queries import labelled
from .materialize import materialized, once

MODEL_KEYS = ["logistic_regression", "random_forest", "hist_gradient_boosting", "xgboost"]
TREE_KEYS = MODEL_KEYS[1:]
TUNED_SUFFIX = " (Tuned Threshold)"
# Numbers of the fit sets: the folds come first.
TRAIN_SET, TUNING_SET = models.CV_FOLDS, models.CV_FOLDS + 1


def _prepared(spark: SparkSession, sf_dir: str):
    def build():
        parts, names = models.split_features(labelled(spark, sf_dir))
        train = parts.where("split = 'train'").drop("split")
        return train, parts.where("split = 'test'").drop("split"), names, train.count()
    return once(spark, sf_dir, "split", build)


def _subtrain(spark, sf_dir):
    """The training rows split again (80/20, stratified) for tuning."""
    def build():
        train = _prepared(spark, sf_dir)[0]
        parts = split.stratified_split(train, "label", ID, models.VALIDATION_FRACTION, models.SEED).checkpoint()
        return parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")
    return once(spark, sf_dir, "subtrain", build)


def _folds(spark, sf_dir) -> DataFrame:
    """M2: the training rows with their fold."""
    return once(spark, sf_dir, "folds", lambda: split.stratified_folds(
        _prepared(spark, sf_dir)[0], "label", ID, models.CV_FOLDS, models.SEED).checkpoint(eager=True))


def _rows_of(spark, sf_dir, fit_set: int) -> DataFrame:
    """The rows of a fit set: the training rows, the tuning subset or the training rows of a fold."""
    if fit_set == TRAIN_SET:
        return _prepared(spark, sf_dir)[0]
    return _subtrain(spark, sf_dir)[0] if fit_set == TUNING_SET else _folds(spark, sf_dir).where(F.col("fold") != fit_set).drop("fold")


def _fit_sets(spark, sf_dir, fit_sets: list[int]) -> DataFrame:
    """SMOTE of the rows of some fit sets, as one table of blocks."""
    def build():
        dim = len(_prepared(spark, sf_dir)[2])
        rows = [_rows_of(spark, sf_dir, s) for s in fit_sets]
        with ThreadPoolExecutor(max_workers=len(rows)) as pool:
            return models.fit_sets(dict(zip(fit_sets, pool.map(
                lambda s, own: once(spark, sf_dir, f"balanced {s}", lambda: models.balanced(own, dim)), fit_sets, rows))))
    return once(spark, sf_dir, f"fit sets {fit_sets}", build)


def _models(spark, sf_dir, keys: list[str], fit_sets: Iterable[int]) -> dict[tuple[int, str], object]:
    """{(fit set, model key): model} of all ``keys`` on all ``fit_sets``.

    Those that neither this application nor the store has are fitted, the families side by side, and each family in
    shared passes."""
    fit_sets = sorted(fit_sets)

    def family_of(family: str) -> dict:
        own, settings = [k for k in keys if models.FAMILIES[k] == family], models.settings(family)
        lock, known = once(spark, sf_dir, f"models {family} {settings}", lambda: (RLock(), {}))
        with lock:
            if missing := [(s, k) for s in fit_sets for k in own if (s, k) not in known]:
                known |= model_store.stored(spark, sf_dir, family, settings, missing, lambda new_sets, new_keys: models.fit_family(
                    family, _fit_sets(spark, sf_dir, new_sets), new_keys))
            return {(s, k): known[s, k] for s in fit_sets for k in own}
    families = list(dict.fromkeys(models.FAMILIES[k] for k in keys))
    out: dict[tuple[int, str], object] = {}
    with ThreadPoolExecutor(max_workers=len(families)) as pool:
        for found in pool.map(family_of, families):
            out |= found
    return out


def _model(spark, sf_dir, key, fit_set: int = TRAIN_SET):
    """A fitted model."""
    return _models(spark, sf_dir, [key], [fit_set])[fit_set, key]


def _test_metrics(spark, sf_dir, keys: list[str]) -> DataFrame:
    """One row of test metrics per model.  The rows are scored once and stored; one grouped pass gives all metrics."""
    test, fitted = _prepared(spark, sf_dir)[1], _models(spark, sf_dir, keys, [TRAIN_SET])
    scored = None
    for k in keys:
        part = models.score(fitted[TRAIN_SET, k], test).select(F.lit(k).alias("model_key"), "label", "score")
        scored = part if scored is None else scored.unionByName(part)
    found = metrics.grouped_metrics(scored.checkpoint(eager=True), ["model_key"])
    names = F.create_map(*[F.lit(x) for k in keys for x in (k, models.DISPLAY_NAMES[k])])
    return found.select("model_key", F.element_at(names, F.col("model_key")).alias("model"), F.lit(metrics.THRESHOLD).alias("threshold"), "accuracy",
                        "roc_auc", "precision", "recall", "f1", F.coalesce("average_precision", F.lit(0.0)).alias("pr_auc"))


def test_results(spark, sf_dir) -> DataFrame:
    """Every model fitted on the training rows, scored on the test rows; best ROC-AUC first (``rank``)."""
    return materialized(spark, sf_dir, "test results", lambda: models.ranked_by(
        _test_metrics(spark, sf_dir, MODEL_KEYS), "roc_auc", "model_key"))


def cv_leaderboard(spark, sf_dir) -> DataFrame:
    """Mean and population std of five metrics over stratified folds, best mean ROC-AUC first (``rank``).

    All folds and models are fitted in the same passes; the held-out rows of each fold are scored by its models.
    """
    return materialized(spark, sf_dir, "cv", lambda: _cv_leaderboard(spark, sf_dir))


def _cv_leaderboard(spark, sf_dir) -> DataFrame:
    folds, scored = _folds(spark, sf_dir), None
    fitted = _models(spark, sf_dir, MODEL_KEYS, range(models.CV_FOLDS))
    for k in MODEL_KEYS:
        for f in range(models.CV_FOLDS):
            part = models.score(fitted[f, k], folds.where(F.col("fold") == f)).select(
                F.lit(k).alias("model_key"), F.lit(f).alias("fold"), "label", "score")
            scored = part if scored is None else scored.unionByName(part)
    per_fold = metrics.grouped_metrics(scored.checkpoint(eager=True), ["model_key", "fold"])
    ms = ("roc_auc", "f1", "precision", "recall", "average_precision")
    board = per_fold.groupBy("model_key").agg(*[F.avg(m).alias(f"cv_{m}_mean") for m in ms],
                                              *[F.stddev_pop(m).alias(f"cv_{m}_std") for m in ms])
    names_map = F.create_map(*[F.lit(x) for kv in models.DISPLAY_NAMES.items() for x in kv])
    board = board.select("model_key", F.element_at(names_map, F.col("model_key")).alias("model"),
                         *[c for c in board.columns if c != "model_key"])
    return models.ranked_by(board, "cv_roc_auc_mean", "model_key")


def _best_key(spark, sf_dir, select_on: str = "test") -> str:
    """Key of the best model by test ROC-AUC (``test``, as the reference does) or by cross-validation (``cv``)."""
    if select_on not in ("test", "cv"):
        raise ValueError(f"select_on is 'test' or 'cv', not {select_on!r}")
    board = test_results(spark, sf_dir) if select_on == "test" else cv_leaderboard(spark, sf_dir)
    return once(spark, sf_dir, f"best {select_on}", lambda: board.where("rank = 1").first()["model_key"])


def threshold_tuning(spark, sf_dir, select_on: str = "test") -> DataFrame:
    """Refit the best model on 80 % of the training rows and pick
    the F1-best threshold on the other 20 %."""
    key = _best_key(spark, sf_dir, select_on)

    def build() -> DataFrame:
        _, valid = _subtrain(spark, sf_dir)
        s = models.score(_model(spark, sf_dir, key, TUNING_SET), valid)
        return metrics.best_threshold(s, "f1").select(F.lit(key).alias("model_key"), "*")
    return materialized(spark, sf_dir, f"tuning {key}", build)


def tuned_results(spark, sf_dir, select_on: str = "test") -> DataFrame:
    """Test metrics of the best model (fitted on all training rows, Q5) at the tuned threshold."""
    key = _best_key(spark, sf_dir, select_on)

    def build() -> DataFrame:
        t = threshold_tuning(spark, sf_dir, select_on).first()["threshold"]  # one number: a decision
        s = models.score(_model(spark, sf_dir, key), _prepared(spark, sf_dir)[1])
        return metrics.summary_metrics(s, threshold=t).select(
            F.lit(key).alias("model_key"), F.lit(models.DISPLAY_NAMES[key] + TUNED_SUFFIX).alias("model"), "*")
    return materialized(spark, sf_dir, f"tuned {key}", build)


def feature_importance(spark, sf_dir, key: str | None = None) -> DataFrame:
    """Of the best model (or ``key``): tree importances, else |coefficients|, else permutation importance."""
    key = key or _best_key(spark, sf_dir)
    _, test, names, _ = _prepared(spark, sf_dir)
    model = _model(spark, sf_dir, key)
    found = models.feature_importance(key, model, names)
    if found is None:
        found = models.permutation_importance(model, test, names)
    return found.select(F.lit(key).alias("model_key"), "*")


def permutation_importance(spark, sf_dir, key: str | None = None) -> DataFrame:
    """Of the best model, or of ``key``."""
    key = key or _best_key(spark, sf_dir)
    _, test, names, _ = _prepared(spark, sf_dir)
    return models.permutation_importance(_model(spark, sf_dir, key), test, names).select(F.lit(key).alias("model_key"), "*")


def shapley_importance(spark, sf_dir, key: str | None = None) -> DataFrame:
    """Attributions are made for tree models only: of the best model if it is one, else of the best that is."""
    if key is None:
        key = test_results(spark, sf_dir).where(F.col("model_key").isin(TREE_KEYS)).orderBy("rank").first()["model_key"]
    _, test, names, _ = _prepared(spark, sf_dir)
    return models.shapley_importance(_model(spark, sf_dir, key), test, names).select(F.lit(key).alias("model_key"), "*")


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """One row per feature of a table with a ``features`` vector."""
    return df.select("*", F.posexplode(vector_to_array("features")).alias("_j", "value")).select(
        "*", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_j") + 1).alias("feature")).drop("features", "_j")


def smote_oversample(spark, sf_dir) -> DataFrame:
    """M3: the balanced training table, one row per (row, feature); synthetic rows are named by origin and draw."""
    train, _, names, _ = _prepared(spark, sf_dir)
    out = smote(train, ID, "label", "features", dim=len(names))
    key = F.when(F.col("synthetic"), F.concat(F.lit("s"), F.col("origin").cast("string"), F.lit("-"), F.col("draw").cast("string"))
                 ).otherwise(F.concat(F.lit("r"), F.col(ID).cast("string")))
    return _long(out.select(key.alias("row_key"), F.col("label").cast("int").alias("label"), "synthetic", "features"), names)


def churn_features(spark, sf_dir) -> DataFrame:
    """the encoded feature table with its split, one row per (customer, feature)."""
    train, test, names, _ = _prepared(spark, sf_dir)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return _long(both.select(ID, F.col("label").cast("int").alias("label"), "split", "features"), names)


def business_insights(spark, sf_dir) -> DataFrame:
    return churn.business_insights(labelled(spark, sf_dir), feature_importance(spark, sf_dir))


def model_summary(spark, sf_dir) -> DataFrame:
    """The result document — best model, leaderboard, test results,
    tuned result, threshold, top-20 importances, dataset info — one row."""
    train, test, names, n_train = _prepared(spark, sf_dir)
    _models(spark, sf_dir, MODEL_KEYS, [*range(models.CV_FOLDS), TRAIN_SET])  # for the leaderboard and the tests, fitted together
    key = _best_key(spark, sf_dir)
    lab = labelled(spark, sf_dir)
    info = lab.agg(F.struct(F.count(F.lit(1)).alias("n_samples"), F.lit(len(names)).alias("n_features"),
                            F.avg("label").alias("churn_rate"), F.lit(n_train).alias("train_samples"),
                            F.lit(test.count()).alias("test_samples")).alias("s")).scalar()
    # Arrays are sorted by their first field, the rank: a collected list has no order of its own.
    tests = test_results(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("*")))).scalar()
    tuned = tuned_results(spark, sf_dir).agg(F.first(F.struct("*"))).scalar()
    thr = threshold_tuning(spark, sf_dir).agg(F.first(F.struct("*"))).scalar()
    imp = (feature_importance(spark, sf_dir).where("rank <= 20")
           .agg(F.sort_array(F.collect_list(F.struct("rank", "feature", "importance"))))).scalar()
    cv = cv_leaderboard(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("*")))).scalar()
    insights = business_insights(spark, sf_dir).select(F.struct("*")).scalar()
    one_row = lab.agg(F.count(F.lit(1)).alias("_rows"))  # one-row carrier for the document
    return one_row.select(F.struct(F.lit(key).alias("model_key"),
                                        F.lit(models.DISPLAY_NAMES[key]).alias("model")).alias("best_model"),
                               cv.alias("cross_validation"), tests.alias("test_results"),
                               tuned.alias("tuned_threshold_result"), thr.alias("threshold_optimization"),
                               imp.alias("feature_importances"), info.alias("dataset_info"),
                               insights.alias("business_insights"))


def _single(key):
    return lambda s, d: _test_metrics(s, d, [key])


QUERIES = {
    "churn_features": churn_features,
    "smote_oversample": smote_oversample,
    "model_logistic": _single("logistic_regression"),
    "model_forest": _single("random_forest"),
    "model_gbt": _single("hist_gradient_boosting"),
    "model_gbt_tuned": _single("xgboost"),
    "test_results": test_results,
    "cv_leaderboard": cv_leaderboard,
    "threshold_tuning": threshold_tuning,
    "tuned_results": tuned_results,
    "feature_importance": feature_importance,
    "permutation_importance": permutation_importance,
    "shapley_importance": shapley_importance,
    "model_summary": model_summary,
}
