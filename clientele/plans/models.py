"""The churn model workflow.

Feature table → exact stratified split → per fit set (the training rows, the
tuning rows, the training rows of each fold): SMOTE, then all models of all
fit sets in shared passes (``operators.boosting``, ``forest``, ``logistic``).
Held-out rows are scored by broadcast models; every fold's metrics come from
one grouped query.  Decisions (best model, threshold) are made on tiny metric
tables; the data never passes through the driver.
"""
from __future__ import annotations

import math
import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, boosting, forest, logistic, metrics, split, trees
from ..operators.ranking import global_rank
from ..operators.smote import smote
from ..session import ensure_checkpoint_dir
from ..sources.churn import CATEGORICAL, ID
from . import churn

SEED = 42
CV_FOLDS = 5
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.2
# Rows whose attributions one task works out, at most.
SHAPLEY_ROWS = 10_000
# Model keys and display names of the reference.
DISPLAY_NAMES = {
    "logistic_regression": "Logistic Regression",
    "random_forest": "Random Forest",
    "hist_gradient_boosting": "HistGradientBoosting",
    "xgboost": "XGBoost",
}


def feature_table(labelled: DataFrame, train: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """impute, one-hot (all levels), assemble → (id, label DOUBLE, features).

    The median is taken over ``train`` if given, else over all rows as in the reference."""
    if train is None:
        imputed = churn.impute_median(labelled, "avg_days_between_orders")
    else:
        imputed = churn.impute_from(train, labelled, "avg_days_between_orders")
    levels = churn.categorical_levels(imputed, CATEGORICAL)
    encoded = churn.one_hot(imputed, CATEGORICAL, levels)
    names = churn.model_columns(levels)
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(
        encoded.select(ID, F.col("label").cast("double").alias("label"), *[F.col(f"`{n}`").cast("double").alias(n)
                                                                           for n in names]))
    return assembled.select(ID, "label", "features"), names


# The reference's hyper-parameters (and the defaults of the settings it leaves open).
BOOSTERS = [
    boosting.Booster("hist_gradient_boosting", rounds=250, rate=0.08, depth=6, leaves=31, min_rows=20),
    boosting.Booster("xgboost", rounds=400, rate=0.05, depth=4, min_hessian=3.0, l2=1.0, row_share=0.85, column_share=0.85, prior=False),
]
FOREST = forest.Forest(trees=300, depth=8, min_split=6)
LOGISTIC_C = 1.0


def balanced(train: DataFrame, dim: int) -> DataFrame:
    """M7: the training rows plus SMOTE rows (key, label, x), stored once for all models fitted on them.

    (Class weights would be a no-op after balancing, so none are used.)
    """
    data = smote(train, ID, "label", "features", dim=dim)
    ensure_checkpoint_dir(train.sparkSession, local_default=True)
    return data.select(blocks.row_key(ID, "origin", "draw").alias("key"), F.col("label").cast("int").alias("label"),
                       vector_to_array("features").alias("x")).checkpoint(eager=True)


def fit_sets(tables: dict[int, DataFrame]) -> DataFrame:
    """Balanced tables by number as one table of blocks, on which all models are fitted."""
    rows = None
    for number, table in tables.items():
        part = table.withColumn("fit_set", F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    return blocks.to_blocks(rows)


# Models that are grown in the same passes, if several of them are asked for.
FAMILIES = {"logistic_regression": "logistic", "random_forest": "forest", "hist_gradient_boosting": "boosters", "xgboost": "boosters"}


def fit_family(family: str, sets: DataFrame, keys: list[str] | None = None) -> dict[tuple[int, str], object]:
    """{(fit set, model key): model} of one family (or of the ``keys`` in it), for all fit sets at once."""
    if family == "boosters":
        return boosting.train(sets, [b for b in BOOSTERS if keys is None or b.name in keys])
    if family == "forest":
        return {(s, "random_forest"): m for s, m in forest.train(sets, FOREST).items()}
    return {(s, "logistic_regression"): m for s, m in logistic.train(sets, LOGISTIC_C).items()}


def settings(family: str) -> str:
    """What the models of a family depend on besides their rows."""
    return repr({"boosters": BOOSTERS, "forest": FOREST, "logistic": LOGISTIC_C}[family])


def score(model, df: DataFrame) -> DataFrame:
    """Probability of class 1 as ``score``."""
    rows = df.select(ID, F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x"))
    return trees.with_score(model, rows, "x").drop("x")


def split_features(labelled: DataFrame, global_impute: bool = True):
    """Feature table with its ``split`` column, checkpointed: every model
    fit, fold and score below reads this table, so its lineage is cut once
    (reliable checkpoint in ``spark.checkpoint.dir``, which survives lost
    executors; never a local checkpoint)."""
    train = None
    if not global_impute:
        # The split depends on id and label alone, so it can be drawn before the features exist.
        ids = split.stratified_split(labelled.select(ID, "label"), "label", ID, TEST_FRACTION, SEED)
        train = labelled.join(ids.where("split = 'train'").select(ID), ID)
    feats, names = feature_table(labelled, train)
    parts = split.stratified_split(feats, "label", ID, TEST_FRACTION, SEED)
    ensure_checkpoint_dir(parts.sparkSession, local_default=True)
    return parts.checkpoint(eager=True), names


def feature_importance(key: str, model, names: list[str]) -> DataFrame | None:
    """A forest's mean impurity decreases, average gain per split of the Newton boosters, |coefficients| of the
    linear model, ranked; None for best-first boosting, which has no importances of its own in the reference."""
    if key == "hist_gradient_boosting":
        return None
    vals = model.importance(len(names), average=True) if key == "xgboost" else model.importance(len(names))
    rows = sorted(((n, float(v)) for n, v in zip(names, vals)), key=lambda x: (-x[1], x[0]))
    return SparkSession.getActiveSession().createDataFrame(
        [(i + 1, n, v) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


def ranked_by(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """A small result table with its ``rank``: highest ``value`` first."""
    return df.select(F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), *ties)).alias("rank"), "*")


def _feature_names(names: list[str]):
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])


def permutation_importance(model, test: DataFrame, names: list[str], repeats: int = 10,
                           seed: int = SEED) -> DataFrame:
    """Mean drop in ROC-AUC when one feature's values are permuted
    across the test rows, ``repeats`` times per feature; every permuted
    copy is scored in one job and all AUCs come from one grouped query.

    Rows are numbered 0..n-1 in the order of a hash; the permutation of copy
    (feature, repeat) is the bijection i -> (a·i + b) mod n with its own a
    (coprime to n) and b, so no copy is sorted and only the donor's one
    value travels.
    """
    n = test.count()
    base = global_rank(test.select(ID, "label", vector_to_array("features").alias("_x")),
                       [F.md5(F.concat(F.col(ID).cast("string"), F.lit(str(seed)))), F.col(ID)], rank_col="_i")
    base = base.withColumn("_i", F.col("_i") - 1)
    rng = random.Random(seed)

    def coprime() -> int:
        while math.gcd(a := rng.randrange(1, max(n, 2)), n) != 1:
            pass
        return a
    keys = F.array(*[F.struct(F.lit(f).alias("_f"), F.lit(r).alias("_r"), F.lit(coprime()).cast("long").alias("_a"),
                              F.lit(rng.randrange(max(n, 1))).cast("long").alias("_b"))
                     for f in range(len(names)) for r in range(repeats)])  # one entry per feature and repeat
    copies = base.select("_i", F.explode(keys).alias("k")).select(
        "_i", "k._f", "k._r", F.expr(
            f"cast((cast(k._a as decimal(18,0)) * cast(_i as decimal(18,0)) + k._b) % {max(n, 1)} as bigint)").alias("_donor"))
    values = base.select(F.col("_i").alias("_donor"), F.posexplode("_x").alias("_f", "_v"))
    swapped = copies.join(values, ["_donor", "_f"]).join(base, "_i").select(
        "_f", "_r", F.col("label").cast("int").alias("label"), F.transform(
            "_x", lambda x, j: F.when(j == F.col("_f"), F.col("_v")).otherwise(x)).alias("x"))
    scored = trees.with_score(model, swapped, "x").drop("x")
    aucs = metrics.grouped_metrics(scored, ["_f", "_r"]).select("_f", "_r", "roc_auc")
    base_auc = metrics.roc_auc(score(model, test)).select(F.struct("roc_auc").alias("s")).scalar()
    diffs = aucs.select("_f", (base_auc.getField("roc_auc") - F.col("roc_auc")).alias("_drop"))
    drops = diffs.groupBy("_f").agg(F.avg("_drop").alias("importance"))
    return ranked_by(drops.select(F.element_at(_feature_names(names), F.col("_f")).alias("feature"), "importance"),
                     "importance", "feature")


def shapley_importance(model, rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean |attribution| per feature over ``rows``: exact path-dependent Shapley values of the raw score of a
    tree model, one pass over the rows, dealt to all cores (a row meets every leaf, so a few thousand are work for many)."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / SHAPLEY_ROWS))
    found = trees.with_attributions(model, rows.select(vector_to_array("features").alias("x")).repartition(parts), "x")
    imp = found.select(F.posexplode("attribution").alias("_f", "_phi")).groupBy("_f").agg(F.avg(F.abs("_phi")).alias("mean_abs_shap"))
    return ranked_by(imp.select(F.element_at(_feature_names(names), F.col("_f")).alias("feature"), "mean_abs_shap"),
                     "mean_abs_shap", "feature")
