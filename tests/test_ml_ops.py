import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from clientele.operators import metrics, neighbours, split
from clientele.operators.smote import nearest_neighbours, smote


def fold_dist(x, y):
    """Euclidean distance summed left to right, as the Spark expression does."""
    return math.sqrt(sum((a - b) * (a - b) for a, b in zip(x, y)))


def check_knn(pts, got, k):
    """Each point's neighbours are at the k smallest distances (equal up to
    float rounding, so ties within 1e-12 may resolve either way)."""
    vec = dict(pts)
    for i, x in pts:
        want = sorted(fold_dist(x, y) for j, y in pts if j != i)[:k]
        nbrs = [j for _, j in sorted(got[i])]
        assert len(nbrs) == k and i not in nbrs and len(set(nbrs)) == k
        have = sorted(fold_dist(x, vec[j]) for j in nbrs)
        assert all(abs(a - b) <= 1e-12 for a, b in zip(have, want))


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(y for y, _ in rows)
    ap, tp_prev = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        ap += (tp - tp_prev) / P * tp / (tp + fp)
        tp_prev = tp
    return ap


@pytest.fixture
def scored(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]  # many ties
    return rows, spark.createDataFrame(rows, "label int, score double")


def test_auc_and_ap_with_ties(scored):
    rows, df = scored
    assert metrics.roc_auc(df, num_partitions=3).first().roc_auc == pytest.approx(brute_auc(rows))
    assert metrics.average_precision(df, num_partitions=3).first().average_precision == pytest.approx(brute_ap(rows))
    flipped = df.select("label", (-F.col("score")).alias("score"))
    assert metrics.roc_auc(flipped).first().roc_auc == pytest.approx(1 - brute_auc(rows))


def test_auc_edge_cases(spark):
    same = spark.createDataFrame([(0, 0.3), (1, 0.3), (1, 0.3)], "label int, score double")
    perfect = spark.createDataFrame([(0, 0.1), (1, 0.9)], "label int, score double")
    assert metrics.roc_auc(same).first().roc_auc == 0.5
    assert metrics.roc_auc(perfect).first().roc_auc == 1.0


def test_best_threshold_prefers_lowest_on_tie(spark):
    # Thresholds 0.8 and 0.2 both give F1 = 2/3; the lower one wins.
    df = spark.createDataFrame([(1, 0.8), (0, 0.5), (1, 0.2), (0, 0.1)], "label int, score double")
    best = metrics.best_threshold(df).first()
    assert best.threshold == 0.2
    empty = spark.createDataFrame([], "label int, score double")
    assert metrics.best_threshold(empty).first().threshold == 0.5


def test_confusion_and_report(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.1), (0, 0.7), (0, 0.2), (0, 0.3)], "label int, score double")
    cm = {(r.actual, r.predicted): r["count"] for r in metrics.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    rep = {r.label: r for r in metrics.classification_report(df).collect()}
    assert rep["Churn"].precision == 0.5 and rep["Churn"].support == 2
    assert rep["accuracy"].f1 == pytest.approx(0.6)


def test_stratified_split_and_folds(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "id long, label int")
    s = split.stratified_split(df, "label", "id", 0.2, num_partitions=5)
    got = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert got == {(1, "test"): 50, (1, "train"): 200, (0, "test"): 150, (0, "train"): 600}
    folds = split.stratified_folds(df, "label", "id", 5, num_partitions=5)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sorted(sizes) == [200] * 5
    again = split.stratified_split(df, "label", "id", 0.2, num_partitions=3)
    assert s.where("split = 'test'").select("id").exceptAll(again.where("split = 'test'").select("id")).count() == 0


def test_knn_is_exact(spark):
    rnd = random.Random(3)
    pts = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, x array<double>")
    got = {}
    for r in nearest_neighbours(df, "id", "x", 4, k=5, num_partitions=4).collect():
        got.setdefault(r.id, []).append((r.nbr_rank, r.nbr_id))
    check_knn(pts, got, 5)


def test_knn_with_many_copies_is_exact(spark):
    rnd = random.Random(11)
    hot = [0.5, 0.5, 0.5]
    pts = [(i, hot if i % 3 == 0 else [round(rnd.random(), 1) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(pts, "id long, x array<double>")
    got = {}
    for r in nearest_neighbours(df, "id", "x", 3, k=5, num_partitions=4).collect():
        got.setdefault(r.id, []).append((r.nbr_rank, r.nbr_id))
    check_knn(pts, got, 5)


def _plain_neighbours(pts, k):
    out = {}
    for i, x in pts:
        near = sorted((fold_dist(x, y), j) for j, y in pts if j != i)[:k]
        out[i] = [j for _, j in near]
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 7, 400])
def test_neighbours_in_small_pieces_are_exact(spark, monkeypatch, n):
    """Regions cut into pieces, visitors into blocks, a tree from few points: the result stays that of all pairs."""
    for name, value in {"PIECE_POINTS": 40, "VISIT_BLOCK": 30, "SAMPLE_POINTS": 100, "MAX_REGIONS": 3}.items():
        monkeypatch.setattr(neighbours, name, value)
    rnd = random.Random(17)
    pts = [(i, [rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.random()]) for i in range(n)]
    got = {}
    for r in neighbours.distinct_neighbours(spark.createDataFrame(pts, "id long, x array<double>"), 3, 5).collect():
        got.setdefault(r.qid, []).append((r.nbr_rank, r.nbr_id))
    want = _plain_neighbours(pts, 5)
    assert {i: [j for _, j in sorted(got.get(i, []))] for i, _ in pts} == want


def test_neighbour_search_does_not_grow_with_the_table(spark, monkeypatch):
    """Candidates per point stay flat beyond the largest number of regions."""
    monkeypatch.setattr(neighbours, "MAX_REGIONS", 4)
    rng = np.random.default_rng(3)
    made = [neighbours.candidates_per_point(spark.createDataFrame(
        pd.DataFrame({"id": np.arange(n), "x": list(rng.normal(size=(n, 3)))}), "id long, x array<double>"), 3) for n in (2000, 16000)]
    assert made[1] < 1.25 * made[0]


def test_smote_balances_and_interpolates(spark):
    rnd = random.Random(5)
    rows = [(i, 1.0 if i < 30 else 0.0, Vectors.dense([rnd.random() + (3 if i < 30 else 0), rnd.random()]))
            for i in range(130)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    schema = StructType([StructField("id", LongType()), StructField("label", DoubleType()),
                         StructField("features", VectorUDT())])
    df = spark.createDataFrame(rows, schema)
    out = smote(df, "id", "label", "features", num_partitions=4, dim=2)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0.0: 100, 1.0: 100}
    synth = [r.features for r in out.where("synthetic").collect()]
    minority = [r[2] for r in rows if r[1] == 1.0]
    lo = [min(v[j] for v in minority) for j in range(2)]
    hi = [max(v[j] for v in minority) for j in range(2)]
    assert all(lo[j] - 1e-12 <= v[j] <= hi[j] + 1e-12 for v in synth for j in range(2))


def test_grouped_metrics_match_per_group(spark):
    rnd = random.Random(13)
    rows = [(g, rnd.randint(0, 1), round(rnd.random(), 2)) for g in range(4) for _ in range(80)]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    got = {r.g: r for r in metrics.grouped_metrics(df, ["g"], num_partitions=3).collect()}
    for g in range(4):
        sub = [(y, s) for gg, y, s in rows if gg == g]
        assert got[g].roc_auc == pytest.approx(brute_auc(sub))
        assert got[g].average_precision == pytest.approx(brute_ap(sub))


def test_importances_of_a_fitted_model(spark, monkeypatch):
    """A label that follows one feature only: that feature ranks first by gain, coefficient, permutation and attribution."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    from clientele.plans import models
    rnd = random.Random(21)
    rows = []
    for i in range(160):
        x = [rnd.random() for _ in range(3)]
        rows.append((i, float(x[1] > 0.5), Vectors.dense(x)))
    schema = StructType([StructField("customer_id", LongType()), StructField("label", DoubleType()), StructField("features", VectorUDT())])
    df = spark.createDataFrame(rows, schema).repartition(3).cache()
    sets = models.fit_sets({0: df.selectExpr("customer_id as key", "int(label) as label", "features").withColumn(
        "x", vector_to_array("features")).drop("features")})
    names = ["a", "b", "c"]
    few = {"BOOSTERS": [replace(b, rounds=8) for b in models.BOOSTERS], "FOREST": replace(models.FOREST, trees=8)}
    for name, value in few.items():
        monkeypatch.setattr(models, name, value)
    fitted = {}
    for family in set(models.FAMILIES.values()):
        fitted |= models.fit_family(family, sets)
    for key in models.FAMILIES:
        model = fitted[0, key]
        tables = [(models.feature_importance(key, model, names), "importance"), (models.permutation_importance(model, df, names, repeats=4), "importance")]
        if key != "logistic_regression":
            tables.append((models.shapley_importance(model, df, names), "mean_abs_shap"))
        for table, value in tables:
            if table is None:
                assert key == "hist_gradient_boosting"
                continue
            found = sorted(table.collect(), key=lambda r: r["rank"])
            assert [r["rank"] for r in found] == [1, 2, 3] and found[0]["feature"] == "b"
            assert found[0][value] > 2 * max(abs(r[value]) for r in found[1:])
