"""k-means++ and the joint elbow against plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators import blocks as B
from clientele.operators import kmeans as K
from clientele.plans import clusters, report, retail_queries
from tests.conftest import SMOKE_DIR


def table(spark, x, parts=3):
    df = spark.createDataFrame([(0, i, 0, list(map(float, r))) for i, r in enumerate(x)], "fit_set int, id long, label int, x array<double>")
    df = df.withColumn("key", B.row_key("id"))
    return B.to_blocks(df.repartition(parts)), np.array([r["key"] for r in df.orderBy("id").collect()])


def brute(x, keys, ks, starts, seed, tol=1e-4, max_iter=300):
    best = {}
    for i in (seed * 1000 + j for j in range(starts)):
        centers = []
        for step in range(max(ks)):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0) if centers else np.ones(len(x))
            time = K.race(keys, i, step, d)
            centers.append(x[np.lexsort((keys, time))[0]] if np.isfinite(time.min()) else centers[-1])
        for k in ks:
            c = np.array(centers[:k])
            for _ in range(max_iter):
                at = np.argmin([((x - m) ** 2).sum(axis=1) for m in c], axis=0)
                new = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
                moved, c = ((new - c) ** 2).sum(), new
                if moved <= tol * x.var(axis=0).mean():
                    break
            inertia = np.min([((x - m) ** 2).sum(axis=1) for m in c], axis=0).sum()
            if k not in best or inertia < best[k][0] - 1e-6:
                best[k] = inertia, c
    return best


def test_fits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(120, 3)) * 0.4 + m for m in ([0, 0, 0], [3, 0, 1], [0, 4, -2])] + [np.ones((30, 3))])
    points, keys = table(spark, x)
    got = K.train(points, [1, 2, 3, 5], starts=4, seed=7)
    want = brute(x, keys, [1, 2, 3, 5], 4, 7)
    for k, (inertia, centers) in want.items():
        assert got[k].inertia == pytest.approx(inertia, abs=1e-3) and np.allclose(got[k].centers, centers, atol=1e-5)
    assert got[1].inertia == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(), rel=1e-6)
    again = K.train(points.repartition(4).checkpoint(), [3], starts=4, seed=7)
    assert (again[3].centers == got[3].centers).all() and again[3].inertia == got[3].inertia


def test_first_centres_follow_their_odds():
    """Starts draw points with odds in proportion to their weight."""
    keys = np.arange(4, dtype=np.int64) * 7919 + 1
    weight = np.array([1.0, 2.0, 0.0, 5.0])
    wins = np.bincount([np.argmin(K.race(keys, i, 3, weight)) for i in range(4000)], minlength=4) / 4000
    assert np.allclose(wins, weight / 8, atol=0.03) and wins[2] == 0


def test_fewer_points_than_clusters_and_no_points(spark):
    points, _ = table(spark, [[1.0, 2.0]] * 4 + [[3.0, 4.0]])
    found = K.train(points, [1, 2, 4], starts=2)
    assert found[4].inertia == 0 and len(np.unique(found[2].centers, axis=0)) == 2
    empty = spark.createDataFrame([], "fit_set int, key long, label int, x array<double>")
    assert K.train(B.to_blocks(empty), [2]) == {}


def test_clusters_profile_and_elbow_of_the_users(spark):
    from clientele.plans import rfm as plan
    table_ = plan.rfm_table(retail_queries.user_table(spark, SMOKE_DIR)).cache()
    rows = clusters._points(table_).collect()
    x = np.array([r["x"] for r in rows])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)
    keys = np.array([r[0] for r in table_.sparkSession.createDataFrame([(r["customer_id"],) for r in rows], "customer_id long").select(
        B.row_key("customer_id")).collect()])
    want = brute(x, keys, [1, 2, 3, 5], 10, clusters.SEED)
    elbow = {r["k"]: r["inertia"] for r in clusters.elbow(table_, ks=[1, 2, 3, 5]).collect()}
    assert elbow == pytest.approx({k: v[0] for k, v in want.items()}, rel=1e-5)
    found = {r["customer_id"]: r["cluster"] for r in clusters.rfm_clusters(table_).collect()}
    label = np.argmin([((x - c) ** 2).sum(axis=1) for c in want[5][1]], axis=0)
    money = {r["customer_id"]: float(r["monetary"]) for r in table_.collect()}
    order = sorted(set(label), key=lambda c: np.mean([money[r["customer_id"]] for r, l in zip(rows, label) if l == c]))
    assert found == {r["customer_id"]: order.index(l) for r, l in zip(rows, label)}
    profile = clusters.cluster_profile(table_, clusters.rfm_clusters(table_)).collect()
    sizes = np.bincount(list(found.values()))
    assert {r["cluster"]: r["users"] for r in profile} == dict(enumerate(sizes.tolist()))
    for r in profile:
        own = [money[c] for c, k in found.items() if k == r["cluster"]]
        assert r["avg_monetary"] == pytest.approx(np.mean(own)) and r["total_monetary"] == pytest.approx(sum(own))
        assert r["pct"] == pytest.approx(100 * len(own) / len(found), abs=0.051)
    figures = report.cluster_figures(spark.createDataFrame(profile)).where(F.col("metric").endswith(".users")).collect()
    assert sorted(int(r["value"]) for r in figures) == sorted(sizes.tolist())
