import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators.ranking import exact_quantiles, global_rank


def test_global_rank_and_running_sums(spark):
    df = spark.range(0, 2003).withColumn("v", (F.col("id") * 7919 % 97).cast("double"))
    out = global_rank(df, ["v", "id"], running={"cum": "v", "cnt": F.lit(1)}, num_partitions=7).toPandas()
    out = out.sort_values("rn")
    assert out.rn.tolist() == list(range(1, 2004))
    exp = out.sort_values(["v", "id"])
    assert (exp.rn.values == np.arange(1, 2004)).all()
    assert np.allclose(exp.cum.values, exp.v.cumsum().values)
    assert (exp.cnt.values == exp.rn.values).all()


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_exact_quantiles_match_linear_interpolation(spark, n):
    vals = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.7, "e": 1.0}
    got = exact_quantiles(df, "x", probs, num_partitions=3).first()["quantiles"]
    for k, p in probs.items():
        assert got[k] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_exact_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", {"m": 0.5}).first()["quantiles"]["m"] is None


@pytest.mark.parametrize("parts", [6, None])
def test_global_rank_on_shuffled_input_is_a_permutation(spark, parts):
    # Input read after a shuffle (nondeterministic order) with columns the
    # counting branch does not need: numbering must still be 1..n exactly once.
    base = spark.range(0, 5000).withColumn("k", (F.col("id") * 31 % 977).cast("long"))
    shuffled = base.repartition(9).withColumn("payload", F.concat(F.lit("p"), F.col("id").cast("string")))
    out = global_rank(shuffled, ["k", "id"], running={"cum": "k"}, num_partitions=parts).toPandas()
    assert sorted(out.rn.tolist()) == list(range(1, 5001))
    exp = out.sort_values(["k", "id"])
    assert (exp.rn.values == np.arange(1, 5001)).all()
    assert (exp.cum.values == exp.k.cumsum().values).all()


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_exact_quantiles_with_a_coarse_sketch(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    vals = np.where(rng.random(20_000) < 0.3, 5.0, rng.lognormal(1, 2, 20_000).round(3))  # a third in one value
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    probs = {f"p{i}": p for i, p in enumerate([0.001, 0.1, 0.25, 0.5, 0.62, 0.9, 0.9999])}
    got = exact_quantiles(df, "x", probs, accuracy=accuracy).first()["quantiles"]
    for k, p in probs.items():
        assert got[k] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-9)


@pytest.mark.parametrize("n", [1, 3, 10, 20_000])
def test_order_statistics_by_rank(spark, n):
    vals = sorted(np.random.default_rng(n).lognormal(1, 2, n).round(1))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantiles(df, "x", {"a": 0.8, "m": 0.5}, accuracy=1000, ranks={"a": lambda c: c - F.floor(c / 5)}).first()["quantiles"]
    at = n - n // 5
    assert got["a"] == (vals[at] if at < n else None)
    assert got["m"] == pytest.approx(float(np.percentile(vals, 50)))
