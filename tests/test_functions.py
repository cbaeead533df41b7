
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.functions.columns import band_index, elapsed_days, month_index, pct_rounded, quartile_by_rank, translate
from clientele.plans.users import SPEND_EDGES


def test_bands_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 0.01, 100.0, 100.01, 500.0, 10000.0, 10000.01]], "x double")
    got = [r.b for r in df.select(band_index("x", SPEND_EDGES).alias("b")).collect()]
    assert got == [None, None, 0, 0, 1, 1, 5, 6]


def test_left_closed_bands(spark):
    df = spark.createDataFrame([(v,) for v in [499.99, 500.0, 3000.0]], "x double")
    got = [r.b for r in df.select(band_index("x", [0, 500, 3000, float("inf")], right_closed=False).alias("b")).collect()]
    assert got == [0, 1, 2]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 10, 13])
def test_quartile_by_rank_matches_qcut_of_ranks(spark, n):
    df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "rn long")
    got = [r.s for r in df.select(quartile_by_rank("rn", F.lit(n)).alias("s")).orderBy("rn").collect()]
    if n == 1:
        assert got == [1]
        return
    ranks = pd.Series(range(1, n + 1), dtype=float)
    want = pd.qcut(ranks, q=4, labels=[1, 2, 3, 4]).astype(int).tolist()
    assert got == want


def test_pct_rounded_half_up(spark):
    df = spark.createDataFrame([(1, 8), (1, 16), (1, 3), (2, 3), (0, 0)], "n long, d long")
    got = [r.p for r in df.select(pct_rounded("n", "d", 1).alias("p")).collect()]
    assert got == [12.5, 6.3, 33.3, 66.7, None]


def test_elapsed_days_counts_whole_24h_blocks(spark):
    df = spark.createDataFrame([("2010-01-01 23:00:00", "2010-01-02 22:59:00"),
                                ("2010-01-01 23:00:00", "2010-01-02 23:00:00")], "a string, b string")
    df = df.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert [r.d for r in df.select(elapsed_days("a", "b").alias("d")).collect()] == [0, 1]


def test_month_index(spark):
    df = spark.createDataFrame([("2009-12-31 10:00:00", "2010-01-01 00:00:00")], "a string, b string")
    df = df.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    assert df.select(month_index("a", "b").alias("m")).first().m == 1


def test_translate_passes_unknown_through(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    got = [r.t for r in df.select(translate("k", {"a": "A"}).alias("t")).collect()]
    assert got == ["A", "z"]
