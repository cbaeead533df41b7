"""KMeans on standardised R/F/M.

k-means++ starts and Lloyd steps of all fits in shared passes
(``operators.kmeans``); "best of ``n_init``" is the fit of least inertia.
Cluster ids are relabelled by mean monetary value so they mean the same in
every run (KMeans ids are arbitrary).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pct_rounded, ratio
from ..operators import blocks, kmeans
from . import rfm as rfm_plan

SEED = 42


def _points(rfm: DataFrame) -> DataFrame:
    """(customer_id, x): the standardised values, 0 where a column has no spread."""
    z = rfm_plan.standardized(rfm)
    return z.select("customer_id", F.array(*[F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in ("recency", "frequency", "monetary")]).alias("x"))


def _blocks(points: DataFrame) -> DataFrame:
    return blocks.to_blocks(points.select(F.lit(0).alias("fit_set"), blocks.row_key("customer_id").alias("key"), F.lit(0).alias("label"), "x"))


def rfm_clusters(rfm: DataFrame, k: int = 5, n_init: int = 10, seed: int = SEED) -> DataFrame:
    """M6: (customer_id, cluster) with clusters numbered by ascending mean monetary."""
    points = _points(rfm)
    fitted = kmeans.train(_blocks(points), [k], n_init, seed)
    if not fitted:
        return rfm.select("customer_id", F.lit(0).alias("cluster"))
    raw = kmeans.with_cluster(fitted[k], points, "x", "_c").drop("x")
    means = raw.join(rfm.select("customer_id", "monetary"), "customer_id").groupBy("_c").agg(
        F.avg(F.col("monetary").cast("double")).alias("_m"))
    order = means.select("_c", (F.row_number().over(Window.orderBy("_m", "_c")) - 1).alias("cluster"))  # k rows
    return raw.join(F.broadcast(order), "_c").select("customer_id", F.col("cluster").cast("int"))


def cluster_profile(rfm: DataFrame, clusters: DataFrame) -> DataFrame:
    """Users, mean R/F/M, total M and share per cluster."""
    j = rfm.join(clusters, "customer_id")
    n = rfm.agg(F.count(F.lit(1))).scalar()
    g = j.groupBy("cluster").agg(F.count(F.lit(1)).alias("users"),
                                 ratio(F.sum("recency"), F.count(F.lit(1))).alias("avg_recency"),
                                 ratio(F.sum("frequency"), F.count(F.lit(1))).alias("avg_frequency"),
                                 ratio(F.sum("monetary"), F.count(F.lit(1))).alias("avg_monetary"),
                                 F.sum("monetary").cast("double").alias("total_monetary"))
    return g.select("*", pct_rounded("users", n, 1).alias("pct"))


def elbow(rfm: DataFrame, ks=range(1, 11), n_init: int = 10, seed: int = SEED) -> DataFrame:
    """M5: inertia of the best fit for each k; all fits share each pass over the points."""
    fitted = kmeans.train(_blocks(_points(rfm)), list(ks), n_init, seed)
    return rfm.sparkSession.createDataFrame([(int(k), float(m.inertia)) for k, m in sorted(fitted.items())], "k int, inertia double")
