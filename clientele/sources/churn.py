"""The labelled customer table for the churn workflow.

Derived from the star schema (orders ⋈ customer ⋈ nation ⋈ region): cut
``T`` = latest order date − 365 days; features come from orders up to and
including ``T``; a customer active by ``T`` is labelled churned (1) when
they place no order after ``T``.

Columns: ``customer_id``, numerics ``tenure_days``, ``n_orders``,
``avg_order_value``, ``total_spend``, ``recency_days``, ``account_balance``,
``avg_days_between_orders`` (null for single-order customers), categoricals
``segment``, ``region``, ``priority`` (dominant order priority),
``negative_balance`` and ``high_priority`` (``Yes``/``No``), and ``churn``
(``Yes``/``No``) as in the reference's raw file.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import elapsed_days, ratio
from .tables import table

HORIZON_DAYS = 365
CATEGORICAL = ["segment", "region", "priority", "negative_balance", "high_priority"]
NUMERIC = ["tenure_days", "n_orders", "avg_order_value", "total_spend", "recency_days", "account_balance",
           "avg_days_between_orders"]
TARGET = "churn"
ID = "customer_id"


def churn_customers(spark: SparkSession, sf_dir: str, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    cut = orders.agg(F.max("o_orderdate") - F.make_interval(days=F.lit(horizon_days))).scalar()
    flagged = orders.withColumn("_before", F.col("o_orderdate") <= cut)
    # One aggregate per (customer, priority), folded per customer; the second shuffle moves a few rows a customer.
    count = F.col("_n") > 0
    per = flagged.groupBy("o_custkey", "o_orderpriority").agg(
        F.min(F.when(F.col("_before"), F.col("o_orderdate"))).alias("_first"),
        F.max(F.when(F.col("_before"), F.col("o_orderdate"))).alias("_last"),
        F.count_if("_before").alias("_n"),
        F.sum(F.when(F.col("_before"), F.col("o_totalprice").cast("decimal(14,2)"))).alias("_spend"),
        F.bool_or(~F.col("_before")).alias("_after")).groupBy("o_custkey").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_n").alias("n_orders"),
        F.sum("_spend").alias("_spend"), F.bool_or("_after").alias("_after"),
        # Dominant priority before the cut: most orders, then the smallest name.
        F.min_by("o_orderpriority", F.when(count, F.struct(-F.col("_n"), F.col("o_orderpriority")))).alias("priority"))
    region = (table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
              .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select("n_nationkey", "r_name"))
    cust = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
            .join(region, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    base = per.where(F.col("n_orders") > 0).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    tenure = elapsed_days("_first", cut)
    return base.select(
        F.col("o_custkey").alias(ID),
        tenure.alias("tenure_days"),
        F.col("n_orders"),
        ratio("_spend", "n_orders").alias("avg_order_value"),
        F.col("_spend").cast("double").alias("total_spend"),
        elapsed_days("_last", cut).alias("recency_days"),
        F.col("c_acctbal").alias("account_balance"),
        F.when(F.col("n_orders") >= 2, tenure.cast("double") / (F.col("n_orders") - 1).cast("double"))
        .alias("avg_days_between_orders"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("priority"),
        F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("negative_balance"),
        F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "Yes").otherwise("No").alias("high_priority"),
        F.when(F.col("_after"), "No").otherwise("Yes").alias(TARGET))
