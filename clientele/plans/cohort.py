"""Cohort retention.

Lines are reduced to distinct (customer, month) pairs with map-side
de-duplication, so a customer holding a third of all lines contributes at
most one row per month.  Everything after that is keyed by (cohort, period):
a table bounded by months², not by data volume.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_index, pct_rounded, ratio, year_month


def user_cohort(clean: DataFrame) -> DataFrame:
    """Month of each customer's first purchase."""
    first = clean.groupBy("customer_id").agg(F.min("invoice_date").alias("_first"))
    return first.select("customer_id", year_month("_first").alias("cohort_month"),
                        F.trunc("_first", "MM").alias("cohort_start"))


def cohort_counts(clean: DataFrame) -> DataFrame:
    """Distinct users per (cohort, period index).

    One scan and one exchange: each customer's set of months (at most one
    entry per month of the data) is collected with map-side partial sets, and
    the cohort is its smallest entry."""
    months = clean.groupBy("customer_id").agg(F.collect_set(F.trunc("invoice_date", "MM")).alias("months"))
    active = months.select(F.array_min("months").alias("cohort_start"), F.explode("months").alias("order_start"))
    return (active.groupBy(F.date_format("cohort_start", "yyyy-MM").alias("cohort_month"),
                      month_index("cohort_start", "order_start").alias("period_index"))
            .agg(F.count(F.lit(1)).alias("users")))


def cohort_retention(clean: DataFrame) -> DataFrame:
    """Long form; the cohort size is its period-0 count (every
    user buys in their cohort month), rate in percent to one place."""
    counts = cohort_counts(clean)
    # Size from the (cohort, period) table itself — at most one row per month
    # per cohort — instead of a self-join that would plan the lines twice.
    size = F.sum(F.when(F.col("period_index") == 0, F.col("users"))).over(Window.partitionBy("cohort_month"))
    return (counts.withColumn("cohort_size", size)
            .select("cohort_month", F.col("period_index").cast("int").alias("period_index"), "users", "cohort_size",
                    pct_rounded("users", "cohort_size", 1).alias("retention_rate")))


def last_period(retention: DataFrame) -> int:
    """Months between the first cohort and the last month with an order: no cell has a larger period index."""
    month = month_index(F.lit("1970-01-01").cast("date"), F.to_date("cohort_month", "yyyy-MM"))
    last = retention.agg((F.max(month + F.col("period_index")) - F.min(month)).alias("last")).first()["last"]
    return last or 0


def cohort_matrix(retention: DataFrame, max_period: int) -> DataFrame:
    """Cohorts × period index 0..max_period, cells = retention rate (null = no users).
    The period list is given (``last_period``), so the pivot runs no query for it."""
    return retention.groupBy("cohort_month").pivot("period_index", list(range(max_period + 1))).agg(
        F.first("retention_rate"))


def retention_insight(retention: DataFrame, periods=(1, 3)) -> DataFrame:
    """C4: mean, best and worst cohort at the given period indexes, over the
    cohorts that have that period (earliest cohort wins a tie)."""
    sel = retention.where(F.col("period_index").isin(list(periods)))
    return sel.groupBy("period_index").agg(
        F.count(F.lit(1)).alias("cohorts"),
        ratio(F.sum("retention_rate"), F.count(F.lit(1))).alias("mean_rate"),
        F.max("retention_rate").alias("best_rate"),
        F.min_by("cohort_month", F.struct(-F.col("retention_rate"), F.col("cohort_month"))).alias("best_cohort"),
        F.min("retention_rate").alias("worst_rate"),
        F.min_by("cohort_month", F.struct(F.col("retention_rate"), F.col("cohort_month"))).alias("worst_cohort"))


def retention_curve(retention: DataFrame, max_period: int = 12) -> DataFrame:
    """Mean rate per period index over the cohorts that reach it."""
    return (retention.where(F.col("period_index") <= max_period).groupBy("period_index")
            .agg(F.count(F.lit(1)).alias("cohorts"),
                 ratio(F.sum("retention_rate"), F.count(F.lit(1))).alias("avg_retention")))


def retention_zero_filled(retention: DataFrame, max_period: int = 12) -> DataFrame:
    """The same mean with a missing (cohort, period) cell counted as 0 —
    the report's headline figure.  Sum over present cells divided by the
    number of cohorts: no dense grid is materialised."""
    n_cohorts = retention.where(F.col("period_index") == 0).agg(F.count(F.lit(1))).scalar()
    return (retention.where(F.col("period_index") <= max_period).groupBy("period_index")
            .agg(ratio(F.sum("retention_rate"), n_cohorts).alias("avg_retention_zero_filled")))
