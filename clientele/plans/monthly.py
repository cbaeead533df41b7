"""Month-level statistics.

Every query here first reduces lines to one row per (month, customer),
then to one row per month.  The month table is bounded by the time span,
not the data volume, so windows over it (moving average, second-to-last
month) run on a handful of rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, year_month


def user_months(clean: DataFrame) -> DataFrame:
    """One row per (month, customer): distinct invoices, revenue."""
    return (clean.withColumn("year_month", year_month("invoice_date"))
            .groupBy("year_month", "customer_id")
            .agg(F.count_distinct("invoice").alias("orders"), F.sum("revenue").alias("revenue")))


def new_users_by_month(users: DataFrame) -> DataFrame:
    """Users by month of first purchase."""
    return (users.groupBy(year_month("first_purchase").alias("year_month"))
            .agg(F.count(F.lit(1)).alias("new_users")))


def monthly_user_stats(clean: DataFrame, users: DataFrame) -> DataFrame:
    """A5 + J2: MAU, revenue, distinct orders and new users per month.

    Lines are reduced to (month, invoice, customer) first; the two distinct
    counts then run on that table, not on the lines.  An invoice of two
    customers is one order of the month.
    """
    orders = (clean.groupBy(year_month("invoice_date").alias("year_month"), "invoice", "customer_id")
              .agg(F.sum("revenue").alias("revenue")))
    months = orders.groupBy("year_month").agg(
        F.count_distinct("customer_id").alias("mau"), F.sum("revenue").alias("total_revenue"),
        F.count_distinct("invoice").alias("total_orders"))
    return (months.join(new_users_by_month(users), "year_month", "left")
            .select("year_month", "mau", "total_revenue", "total_orders",
                    F.coalesce(F.col("new_users"), F.lit(0)).cast("long").alias("new_users")))


def complete_months(monthly: DataFrame) -> DataFrame:
    """The month table without its last month, which the data may end in the middle of."""
    last = monthly.agg(F.max("year_month")).scalar()
    return monthly.where(F.col("year_month") < last)


def monthly_kpi_summary(monthly: DataFrame, complete_months_only: bool = False) -> DataFrame:
    """A7, A12 (MAU peak) and T3: means over months, peak-MAU month and the
    latest complete month (second to last).  ``complete_months_only`` leaves
    the last month out of the means and the peak."""
    desc = Window.orderBy(F.col("year_month").desc())
    latest = (monthly.withColumn("_k", F.row_number().over(desc)).where(F.col("_k") == 2)
              .select(F.struct("year_month", "mau").alias("s")).scalar())
    if complete_months_only:
        monthly = complete_months(monthly)
    return monthly.agg(
        F.count(F.lit(1)).alias("months"),
        ratio(F.sum("mau"), F.count(F.lit(1))).alias("avg_mau"),
        ratio(F.sum("new_users"), F.count(F.lit(1))).alias("avg_new_users"),
        F.min_by("year_month", F.struct(-F.col("mau"), F.col("year_month"))).alias("peak_mau_month"),
        F.max("mau").alias("peak_mau"),
    ).select("*", latest.getField("year_month").alias("latest_complete_month"),
             latest.getField("mau").alias("latest_complete_mau"))


def best_worst_month(monthly: DataFrame) -> DataFrame:
    """Months with most / fewest new users (earliest month on a tie)."""
    return monthly.agg(
        F.min_by("year_month", F.struct(-F.col("new_users"), F.col("year_month"))).alias("max_new_month"),
        F.max("new_users").alias("max_new_users"),
        F.min_by("year_month", F.struct(F.col("new_users"), F.col("year_month"))).alias("min_new_month"),
        F.min("new_users").alias("min_new_users"))


def monthly_line_averages(clean: DataFrame) -> DataFrame:
    """Mean line revenue and mean line quantity per month (the
    reference labels these 'order value'; they are per line)."""
    return (clean.groupBy(year_month("invoice_date").alias("year_month"))
            .agg(ratio(F.sum("revenue"), F.count(F.lit(1))).alias("avg_line_revenue"),
                 ratio(F.sum("quantity"), F.count(F.lit(1))).alias("avg_line_quantity")))


def monthly_repeat_rate(clean: DataFrame) -> DataFrame:
    """Share of the month's users with ≥ 2 distinct invoices in
    that month; null for a month without any (index-aligned division)."""
    per = user_months(clean).groupBy("year_month").agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("orders") >= 2).alias("repeat_users"))
    rate = F.when(F.col("repeat_users") > 0, ratio("repeat_users", "users") * 100)
    return per.select("year_month", "users", "repeat_users", rate.alias("repeat_rate"))


def revenue_per_new_user(monthly: DataFrame) -> DataFrame:
    """Month revenue over its new users, null when there are none."""
    return monthly.select("year_month", "total_revenue", "new_users",
                          ratio("total_revenue", "new_users").alias("revenue_per_new_user"))


def revenue_moving_avg(monthly: DataFrame, months: int = 2) -> DataFrame:
    """Trailing ``months``-row mean of revenue (null until full)."""
    w = Window.orderBy("year_month").rowsBetween(-(months - 1), 0)
    avg = F.when(F.count(F.lit(1)).over(w) == months, ratio(F.sum("total_revenue").over(w), F.lit(months)))
    return monthly.select("year_month", "total_revenue", avg.alias("moving_avg"))


def revenue_mom(monthly: DataFrame) -> DataFrame:
    """Revenue change (%) against the previous calendar month; 0 when
    that month has no row (the reference's fallback)."""
    idx = (F.substring("year_month", 1, 4).cast("int") * 12 + F.substring("year_month", 6, 2).cast("int"))
    cur = monthly.select("year_month", "total_revenue", idx.alias("_m"))
    prev = cur.select((F.col("_m") + 1).alias("_m"), F.col("total_revenue").alias("prev_revenue"))
    j = cur.join(prev, "_m", "left")
    change = F.when(F.col("prev_revenue").isNull() | (F.col("prev_revenue") == 0), F.lit(0.0)).otherwise(
        ratio(F.col("total_revenue") - F.col("prev_revenue"), "prev_revenue") * 100)
    return j.select("year_month", "total_revenue", "prev_revenue", change.alias("mom_pct"))
