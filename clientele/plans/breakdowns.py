"""Country, product and calendar breakdowns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pct_rounded, ratio


def country_users_top(clean: DataFrame, k: int = 10, users: DataFrame | None = None) -> DataFrame:
    """A10: customers per country, top ``k`` (name breaks ties), share of all
    customers.  With the user table at hand, the total is its row count
    instead of another distinct pass over the lines."""
    total = (users.agg(F.count(F.lit(1))) if users is not None
             else clean.agg(F.count_distinct("customer_id"))).scalar()
    per = clean.groupBy("country").agg(F.count_distinct("customer_id").alias("users"))
    top = per.orderBy(F.col("users").desc(), F.col("country").asc()).limit(k)
    return top.select("country", "users", pct_rounded("users", total, 1).alias("pct"))


def country_matrix(clean: DataFrame, min_users: int = 5) -> DataFrame:
    """Customers and mean line revenue per country, countries with at
    least ``min_users`` customers."""
    per = clean.groupBy("country").agg(F.count_distinct("customer_id").alias("users"),
                                       ratio(F.sum("revenue"), F.count(F.lit(1))).alias("avg_line_revenue"))
    return per.where(F.col("users") >= min_users)


def top_products(clean: DataFrame, k: int = 10) -> DataFrame:
    """Products with the highest revenue (ties by name)."""
    per = clean.groupBy("description").agg(F.sum("revenue").alias("revenue"))
    return per.orderBy(F.col("revenue").desc(), F.col("description").asc()).limit(k).select(
        "description", F.col("revenue").cast("double").alias("revenue"))


def weekday_hour(df: DataFrame, ts: str, amount: str, weekdays: list[int] | None = None) -> DataFrame:
    """Amount per (ISO weekday, hour), all 7 × 24 cells, empty → 0, in
    long form.  ``weekdays`` (1 = Monday) keeps only those days, as the
    reference does without Saturday."""
    t = F.col(ts)
    per = df.groupBy((F.weekday(t) + 1).alias("weekday_ord"), F.hour(t).alias("hour")).agg(
        F.sum(amount).alias("_amt"))
    # The 168-cell grid is generated from a rule, not read or collected.
    grid = df.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("int").alias("_d"),
                                                 (F.col("id") % 24).cast("int").alias("hour"))
    grid = grid.select((F.col("_d") + 1).alias("weekday_ord"), "hour",
                       F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("_d")), "EEEE").alias("weekday"))
    if weekdays is not None:
        grid = grid.where(F.col("weekday_ord").isin(list(weekdays)))
    out = grid.join(F.broadcast(per), ["weekday_ord", "hour"], "left")  # at most 168 rows
    return out.select("weekday_ord", "weekday", "hour",
                      F.coalesce(F.col("_amt").cast("double"), F.lit(0.0)).alias("revenue"))
