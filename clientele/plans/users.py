"""User-level metrics and their distributions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band_index, elapsed_days, pct_rounded, ratio
from ..operators.ranking import exact_quantiles

INF = float("inf")

# Cut points and labels of the reference's bands.
SPEND_EDGES = [0, 100, 500, 1000, 3000, 5000, 10000, INF]
SPEND_LABELS = ["<100", "100-500", "500-1K", "1K-3K", "3K-5K", "5K-10K", ">10K"]
FREQUENCY_EDGES = [0, 1, 2, 5, 10, 20, 50, INF]
FREQUENCY_LABELS = ["1", "2", "3-5", "6-10", "11-20", "21-50", "50+"]
INTERVAL_EDGES = [0, 7, 14, 30, 60, 90, 180, INF]
INTERVAL_LABELS = ["<7d", "7-14d", "14-30d", "30-60d", "60-90d", "90-180d", ">180d"]


def order_totals(clean: DataFrame) -> DataFrame:
    """A1: one row per (customer, invoice) with its revenue, quantity and time span."""
    return clean.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").alias("first_ts"), F.max("invoice_date").alias("last_ts"),
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))


def user_metrics(clean: DataFrame) -> DataFrame:
    """A2–A4: first/last purchase, orders, quantity, revenue, mean order
    value and lifetime days per customer.

    Two-level aggregation (lines → orders → users), each level with
    map-side partial aggregation, so a customer holding a third of all lines
    still reaches the user-level shuffle as one row per map task.  The mean
    order value is ``revenue / orders`` over the same set of orders, so no
    join back to the order table is needed.
    """
    users = order_totals(clean).groupBy("customer_id").agg(
        F.min("first_ts").alias("first_purchase"), F.max("last_ts").alias("last_purchase"),
        F.count(F.lit(1)).alias("total_orders"), F.sum("quantity").cast("long").alias("total_quantity"),
        F.sum("revenue").alias("total_revenue"))
    return users.select("*", ratio("total_revenue", "total_orders").alias("avg_order_value"),
                        elapsed_days("first_purchase", "last_purchase").alias("life_days"))


def _dense_bands(users: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str],
                 right_closed: bool = True) -> DataFrame:
    """Count users per band in one aggregate; every band is reported, empty
    ones with 0 (categorical ``value_counts``); share is of *all* users."""
    b = band_index(F.col(value), edges, right_closed)
    one = users.agg(F.count(F.lit(1)).alias("_all"),
                    *[F.count_if(b == F.lit(i)).alias(f"_b{i}") for i in range(len(labels))])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("band_ord"), F.lit(lbl).alias("band"),
                              F.col(f"_b{i}").alias("users")) for i, lbl in enumerate(labels)])
    long = one.select("_all", F.explode(rows).alias("r")).select("_all", "r.*")
    return long.select("band_ord", "band", "users", pct_rounded("users", "_all", 1).alias("pct"))


def spend_bands(users: DataFrame, edges: Sequence[float] = SPEND_EDGES,
                labels: Sequence[str] = SPEND_LABELS) -> DataFrame:
    """Right-closed spend bands; spend ≤ 0 is in no band."""
    return _dense_bands(users, "total_revenue", edges, labels)


def frequency_bands(users: DataFrame, edges: Sequence[float] = FREQUENCY_EDGES,
                    labels: Sequence[str] = FREQUENCY_LABELS) -> DataFrame:
    """Right-closed order-count bands."""
    return _dense_bands(users, "total_orders", edges, labels)


def purchase_intervals(users: DataFrame) -> DataFrame:
    """Users with ≥ 2 orders and their mean days between orders."""
    multi = users.where(F.col("total_orders") >= 2)
    return multi.select("customer_id", (F.col("life_days").cast("double") /
                                        (F.col("total_orders") - 1).cast("double")).alias("interval_days"))


def interval_bands(users: DataFrame, edges: Sequence[float] = INTERVAL_EDGES,
                   labels: Sequence[str] = INTERVAL_LABELS) -> DataFrame:
    """Bands of the mean purchase interval; an interval of 0 is in no
    band.  Shares are of the multi-order users."""
    return _dense_bands(purchase_intervals(users), "interval_days", edges, labels)


def purchase_interval(users: DataFrame) -> DataFrame:
    """Median mean-interval of multi-order users."""
    iv = purchase_intervals(users)
    med = exact_quantiles(iv, "interval_days", {"median": 0.5}).scalar()
    return iv.agg(F.count(F.lit(1)).alias("multi_order_users")).select(
        "multi_order_users", med.getField("median").alias("median_interval_days"))


def spend_summary(users: DataFrame) -> DataFrame:
    """Mean, median and max spend per user."""
    med = exact_quantiles(users, "total_revenue", {"median": 0.5}).scalar()
    return users.agg(F.count(F.lit(1)).alias("users"),
                     ratio(F.sum("total_revenue"), F.count(F.lit(1))).alias("mean_spend"),
                     F.max("total_revenue").cast("double").alias("max_spend")
                     ).select("users", "mean_spend", med.getField("median").alias("median_spend"), "max_spend")


def repeat_purchase(users: DataFrame) -> DataFrame:
    """Repeat buyers vs one-time buyers, mean and median orders."""
    med = exact_quantiles(users, "total_orders", {"median": 0.5}).scalar()
    one = users.agg(F.count(F.lit(1)).alias("users"),
                    F.count_if(F.col("total_orders") > 1).alias("repeat_users"),
                    F.count_if(F.col("total_orders") == 1).alias("one_time_users"),
                    ratio(F.sum("total_orders"), F.count(F.lit(1))).alias("mean_orders"))
    return one.select("users", "repeat_users", "one_time_users",
                      pct_rounded("repeat_users", "users", 1).alias("repeat_pct"),
                      pct_rounded("one_time_users", "users", 1).alias("one_time_pct"),
                      "mean_orders", med.getField("median").alias("median_orders"))


def report_tiers(users: DataFrame) -> DataFrame:
    """The report's left-closed spend tiers and its order tiers."""
    spend = F.col("total_revenue")
    orders = F.col("total_orders")
    tiers = [("spend", 1, "<500", spend < 500), ("spend", 2, "500-3000", (spend >= 500) & (spend < 3000)),
             ("spend", 3, ">=3000", spend >= 3000), ("orders", 1, "1", orders == 1),
             ("orders", 2, "2-5", (orders >= 2) & (orders <= 5)), ("orders", 3, ">=6", orders >= 6)]
    one = users.agg(F.count(F.lit(1)).alias("_all"),
                    *[F.count_if(cond).alias(f"_t{i}") for i, (_, _, _, cond) in enumerate(tiers)])
    rows = F.array(*[F.struct(F.lit(kind).alias("tier_kind"), F.lit(o).alias("tier_ord"), F.lit(lbl).alias("tier"),
                              F.col(f"_t{i}").alias("users")) for i, (kind, o, lbl, _) in enumerate(tiers)])
    long = one.select("_all", F.explode(rows).alias("r")).select("_all", "r.*")
    return long.select("tier_kind", "tier_ord", "tier", "users", pct_rounded("users", "_all", 1).alias("pct"))


def ltv_histogram(users: DataFrame, bins: int = 60) -> DataFrame:
    """Equal-width histogram of spend between its min and max; every
    bin reported (the maximum falls in the last bin)."""
    x = F.col("total_revenue").cast("double")
    rng = users.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    r = rng.select(F.struct("lo", "hi").alias("r")).scalar()
    width = F.nullif((r.getField("hi") - r.getField("lo")) / F.lit(float(bins)), F.lit(0.0))
    b = F.least(F.lit(bins - 1), F.coalesce(F.floor((x - r.getField("lo")) / width), F.lit(0)).cast("int"))
    counts = users.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("users"))
    grid = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    dense = grid.join(counts, "bin", "left")
    return dense.select("bin", (F.col("lo") + w * F.col("bin")).alias("bin_start"),
                        (F.col("lo") + w * (F.col("bin") + 1)).alias("bin_end"),
                        F.coalesce(F.col("users"), F.lit(0)).alias("users"))
