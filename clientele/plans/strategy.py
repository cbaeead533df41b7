"""Lifecycle, funnel, concentration, migration and KPI queries
(W1, W6–W9, A27, A28, A30, A31, J7, F18, F26)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import elapsed_days, pct_rounded, ratio, translate
from ..operators.ranking import exact_quantiles, global_rank

# Lifecycle stages in the reference's display order.
STAGES = ["New", "Active", "VIP", "Growing", "Normal", "AtRisk"]


def lifecycle_stage(users: DataFrame, as_of: Column | None = None) -> DataFrame:
    """First matching rule; the 70th revenue percentile is computed
    once (exactly) and attached as a scalar, not per row."""
    ref = as_of if as_of is not None else users.agg(F.max("last_purchase")).scalar()
    q70 = exact_quantiles(users, "total_revenue", {"q70": 0.7}).scalar().getField("q70")
    d = elapsed_days("last_purchase", ref)
    orders = F.col("total_orders")
    stage = (F.when((orders == 1) & (d <= 90), "New")
             .when((orders >= 2) & (d <= 60),
                   F.when(F.col("total_revenue").cast("double") >= q70, "VIP").otherwise("Active"))
             .when(d > 180, "AtRisk")
             .when((orders >= 2) & (d <= 180), "Growing")
             .otherwise("Normal"))
    return users.select("customer_id", stage.alias("life_stage"))


def lifecycle_distribution(stages: DataFrame) -> DataFrame:
    """Users per stage in the fixed order; absent stages shown as 0."""
    st = F.col("life_stage")
    one = stages.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(st == s).alias(f"_s{i}") for i, s in enumerate(STAGES)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("stage_ord"), F.lit(s).alias("life_stage"),
                              F.col(f"_s{i}").alias("users")) for i, s in enumerate(STAGES)])
    long = one.select("_all", F.explode(rows).alias("r")).select("_all", "r.*")
    return long.select("stage_ord", "life_stage", "users", pct_rounded("users", "_all", 1).alias("pct"))


def purchase_funnel(users: DataFrame) -> DataFrame:
    """All users, ≥2, ≥3, ≥6, ≥10 orders, then high value by both
    of the reference's definitions (top ``floor(n/5)`` users, and users at
    or above the 80th revenue percentile).  Share of the first stage and
    step conversion, in percent to one place."""
    q80 = exact_quantiles(users, "total_revenue", {"q80": 0.8}).scalar().getField("q80")
    o = F.col("total_orders")
    # The flag is projected first: the quantile subquery is built on row
    # numbers, which Spark will not accept inside an aggregate's arguments.
    flagged = users.select("total_orders", (F.col("total_revenue").cast("double") >= q80).alias("_hv"))
    one = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(o >= 2).alias("o2"), F.count_if(o >= 3).alias("o3"),
                      F.count_if(o >= 6).alias("o6"), F.count_if(o >= 10).alias("o10"),
                      F.count_if("_hv").alias("q80"))
    stages = [(1, "first_purchase", F.col("n"), None), (2, "orders_2_plus", F.col("o2"), F.col("n")),
              (3, "orders_3_plus", F.col("o3"), F.col("o2")), (4, "orders_6_plus", F.col("o6"), F.col("o3")),
              (5, "orders_10_plus", F.col("o10"), F.col("o6")),
              (6, "high_value_top20pct", F.floor(F.col("n") / 5).cast("long"), F.col("o10")),
              (7, "high_value_q80", F.col("q80"), F.col("o10"))]
    rows = F.array(*[F.struct(F.lit(k).alias("stage_ord"), F.lit(name).alias("stage"), v.alias("users"),
                              (prev if prev is not None else v).alias("_prev"))
                     for k, name, v, prev in stages])
    long = one.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    return long.select("stage_ord", "stage", "users", pct_rounded("users", "n", 1).alias("pct_of_first"),
                       pct_rounded("users", "_prev", 1).alias("step_rate"))


def pareto_curve(users: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Users by revenue (descending, id ascending on ties): cumulative
    user % against cumulative revenue %.  Distributed running sum."""
    tot = users.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("total_revenue").alias("r")).alias("t")).scalar()
    ranked = global_rank(users.select("customer_id", "total_revenue"),
                         [F.col("total_revenue").desc(), F.col("customer_id").asc()],
                         rank_col="user_rank", running_sum="total_revenue", running_col="cum_revenue",
                         num_partitions=num_partitions)
    return ranked.select("customer_id", "user_rank",
                         (ratio("user_rank", tot.getField("n")) * 100).alias("user_pct"),
                         (ratio("cum_revenue", tot.getField("r")) * 100).alias("cum_revenue_pct"))


def top20_share(users: DataFrame) -> DataFrame:
    """Revenue share of the ``floor(n/5)`` biggest spenders.

    No ranking: with the smallest revenue among them, ``t``, their sum is all revenue above ``t`` and as many times
    ``t`` as there are places left, whichever of the customers at ``t`` take them."""
    def top_users(n):
        return F.floor(n / 5)
    smallest = exact_quantiles(users, "total_revenue", {"t": 0.8}, ranks={"t": lambda n: n - top_users(n)}).scalar().getField("t")
    revenue, as_double = F.col("total_revenue"), F.col("total_revenue").cast("double")
    one = users.select(revenue, as_double.alias("_x"), smallest.alias("_t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_revenue").alias("r"), F.count_if(F.col("_x") > F.col("_t")).alias("above"),
        F.sum(F.when(F.col("_x") > F.col("_t"), revenue)).alias("above_rev"), F.max(F.when(F.col("_x") == F.col("_t"), revenue)).alias("t"))
    k = top_users(F.col("n"))
    top = one.withColumn("top_rev", F.when(k > 0, F.coalesce("above_rev", F.lit(0)) + (k - F.col("above")) * F.col("t")).otherwise(0))
    return top.select(F.col("n").alias("users"), k.cast("long").alias("top_users"), F.col("top_rev").cast("double").alias("top_revenue"),
                      (ratio("top_rev", "r") * 100).alias("top_share_pct"))


def half_flags(clean: DataFrame, cut: Column) -> DataFrame:
    """Per customer, active up to and including ``cut`` (H1) and after it (H2)."""
    h1 = F.col("invoice_date") <= cut
    return clean.groupBy("customer_id").agg(F.bool_or(h1).alias("h1"), F.bool_or(~h1).alias("h2"))


def half_year_migration(clean: DataFrame, cut: Column) -> DataFrame:
    """Retained (both halves), new in H2, lost after H1."""
    f = half_flags(clean, cut)
    return f.agg(F.count_if("h1").alias("h1_users"), F.count_if("h2").alias("h2_users"),
                 F.count_if(F.col("h1") & F.col("h2")).alias("retained"),
                 F.count_if(~F.col("h1") & F.col("h2")).alias("new_in_h2"),
                 F.count_if(F.col("h1") & ~F.col("h2")).alias("lost_after_h1"))


def users_in(clean: DataFrame, cond: Column) -> DataFrame:
    return clean.where(cond).select("customer_id").distinct()


def retained_users(clean: DataFrame, cut: Column) -> DataFrame:
    """J7 as set algebra: H1 users ∩ H2 users."""
    return users_in(clean, F.col("invoice_date") <= cut).intersect(users_in(clean, F.col("invoice_date") > cut))


def new_users_h2(clean: DataFrame, cut: Column) -> DataFrame:
    """J7 as set algebra: H2 users − H1 users (left anti join)."""
    return users_in(clean, F.col("invoice_date") > cut).join(
        users_in(clean, F.col("invoice_date") <= cut), "customer_id", "left_anti")


def kpi_summary(clean: DataFrame, users: DataFrame, monthly: DataFrame, segments: DataFrame,
                as_of: Column | None = None, active_days: int = 30) -> DataFrame:
    """The dashboard's KPI row, each figure from one aggregate of its
    base table, combined as scalar subqueries."""
    ref = as_of if as_of is not None else users.agg(F.max("last_purchase")).scalar()
    tx = clean.agg(F.struct(F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias("lines")).alias("s")).scalar()
    mau = monthly.agg(ratio(F.sum("mau"), F.count(F.lit(1)))).scalar()
    seg = segments.agg(F.struct(
        F.coalesce(F.sum(F.when(F.col("rfm_segment") == "Champions", F.col("monetary"))), F.lit(0)).alias("champ"),
        F.count_if(F.col("rfm_segment").isin("AtRisk", "Lost")).alias("risk")).alias("s")).scalar()
    u = users.agg(F.count(F.lit(1)).alias("users"),
                  F.count_if(F.col("total_orders") > 1).alias("_rep"),
                  F.count_if(elapsed_days("last_purchase", ref) <= active_days).alias("active_30d"))
    return u.select("users", mau.alias("avg_mau"), tx.getField("rev").cast("double").alias("total_revenue"),
                    ratio(tx.getField("rev"), tx.getField("lines")).alias("avg_line_revenue"),
                    (ratio(seg.getField("champ"), tx.getField("rev")) * 100).alias("champion_revenue_pct"),
                    seg.getField("risk").alias("at_risk_users"),
                    (ratio("_rep", "users") * 100).alias("repeat_pct"), "active_30d")
