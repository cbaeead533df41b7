"""Recency–frequency–monetary scoring and segments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, elapsed_days, pct_rounded, quartile_by_rank, ratio, seeded_key, translate
from ..operators.ranking import exact_quantiles, global_rank

# Segment names in the reference's rule order / display order.
SEGMENTS = ["Champions", "Loyal", "Potential", "AtRisk", "Lost", "New", "Average"]
AT_RISK = ["AtRisk", "Lost"]

# Display labels for reports (our wording).
SEGMENT_LABELS = {
    "Champions": "High-value champions",
    "Loyal": "Loyal customers",
    "Potential": "Potential loyalists",
    "AtRisk": "At risk",
    "Lost": "Lost",
    "New": "New customers",
    "Average": "Average customers",
}


def rfm_table(users: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Recency (whole days from last purchase to ``as_of``), frequency
    (orders), monetary (revenue).  ``as_of`` defaults to the latest purchase
    in the data, attached as a scalar subquery."""
    ref = as_of if as_of is not None else users.agg(F.max("last_purchase")).scalar()
    return users.select("customer_id", "last_purchase",
                        elapsed_days("last_purchase", ref).alias("recency"),
                        F.col("total_orders").alias("frequency"),
                        F.col("total_revenue").alias("monetary"))


def rfm_scores(rfm: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """R by value quartiles (right-closed, reversed 4..1); F and M by
    quartiles of ``rank(method='first')`` with ties broken by customer id.

    The two rank passes are range-partitioned global row numbers (no
    single-task window); the R cut points are exact quantiles.
    """
    edges = exact_quantiles(rfm, "recency", {"q1": 0.25, "q2": 0.5, "q3": 0.75},
                            num_partitions=num_partitions).scalar()
    n = rfm.agg(F.count(F.lit(1))).scalar()
    ranked = global_rank(rfm, ["frequency", "customer_id"], rank_col="_rn_f", num_partitions=num_partitions)
    ranked = global_rank(ranked, ["monetary", "customer_id"], rank_col="_rn_m", num_partitions=num_partitions)
    rec = F.col("recency")
    r = (F.when(rec <= edges.getField("q1"), 4).when(rec <= edges.getField("q2"), 3)
         .when(rec <= edges.getField("q3"), 2).otherwise(1))
    out = ranked.select(
        "customer_id", "last_purchase", "recency", "frequency", "monetary",
        r.cast("int").alias("r_score"),
        quartile_by_rank("_rn_f", n).alias("f_score"),
        quartile_by_rank("_rn_m", n).alias("m_score"))
    return out.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def segment_rule(r: Column, f: Column, m: Column) -> Column:
    """First matching rule wins."""
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
            .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal")
            .when((r >= 4) & (f <= 2), "Potential")
            .when((r <= 2) & (f >= 3) & (m >= 3), "AtRisk")
            .when((r <= 2) & (f <= 2), "Lost")
            .when((r >= 3) & (f <= 2) & (m <= 2), "New")
            .otherwise("Average"))


def segment_order(seg: Column) -> Column:
    return translate(seg, {s: str(i + 1) for i, s in enumerate(SEGMENTS)}).cast("int")


def rfm_segments(scores: DataFrame) -> DataFrame:
    return scores.withColumn("rfm_segment", segment_rule(F.col("r_score"), F.col("f_score"), F.col("m_score")))


def segment_profile(segments: DataFrame) -> DataFrame:
    """Users, share, mean R/F/M, revenue and revenue share per segment."""
    g = segments.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("users"),
        ratio(F.sum("recency"), F.count(F.lit(1))).alias("avg_recency"),
        ratio(F.sum("frequency"), F.count(F.lit(1))).alias("avg_frequency"),
        ratio(F.sum("monetary"), F.count(F.lit(1))).alias("avg_monetary"),
        F.sum("monetary").alias("revenue"))
    # Totals over the grouped table (one row per segment), not another pass over users.
    every = Window.partitionBy()
    return g.select(segment_order(F.col("rfm_segment")).alias("segment_ord"), "rfm_segment", "users",
                    pct_rounded("users", F.sum("users").over(every), 1).alias("user_pct"),
                    "avg_recency", "avg_frequency", "avg_monetary", "revenue",
                    (ratio("revenue", F.sum("revenue").over(every)) * 100).alias("revenue_pct"))


def label_lookup(segments: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """display label per segment, unknown names passed through."""
    return segments.select("customer_id", "rfm_segment",
                           translate(F.col("rfm_segment"), labels or SEGMENT_LABELS).alias("segment_label"))


def rfm_summary(rfm: DataFrame) -> DataFrame:
    """Mean and median of R, F and M."""
    meds = {c: exact_quantiles(rfm, c, {"m": 0.5}).scalar().getField("m") for c in ("recency", "frequency", "monetary")}
    return rfm.agg(*[ratio(F.sum(c), F.count(F.lit(1))).alias(f"mean_{c}") for c in ("recency", "frequency", "monetary")]
                   ).select("*", *[meds[c].alias(f"median_{c}") for c in ("recency", "frequency", "monetary")])


def score_distribution(scores: DataFrame) -> DataFrame:
    """Users per score value for R, F and M."""
    long = scores.select(F.explode(F.array(
        F.struct(F.lit("R").alias("score_name"), F.col("r_score").alias("score")),
        F.struct(F.lit("F").alias("score_name"), F.col("f_score").alias("score")),
        F.struct(F.lit("M").alias("score_name"), F.col("m_score").alias("score")))).alias("s")).select("s.*")
    return long.groupBy("score_name", "score").agg(F.count(F.lit(1)).alias("users"))


def risk_vs_safe_profile(segments: DataFrame) -> DataFrame:
    """Mean R/F/M of AtRisk+Lost users against all others."""
    grp = F.when(F.col("rfm_segment").isin(AT_RISK), "at_risk").otherwise("other")
    return segments.groupBy(grp.alias("segment_group")).agg(
        F.count(F.lit(1)).alias("users"),
        ratio(F.sum("recency"), F.count(F.lit(1))).alias("avg_recency"),
        ratio(F.sum("frequency"), F.count(F.lit(1))).alias("avg_frequency"),
        ratio(F.sum("monetary"), F.count(F.lit(1))).alias("avg_monetary"))


def recoverable_revenue(segments: DataFrame) -> DataFrame:
    """Users and revenue of AtRisk, and of AtRisk + Lost."""
    seg = F.col("rfm_segment")
    return segments.agg(
        F.count_if(seg == "AtRisk").alias("at_risk_users"),
        F.coalesce(F.sum(F.when(seg == "AtRisk", F.col("monetary"))), F.lit(0)).cast("double").alias("at_risk_revenue"),
        F.count_if(seg.isin(AT_RISK)).alias("at_risk_or_lost_users"),
        F.coalesce(F.sum(F.when(seg.isin(AT_RISK), F.col("monetary"))), F.lit(0)).cast("double")
        .alias("at_risk_or_lost_revenue"))


def sample_points(rfm: DataFrame, n: int = 1200, seed: int = 42) -> DataFrame:
    """Reproducible sample of at most ``n`` users (hash order — the
    same rows in every engine) with a clipped bubble size.  The limit is the
    feature: a top-n by hash, executed as a bounded per-task heap."""
    return (rfm.select("customer_id", "recency", "frequency", "monetary",
                       clip(F.col("frequency") * 2.5, 4, 35).cast("double").alias("bubble_size"),
                       seeded_key("customer_id", seed).alias("_k"))
            .orderBy("_k").limit(n).drop("_k"))


def standardized(rfm: DataFrame) -> DataFrame:
    """M4: z-scores with the population standard deviation (sklearn's
    ``StandardScaler``; MLlib's scaler would use the sample one)."""
    cols = ("recency", "frequency", "monetary")
    st = rfm.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(f"a_{c}") for c in cols],
                          *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).alias("s")).scalar()
    return rfm.select("customer_id", *[
        ((F.col(c).cast("double") - st.getField(f"a_{c}")) / F.nullif(st.getField(f"s_{c}"), F.lit(0.0))).alias(f"z_{c}")
        for c in cols])
