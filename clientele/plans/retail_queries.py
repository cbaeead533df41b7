"""Named retail queries over the test tables: ``(spark, sf_dir) -> DataFrame``.

Each builds the logical ``transactions`` table from the star schema with
only the joins it needs, then composes the plan modules.  Every
callable returns a lazy DataFrame; only the cohort matrix collects a number,
its last period, to name its columns.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffles_released
from ..sources import retail, sinks
from ..sources.tables import table
from . import breakdowns, clusters, cohort, monthly, quality, report, rfm, strategy, users
from .materialize import materialized as _materialized, once

# Parameter of the half-year split (F18) for the test data's time span
# (1995-01 .. 2001-08); the reference splits its own year at 2010-06-01.
HALF_YEAR_CUT = "1998-06-01 00:00:00"

_BASE = ["invoice", "quantity", "invoice_date", "price", "customer_id"]


def raw(spark, sf_dir, cols=None) -> DataFrame:
    return retail.from_tpch(spark, sf_dir, cols)


def clean(spark, sf_dir, extra=()) -> DataFrame:
    return quality.clean(retail.from_tpch(spark, sf_dir, _BASE + [c for c in extra if c not in _BASE], valid_only=True))


def line_totals(spark, sf_dir) -> DataFrame:
    """The lines added up per order and per product, stored as Parquet for queries that combine many figures of the lines."""
    def build() -> DataFrame:
        path = f"{ensure_checkpoint_dir(spark, local_default=True).rstrip('/')}/line-totals-{uuid.uuid4().hex}"
        with shuffles_released(spark):
            quality.line_totals(raw(spark, sf_dir, [*_BASE, "stock_code"])).write.parquet(path)
        return spark.read.parquet(path)
    return once(spark, sf_dir, "line totals", build)


def user_table(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """User metrics from the cleaned lines, or from ``lines``: the same added up per order."""
    return _materialized(spark, sf_dir, "users", lambda: users.user_metrics(clean(spark, sf_dir) if lines is None else lines))


def segments(spark, sf_dir) -> DataFrame:
    return _materialized(spark, sf_dir, "segments", lambda: rfm.rfm_segments(
        rfm.rfm_scores(rfm.rfm_table(user_table(spark, sf_dir)))))


def monthly_table(spark, sf_dir) -> DataFrame:
    return monthly.monthly_user_stats(clean(spark, sf_dir), user_table(spark, sf_dir))


def event_value(spark, sf_dir, event_type: str | None = None) -> DataFrame:
    """A23 on the event table: value by weekday and hour, of one event type if named."""
    events = table(spark, sf_dir, "events")
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    return breakdowns.weekday_hour(events, "ts", "value")


def stored_clusters(spark, sf_dir) -> DataFrame:
    """The cluster of every customer, fitted once."""
    return _materialized(spark, sf_dir, "clusters", lambda: clusters.rfm_clusters(rfm.rfm_table(user_table(spark, sf_dir))))


def stored_months(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """The month table, for queries that combine it with others (it has one row per month)."""
    return _materialized(spark, sf_dir, "months", lambda: monthly_table(spark, sf_dir) if lines is None else monthly.monthly_user_stats(
        lines, user_table(spark, sf_dir, lines)))


def stored_retention(spark, sf_dir, lines: DataFrame | None = None) -> DataFrame:
    """The (cohort, period) table."""
    return _materialized(spark, sf_dir, "retention", lambda: cohort.cohort_retention(clean(spark, sf_dir) if lines is None else lines))


def _cut():
    return F.lit(HALF_YEAR_CUT).cast("timestamp_ntz")


def _sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write user metrics as Parquet to the shared checkpoint folder and
    read them back (the reference's CSV hand-off between scripts)."""
    base = ensure_checkpoint_dir(spark, local_default=True)
    path = f"{base.rstrip('/')}/sinks/user_metrics-{uuid.uuid4().hex}"
    user_table(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning as an incremental Structured Streaming job over two file
    drops of the raw table; the result must equal ``clean_transactions``."""
    from ..streaming.incremental import run_once
    base = ensure_checkpoint_dir(spark, local_default=True)
    return run_once(spark, raw(spark, sf_dir), f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}")


def _cohort_matrix(spark, sf_dir) -> DataFrame:
    """The matrix over all periods of the data; its lines are read once, into the stored (cohort, period) table."""
    retention = stored_retention(spark, sf_dir)
    return cohort.cohort_matrix(retention, cohort.last_period(retention))


def _cohort_unpivot(spark, sf_dir) -> DataFrame:
    """The wide cohort matrix written as CSV and read back into long form."""
    base = ensure_checkpoint_dir(spark, local_default=True)
    path = f"{base.rstrip('/')}/sinks/cohort-matrix-{uuid.uuid4().hex}"
    sinks.write_csv(_cohort_matrix(spark, sf_dir), path)
    return sinks.read_wide(spark, path, "cohort_month", "period_index", "retention_rate")


def _csv_roundtrip(spark, sf_dir) -> DataFrame:
    """The transactions as a user's CSV export (other column order and names, float ids, own date
    format), read back by ``retail.read_csv``."""
    base = ensure_checkpoint_dir(spark, local_default=True)
    path = f"{base.rstrip('/')}/sinks/transactions-{uuid.uuid4().hex}"
    date_format = "dd/MM/yyyy HH:mm:ss"
    sinks.write_csv(raw(spark, sf_dir).select(
        F.col("stock_code").alias("StockCode"), F.col("invoice").alias("Invoice"), F.col("country").alias("Country"),
        F.col("quantity").cast("double").alias("Quantity"), F.date_format("invoice_date", date_format).alias("InvoiceDate"),
        F.col("price").alias("Price"), F.concat(F.col("customer_id").cast("string"), F.lit(".0")).alias("Customer ID"),
        F.col("description").alias("Description")), path)
    return retail.read_csv(spark, path, date_format)


QUERIES = {
    # sources, profiling, cleaning
    "scan_transactions": lambda s, d: raw(s, d),
    "csv_roundtrip": _csv_roundtrip,
    "clean_transactions": lambda s, d: quality.clean(retail.from_tpch(s, d, valid_only=True)),
    "date_parts": lambda s, d: quality.with_date_parts(clean(s, d)).select(
        "invoice", "invoice_date", "year", "month", "week", "day", "year_month"),
    "dq_overview": lambda s, d: quality.overview(raw(s, d)),
    "dq_schema": lambda s, d: quality.column_types(raw(s, d)),
    "dq_nulls": lambda s, d: quality.null_counts(raw(s, d)),
    "dq_rule_counts": lambda s, d: quality.rule_counts(raw(s, d, _BASE)),
    "cleaning_waterfall": lambda s, d: quality.cleaning_waterfall(raw(s, d, _BASE)),
    "sink_roundtrip": _sink_roundtrip,
    "stream_clean_transactions": _stream_clean,
    # users
    "order_revenue": lambda s, d: users.order_totals(clean(s, d)).select("customer_id", "invoice", "revenue"),
    "user_metrics": user_table,
    "spend_bands": lambda s, d: users.spend_bands(user_table(s, d)),
    "frequency_bands": lambda s, d: users.frequency_bands(user_table(s, d)),
    "interval_bands": lambda s, d: users.interval_bands(user_table(s, d)),
    "purchase_interval": lambda s, d: users.purchase_interval(user_table(s, d)),
    "spend_summary": lambda s, d: users.spend_summary(user_table(s, d)),
    "repeat_purchase": lambda s, d: users.repeat_purchase(user_table(s, d)),
    "report_tiers": lambda s, d: users.report_tiers(user_table(s, d)),
    "ltv_histogram": lambda s, d: users.ltv_histogram(user_table(s, d)),
    # months
    "monthly_user_stats": monthly_table,
    "monthly_kpi_summary": lambda s, d: monthly.monthly_kpi_summary(stored_months(s, d)),
    "best_worst_month": lambda s, d: monthly.best_worst_month(stored_months(s, d)),
    "monthly_line_averages": lambda s, d: monthly.monthly_line_averages(clean(s, d)),
    "monthly_repeat_rate": lambda s, d: monthly.monthly_repeat_rate(clean(s, d)),
    "revenue_per_new_user": lambda s, d: monthly.revenue_per_new_user(stored_months(s, d)),
    "revenue_moving_avg": lambda s, d: monthly.revenue_moving_avg(stored_months(s, d)),
    "revenue_mom": lambda s, d: monthly.revenue_mom(stored_months(s, d)),
    # RFM
    "rfm_scores": lambda s, d: rfm.rfm_scores(rfm.rfm_table(user_table(s, d))),
    "rfm_segments": lambda s, d: segments(s, d).select("customer_id", "recency", "frequency", "monetary",
                                                       "r_score", "f_score", "m_score", "rfm_score", "rfm_segment"),
    "segment_profile": lambda s, d: rfm.segment_profile(segments(s, d)),
    "label_lookup": lambda s, d: rfm.label_lookup(segments(s, d)),
    "rfm_summary": lambda s, d: rfm.rfm_summary(rfm.rfm_table(user_table(s, d))),
    "rfm_score_distribution": lambda s, d: rfm.score_distribution(rfm.rfm_scores(rfm.rfm_table(user_table(s, d)))),
    "risk_vs_safe_profile": lambda s, d: rfm.risk_vs_safe_profile(segments(s, d)),
    "recoverable_revenue": lambda s, d: rfm.recoverable_revenue(segments(s, d)),
    "rfm_sample_points": lambda s, d: rfm.sample_points(rfm.rfm_table(user_table(s, d))),
    "rfm_standardized": lambda s, d: rfm.standardized(rfm.rfm_table(user_table(s, d))),
    "rfm_clusters": lambda s, d: stored_clusters(s, d),
    "cluster_profile": lambda s, d: _cluster_profile(s, d),
    "kmeans_elbow": lambda s, d: clusters.elbow(rfm.rfm_table(user_table(s, d))),
    # lifecycle, funnel, concentration
    "lifecycle_stage": lambda s, d: strategy.lifecycle_stage(user_table(s, d)),
    "lifecycle_distribution": lambda s, d: strategy.lifecycle_distribution(strategy.lifecycle_stage(user_table(s, d))),
    "purchase_funnel": lambda s, d: strategy.purchase_funnel(user_table(s, d)),
    "pareto_curve": lambda s, d: strategy.pareto_curve(user_table(s, d)),
    "top20_share": lambda s, d: strategy.top20_share(user_table(s, d)),
    "half_year_migration": lambda s, d: strategy.half_year_migration(clean(s, d), _cut()),
    "users_retained_intersect": lambda s, d: strategy.retained_users(clean(s, d), _cut()),
    "users_new_except": lambda s, d: strategy.new_users_h2(clean(s, d), _cut()),
    "kpi_summary": lambda s, d: _kpi(s, d),
    "report_metrics": lambda s, d: _report(s, d),
    "report_clusters": lambda s, d: report.cluster_figures(QUERIES["cluster_profile"](s, d)),
    # breakdowns
    "country_users_top10": lambda s, d: breakdowns.country_users_top(clean(s, d, ["country"]),
                                                                      users=user_table(s, d)),
    "country_matrix": lambda s, d: breakdowns.country_matrix(clean(s, d, ["country"])),
    "top_products": lambda s, d: breakdowns.top_products(clean(s, d, ["description"])),
    "weekday_hour_revenue": lambda s, d: breakdowns.weekday_hour(clean(s, d), "invoice_date", "revenue"),
    "weekday_hour_event_value": lambda s, d: event_value(s, d, event_type="purchase"),
    # cohorts
    "user_cohort": lambda s, d: cohort.user_cohort(clean(s, d)).select("customer_id", "cohort_month"),
    "cohort_retention": lambda s, d: cohort.cohort_retention(clean(s, d)),
    "cohort_matrix": _cohort_matrix,
    "cohort_unpivot": _cohort_unpivot,
    "retention_insight": lambda s, d: cohort.retention_insight(cohort.cohort_retention(clean(s, d))),
    "retention_curve": lambda s, d: cohort.retention_curve(cohort.cohort_retention(clean(s, d))),
    "retention_zero_filled": lambda s, d: cohort.retention_zero_filled(cohort.cohort_retention(clean(s, d))),
}


def _cluster_profile(spark, sf_dir) -> DataFrame:
    r = rfm.rfm_table(user_table(spark, sf_dir))
    return clusters.cluster_profile(r, stored_clusters(spark, sf_dir))


def _report(spark, sf_dir) -> DataFrame:
    """All figures of the lines come from one pass over them."""
    totals = line_totals(spark, sf_dir)
    lines = quality.clean_orders(totals)
    u = user_table(spark, sf_dir, lines)
    return report.report_metrics(totals, retail.customer_countries(spark, sf_dir), u, stored_months(spark, sf_dir, lines),
                                 segments(spark, sf_dir), stored_retention(spark, sf_dir, lines))


def _kpi(spark, sf_dir) -> DataFrame:
    c = clean(spark, sf_dir)
    u = user_table(spark, sf_dir)
    return strategy.kpi_summary(c, u, stored_months(spark, sf_dir), segments(spark, sf_dir))
