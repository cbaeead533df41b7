"""Named churn-workflow queries over the test tables.

The value-checked ones (table, encoding, rates, splits, metrics) score
customers with a deterministic rule — last-order age scaled to 0..1 — so
that DuckDB can recompute every metric.  Model queries live in
``model_queries`` and are rows-only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..operators import metrics, split
from ..sources.churn import CATEGORICAL, ID, churn_customers
from ..sources.tables import table
from . import churn, quality
from .materialize import materialized


def labelled(spark, sf_dir) -> DataFrame:
    """The labelled customer table, checkpointed once per input: metric
    queries pass over it several times (curve, totals, scalars)."""
    return materialized(spark, sf_dir, "churn", lambda: churn.with_label(churn_customers(spark, sf_dir)))


def rule_scored(spark, sf_dir) -> DataFrame:
    """(customer_id, label, score): score = recency / max recency."""
    df = labelled(spark, sf_dir)
    top = df.agg(F.max("recency_days")).scalar()
    return df.select(ID, "label", ratio("recency_days", top).alias("score"))


def _document_folder(spark) -> str:
    import uuid
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark, local_default=True)
    return f"{base.rstrip('/')}/documents/insights-{uuid.uuid4().hex}"


def _insights_by_path(spark, sf_dir) -> DataFrame:
    """The stored insight document read without a schema, its values taken out by path."""
    from ..sources import sinks
    path = _document_folder(spark)
    sinks.write_json(churn.business_insights(labelled(spark, sf_dir)), path)
    return churn.insight_rows_by_path(sinks.read_documents(spark, path))


def _insights_json(spark, sf_dir) -> DataFrame:
    """The insight document (rates, risks, gaps; no model drivers)
    written as JSON to the shared folder and read back with its schema."""
    from ..sources import sinks
    doc = churn.business_insights(labelled(spark, sf_dir))
    return churn.insight_rows(sinks.json_roundtrip(doc, _document_folder(spark)))


def _best(spark, sf_dir) -> DataFrame:
    s = rule_scored(spark, sf_dir)
    return metrics.best_threshold(s, "f1").unionByName(metrics.best_threshold(s, "recall"))


QUERIES = {
    "churn_customers": churn_customers,
    "churn_label": lambda s, d: labelled(s, d).select(ID, "churn", "label"),
    "churn_nulls": lambda s, d: quality.null_counts(labelled(s, d).drop("label")),
    "class_distribution": lambda s, d: quality.value_counts(labelled(s, d), "churn"),
    "label_quality_distribution": lambda s, d: quality.value_counts(table(s, d, "labels"), "quality"),
    "numeric_summary": lambda s, d: quality.numeric_summary(
        labelled(s, d), ["tenure_days", "avg_order_value", "total_spend"]),
    "impute_median": lambda s, d: churn.impute_median(labelled(s, d), "avg_days_between_orders").select(
        ID, "avg_days_between_orders"),
    "one_hot": lambda s, d: churn.one_hot(labelled(s, d).select(ID, *CATEGORICAL), CATEGORICAL),
    "churn_rate_by_segment": lambda s, d: churn.churn_rates(labelled(s, d)),
    "highest_risk_segment": lambda s, d: churn.highest_risk(churn.churn_rates(labelled(s, d))),
    "service_gap": lambda s, d: churn.service_gap(labelled(s, d)),
    "churn_rate_overall": lambda s, d: churn.overall_rate(labelled(s, d)),
    "insights_json_roundtrip": lambda s, d: _insights_json(s, d),
    "insights_by_path": lambda s, d: _insights_by_path(s, d),
    "business_insights": lambda s, d: churn.insight_rows(churn.business_insights(labelled(s, d))),
    "stratified_split": lambda s, d: split.stratified_split(labelled(s, d).select(ID, "label"), "label", ID),
    "stratified_folds": lambda s, d: split.stratified_folds(
        split.stratified_split(labelled(s, d).select(ID, "label"), "label", ID).where("split = 'train'")
        .drop("split"), "label", ID),
    "classification_metrics": lambda s, d: metrics.summary_metrics(rule_scored(s, d)),
    "confusion_matrix": lambda s, d: metrics.confusion_matrix(rule_scored(s, d)),
    "roc_auc": lambda s, d: metrics.roc_auc(rule_scored(s, d)),
    "average_precision": lambda s, d: metrics.average_precision(rule_scored(s, d)),
    "roc_curve": lambda s, d: metrics.roc_curve(rule_scored(s, d)),
    "pr_curve": lambda s, d: metrics.pr_curve(rule_scored(s, d)),
    "best_threshold": _best,
    "classification_report": lambda s, d: metrics.classification_report(rule_scored(s, d)),
}
