"""Churn table analytics: encoding, imputation, segment churn rates and the
business-insight document (F9–F14, P5, P9, P10, A35–A38, M29)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import format_rate, ratio
from ..operators.ranking import exact_quantiles
from ..sources.sinks import at_path
from ..sources.churn import CATEGORICAL, ID, NUMERIC, TARGET

# Dimensions of the reference's segment churn rates, mapped onto the
# churn table: contract type → market segment, payment method → region,
# internet service → dominant order priority.
RATE_DIMENSIONS = ["segment", "region", "priority"]
# The reference compares "No" against "Yes" for two services.
GAP_COLUMNS = ["negative_balance", "high_priority"]


def with_label(df: DataFrame, target: str = TARGET) -> DataFrame:
    """``Yes``/``No`` → 1/0 (anything else → null)."""
    t = F.col(target)
    return df.withColumn("label", F.when(t == "Yes", 1).when(t == "No", 0).cast("int"))


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """text → number (bad → null) and nulls filled with the exact
    median of the column over the whole table (the reference imputes before
    the split)."""
    x = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    base = df.withColumn(column, x)
    med = exact_quantiles(base, column, {"m": 0.5}).scalar().getField("m")
    return base.withColumn(column, F.coalesce(F.col(column), med))


# Levels of all categorical columns together: each becomes a column, so a longer list is an id, not a category.
MAX_LEVELS = 10_000


def categorical_levels(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct levels per categorical column, from one distinct over
    (column, level) rows; only the level names reach the driver, at most
    ``max_levels`` of them (more raise a ValueError)."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("level"))
                      for i, c in enumerate(columns)])
    found = df.select(F.explode(cells).alias("c")).select("c.*").where("level IS NOT NULL").distinct().limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"more than {max_levels} levels in {', '.join(columns)}: not categories")
    return {c: sorted(r["level"] for r in found if r["i"] == i) for i, c in enumerate(columns)}


def one_hot(df: DataFrame, columns: Sequence[str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """``pd.get_dummies(drop_first=False)``: one 0/1 column
    ``<col>_<level>`` per level (all levels kept), originals dropped."""
    levels = levels or categorical_levels(df, columns)
    dummies = [F.when(F.col(c) == lv, 1).otherwise(0).alias(f"{c}_{lv}") for c in columns for lv in levels[c]]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, *dummies)


def churn_rates(labelled: DataFrame, dims: Sequence[str] = RATE_DIMENSIONS) -> DataFrame:
    """Churn rate per value of each dimension, one GROUPING SETS pass."""
    g = labelled.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("customers"), ratio(F.sum("label"), F.count(F.lit(1))).alias("churn_rate"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    dim = None
    val = None
    for d in dims:
        cond = F.col(f"_g_{d}") == 0
        dim = F.when(cond, F.lit(d)) if dim is None else dim.when(cond, F.lit(d))
        val = F.when(cond, F.col(d)) if val is None else val.when(cond, F.col(d))
    out = g.select(dim.alias("dimension"), val.alias("segment_value"), "customers", "churn_rate")
    # Highest rate first within a dimension; a dimension has as many rows as levels.
    order = Window.partitionBy("dimension").orderBy(F.col("churn_rate").desc_nulls_last(), "segment_value")
    return out.select(F.row_number().over(order).alias("rank"), "*")


def highest_risk(rates: DataFrame) -> DataFrame:
    """Per dimension, the value with the highest churn rate (first in
    name order on a tie, as a stable sort would give)."""
    return rates.groupBy("dimension").agg(
        F.min_by("segment_value", F.struct(-F.col("churn_rate"), F.col("segment_value"))).alias("segment"),
        F.max("churn_rate").alias("churn_rate"))


def service_gap(labelled: DataFrame, columns: Sequence[str] = GAP_COLUMNS) -> DataFrame:
    """Churn rate where the flag is ``No`` against where it is ``Yes``."""
    parts = []
    for c in columns:
        parts.append(labelled.agg(
            F.lit(c).alias("feature"),
            ratio(F.sum(F.when(F.col(c) == "No", F.col("label"))), F.count_if(F.col(c) == "No")).alias("rate_no"),
            ratio(F.sum(F.when(F.col(c) == "Yes", F.col("label"))), F.count_if(F.col(c) == "Yes")).alias("rate_yes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall_rate(labelled: DataFrame) -> DataFrame:
    """Customers, churners and overall churn rate."""
    return labelled.agg(F.count(F.lit(1)).alias("customers"), F.sum("label").cast("long").alias("churners"),
                        ratio(F.sum("label"), F.count(F.lit(1))).alias("churn_rate"))


def business_insights(labelled: DataFrame, importances: DataFrame | None = None, top: int = 10) -> DataFrame:
    """The insight document as one row of nested structs."""
    rates = churn_rates(labelled)
    risk = highest_risk(rates)
    doc = overall_rate(labelled).select(F.col("churn_rate").alias("overall_churn_rate"))
    risk_s = risk.agg(F.map_from_entries(F.collect_list(F.struct(
        "dimension", F.struct(F.col("segment"), F.col("churn_rate"),
                              format_rate("churn_rate").alias("churn_rate_text")))))).scalar()
    gaps_s = service_gap(labelled).agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("rate_no", "rate_yes"))))).scalar()
    cols = [F.col("overall_churn_rate"), risk_s.alias("highest_risk"), gaps_s.alias("service_gaps")]
    if importances is not None:
        drivers = (importances.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)
                   .agg(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("o"), "feature", "importance")))
                        .alias("d")).select(F.transform("d", lambda x: F.struct(
                            x["feature"].alias("feature"), x["importance"].alias("importance")))).scalar())
        cols.append(drivers.alias("top_model_drivers"))
    return doc.select(*cols)


def insight_rows(doc: DataFrame) -> DataFrame:
    """The insight document without model drivers as rows (section, name, item, value, text)."""
    def row(section, name, item, value=None, text=None):
        return F.struct(F.lit(section).alias("section"), name.alias("name"), F.lit(item).alias("item"),
                        (F.lit(None) if value is None else value).cast("double").alias("value"),
                        (F.lit(None) if text is None else text).cast("string").alias("text"))
    risks = F.transform(F.map_entries("highest_risk"), lambda e: F.array(
        row("highest_risk", e["key"], "segment", text=e["value"]["segment"]),
        row("highest_risk", e["key"], "churn_rate", e["value"]["churn_rate"], e["value"]["churn_rate_text"])))
    gaps = F.transform(F.map_entries("service_gaps"), lambda e: F.array(
        row("service_gaps", e["key"], "rate_no", e["value"]["rate_no"]),
        row("service_gaps", e["key"], "rate_yes", e["value"]["rate_yes"])))
    overall = F.array(row("overall", F.lit("all"), "churn_rate", F.col("overall_churn_rate")))
    return doc.select(F.explode(F.concat(overall, F.flatten(risks), F.flatten(gaps))).alias("r")).select("r.*")


def insight_rows_by_path(docs: DataFrame) -> DataFrame:
    """The rows of ``insight_rows`` from documents read without a schema (``sinks.read_documents``)."""
    def rows(section, path, items):
        found = docs.select(F.explode(at_path(path, "map<string,variant>")).alias("name", "doc"))
        cells = [F.struct(F.lit(item).alias("item"), (at_path(f"$.{item}", "double") if number else F.lit(None).cast("double")).alias("value"),
                          (at_path(f"$.{text}") if text else F.lit(None).cast("string")).alias("text")) for item, number, text in items]
        return found.select(F.lit(section).alias("section"), "name", F.explode(F.array(*cells)).alias("c")).select("section", "name", "c.*")
    overall = docs.select(F.lit("overall").alias("section"), F.lit("all").alias("name"), F.lit("churn_rate").alias("item"),
                          at_path("$.overall_churn_rate", "double").alias("value"), F.lit(None).cast("string").alias("text"))
    return overall.union(rows("highest_risk", "$.highest_risk", [("segment", False, "segment"), ("churn_rate", True, "churn_rate_text")])).union(
        rows("service_gaps", "$.service_gaps", [("rate_no", True, None), ("rate_yes", True, None)]))


def impute_from(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Nulls of ``column`` filled with the median over ``train`` only, so that test rows do not shape it."""
    x = F.expr(f"try_cast(`{column}` AS DOUBLE)")
    med = exact_quantiles(train.select(x.alias("_x")), "_x", {"m": 0.5}).scalar().getField("m")
    return df.withColumn(column, F.coalesce(x, med))


def model_columns(levels: dict[str, list[str]]) -> list[str]:
    """Feature names after encoding, in table order (numerics, then dummies)."""
    return list(NUMERIC) + [f"{c}_{lv}" for c in CATEGORICAL for lv in levels[c]]


__all__ = ["CATEGORICAL", "ID", "NUMERIC", "TARGET"]
