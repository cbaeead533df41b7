"""Profiling, data-quality rules and the cleaning step."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import pct_rounded, ratio, year_month
from ..operators.ranking import global_rank
from ..sources.retail import revenue

# Cleaning rules, applied in this order; a row failing several counts for
# the first only (fixed order of the reference).
RULES = [
    (1, "missing_customer"),
    (2, "cancelled"),
    (3, "invalid_quantity_or_price"),
]


def is_cancelled(invoice: Column | str = "invoice") -> Column:
    c = F.col(invoice) if isinstance(invoice, str) else invoice
    return F.coalesce(c.cast("string").startswith("C"), F.lit(False))


def is_invalid(quantity: str = "quantity", price: str = "price") -> Column:
    # pandas compares NaN as False: a null quantity or price does not fail.
    return F.coalesce(F.col(quantity) <= 0, F.lit(False)) | F.coalesce(F.col(price) <= 0, F.lit(False))


def drop_reason(df: DataFrame) -> Column:
    return (F.when(F.col("customer_id").isNull(), F.lit(RULES[0][1]))
            .when(is_cancelled(), F.lit(RULES[1][1]))
            .when(is_invalid(), F.lit(RULES[2][1])))


def clean(raw: DataFrame) -> DataFrame:
    """Drop guest lines, cancellations and non-positive quantity or
    price; add ``revenue``.  Pure filters + projection: fused into the scan
    stage, with the predicates pushed below the joins that produce ``raw``."""
    kept = raw.where(F.col("customer_id").isNotNull() & ~is_cancelled() & ~is_invalid())
    return kept.withColumn("customer_id", F.col("customer_id").cast("long")).withColumn("revenue", revenue())


def line_totals(raw: DataFrame) -> DataFrame:
    """Lines, quantity and revenue per (reason, customer, invoice, date) and per (reason, product), in one pass over the lines.

    ``reason`` is the rule that drops the lines, null for those that stay; ``is_order`` tells the two groups of rows apart.
    """
    marked = raw.select(F.col("customer_id").cast("long").alias("customer_id"), "invoice", "invoice_date", "stock_code", "quantity",
                        drop_reason(raw).alias("reason"), revenue().alias("revenue"))
    by = ["reason", "customer_id", "invoice", "invoice_date"]
    return marked.groupingSets([by, ["reason", "stock_code"]], *by, "stock_code").agg(
        (F.grouping("stock_code") == 1).alias("is_order"), F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"))


def clean_orders(totals: DataFrame) -> DataFrame:
    """The cleaned lines added up per customer, invoice and date."""
    return totals.where("is_order AND reason IS NULL").select("customer_id", "invoice", "invoice_date", "lines", "quantity", "revenue")


def with_date_parts(df: DataFrame, ts: str = "invoice_date") -> DataFrame:
    """year, month, ISO week, day of month, ``yyyy-MM``."""
    t = F.col(ts)
    return df.select("*", F.year(t).alias("year"), F.month(t).alias("month"), F.weekofyear(t).alias("week"),
                     F.dayofmonth(t).alias("day"), year_month(t).alias("year_month"))


def overview(raw: DataFrame) -> DataFrame:
    """Rows, columns, exact distinct customers/products/orders/countries, time range.

    One pass over the lines: grouping sets reduce them to invoices and to
    products; the distinct counts run on those smaller rows."""
    groups = raw.groupingSets([["invoice", "customer_id", "country"], ["stock_code"]], "invoice", "customer_id", "country", "stock_code").agg(
        F.grouping("invoice").alias("is_product"), F.count(F.lit(1)).alias("rows"),
        F.min("invoice_date").alias("first"), F.max("invoice_date").alias("last"))
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("is_product") == 0, F.col("rows"))), F.lit(0)).cast("long").alias("row_count"),
        F.lit(len(raw.columns)).cast("long").alias("column_count"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("invoice").alias("orders"),
        F.count_distinct("country").alias("countries"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.count_if((F.col("is_product") == 1) & F.col("stock_code").isNotNull()).alias("products"))


# What the values of a text column look like, narrowest first.
TEXT_KINDS = [
    ("integer", r"^\s*[+-]?[0-9]+\s*$"),
    ("number", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"),
    ("timestamp", r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$"),
]


def column_types(df: DataFrame) -> DataFrame:
    """Declared type of every column, in table order, and the type its values have.

    ``value_type`` is the narrowest of integer, number, timestamp and text that all non-null values of a text column
    fit (null without values): a column of a CSV file that was read as text shows what it holds.  Other columns show
    the kind of their declared type.  One aggregate over the table.
    """
    aggs, cells = [], []
    for i, f in enumerate(df.schema.fields):
        x = F.col(f"`{f.name}`")
        aggs.append(F.count(x).alias(f"_n{i}"))
        if isinstance(f.dataType, T.StringType):
            kind = F.lit("text")
            for j, (name, pattern) in reversed(list(enumerate(TEXT_KINDS))):
                aggs.append(F.count_if(x.rlike(pattern)).alias(f"_k{i}_{j}"))
                kind = F.when(F.col(f"_k{i}_{j}") == F.col(f"_n{i}"), name).otherwise(kind)
        else:
            kind = F.lit("integer" if isinstance(f.dataType, T.IntegralType) else "number" if isinstance(f.dataType, T.NumericType)
                         else "timestamp" if isinstance(f.dataType, T.DatetimeType | T.TimestampNTZType) else f.dataType.simpleString())
        cells.append(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
                              F.lit(f.dataType.simpleString()).alias("data_type"),
                              F.when(F.col(f"_n{i}") > 0, kind).alias("value_type"), F.col(f"_n{i}").alias("value_count")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent (2 places) of every column, one pass."""
    cols = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"),
                               F.col(f"_n{i}").alias("null_count")) for i, c in enumerate(cols)])
    long = one.select("_rows", F.explode(pairs).alias("p")).select("_rows", "p.*")
    return long.select("position", "column_name", "null_count",
                       pct_rounded("null_count", "_rows", 2).alias("null_pct"))


def rule_counts(raw: DataFrame) -> DataFrame:
    """Lines per quality rule on the raw table (rules checked independently)."""
    return raw.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("customer_id").isNull()).alias("missing_customer"),
        F.count_if(is_cancelled()).alias("cancelled"),
        F.count_if(F.coalesce(F.col("quantity") <= 0, F.lit(False))).alias("quantity_not_positive"),
        F.count_if(F.coalesce(F.col("price") <= 0, F.lit(False))).alias("price_not_positive"),
    ).select("*", pct_rounded("missing_customer", "row_count", 1).alias("missing_customer_pct"),
             pct_rounded("cancelled", "row_count", 2).alias("cancelled_pct"))


def cleaning_waterfall(raw: DataFrame) -> DataFrame:
    """rows in / removed / kept after each rule, in order, one scan."""
    reason = drop_reason(raw)
    return _waterfall(raw.agg(F.count(F.lit(1)).alias("raw_rows"),
                              *[F.count_if(reason == F.lit(name)).alias(f"_r{step}") for step, name in RULES]))


def waterfall_of_totals(totals: DataFrame) -> DataFrame:
    """F5 from ``line_totals``."""
    def lines(kept: Column) -> Column:
        return F.coalesce(F.sum(F.when(kept, F.col("lines"))), F.lit(0))
    return _waterfall(totals.where("is_order").agg(lines(F.lit(True)).alias("raw_rows"),
                                                   *[lines(F.col("reason") == name).alias(f"_r{step}") for step, name in RULES]))


def _waterfall(one: DataFrame) -> DataFrame:
    """(raw_rows, rows removed per rule) as one row per rule."""
    removed_before = F.lit(0)
    steps = []
    for step, name in RULES:
        rows_in = F.col("raw_rows") - removed_before
        steps.append(F.struct(F.lit(step).alias("step"), F.lit(name).alias("rule"), rows_in.alias("rows_in"),
                              F.col(f"_r{step}").alias("removed"),
                              (rows_in - F.col(f"_r{step}")).alias("rows_out")))
        removed_before = removed_before + F.col(f"_r{step}")
    long = one.select("raw_rows", F.explode(F.array(*steps)).alias("s")).select("raw_rows", "s.*")
    return long.select("step", "rule", "rows_in", "removed", "rows_out",
                       pct_rounded("rows_out", "raw_rows", 1).alias("kept_pct_of_raw"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe()`` with exact interpolated quartiles (not the
    approximate ones of ``DataFrame.summary``); text that is not a number
    becomes null first (``try_cast``).

    One pass over the table for all columns: values are counted per (column,
    value) map-side, and moments and order statistics are read from that
    table of distinct values and their running counts."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.expr(f"try_cast(`{c}` AS DOUBLE)").alias("x"))
                      for i, c in enumerate(columns)])
    values = (df.select(F.explode(cells).alias("c")).select("c.*").where("x IS NOT NULL")
              .groupBy("position", "x").agg(F.count(F.lit(1)).alias("n")))
    ranked = global_rank(values, ["position", "x"], running={"upto": "n"})
    totals = ranked.groupBy("position").agg(F.sum("n").alias("count"), F.min(F.col("upto") - F.col("n")).alias("before"),
                                            ratio(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean"),
                                            F.min("x").alias("min"), F.max("x").alias("max"))
    # At most one row per column from here on, joined to the distinct values.
    j = ranked.join(F.broadcast(totals.select("position", "count", "before", "mean")), "position").withColumn(
        "stop", F.col("upto") - F.col("before"))
    names = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

    def at(p: float, above: int):
        """Value of the ascending sequence at floor((count - 1) * p) + above, 0-based."""
        k = F.least(F.floor((F.col("count") - 1) * F.lit(p)) + above, F.col("count") - 1)
        return F.max(F.when((k >= F.col("stop") - F.col("n")) & (k < F.col("stop")), F.col("x")))

    stats = j.groupBy("position").agg(
        F.sum((F.col("x") - F.col("mean")) ** 2 * F.col("n")).alias("square"),
        *[at(p, side).alias(f"{name}_{side}") for name, p in names.items() for side in (0, 1)])
    quantiles = [(F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0"))
                  * ((F.col("count") - 1) * F.lit(p) - F.floor((F.col("count") - 1) * F.lit(p)))).alias(name)
                 for name, p in names.items()]
    std = F.sqrt(ratio("square", F.nullif(F.col("count") - 1, F.lit(0)))).alias("std")
    labels = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("p", "column_name"))
    labels = labels.select((F.col("p") + 1).alias("position"), "column_name")
    return labels.join(totals, "position", "left").join(stats, "position", "left").select(
        "position", "column_name", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "mean", std, "min", *quantiles, "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """P10: absolute and normalised counts of one column (nulls excluded,
    like pandas).  The share divides by a scalar subquery, not a window
    over the whole table."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "count", ratio("count", total).alias("share"))
