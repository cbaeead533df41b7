import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clientele.plans import churn, cohort, quality, rfm, strategy, users
from clientele.sources.retail import TRANSACTION_SCHEMA


def ts(s):
    return dt.datetime.fromisoformat(s)


def tx(spark, rows):
    return spark.createDataFrame(rows, TRANSACTION_SCHEMA)


def test_cleaning_waterfall_counts_first_failing_rule(spark):
    rows = [
        ("1", "a", "x", 2, ts("2010-01-01 10:00:00"), Decimal("1.00"), 1, "UK"),
        ("2", "a", "x", 1, ts("2010-01-02 10:00:00"), Decimal("2.00"), None, "UK"),   # guest
        ("C3", "a", "x", 1, ts("2010-01-03 10:00:00"), Decimal("2.00"), 1, "UK"),     # cancelled
        ("C4", "a", "x", 0, ts("2010-01-03 10:00:00"), Decimal("0.00"), 1, "UK"),     # cancelled and invalid
        ("5", "a", "x", 0, ts("2010-01-04 10:00:00"), Decimal("2.00"), 1, "UK"),      # quantity 0
        ("6", "a", "x", -1, ts("2010-01-04 10:00:00"), Decimal("2.00"), 1, "UK"),     # quantity -1
        ("7", "a", "x", 1, ts("2010-01-04 10:00:00"), Decimal("0.00"), 1, "UK"),      # price 0
        ("8", "a", "x", None, ts("2010-01-04 10:00:00"), Decimal("3.00"), 2, "UK"),   # null quantity stays
    ]
    raw = tx(spark, rows)
    wf = {r.rule: (r.rows_in, r.removed, r.rows_out) for r in quality.cleaning_waterfall(raw).collect()}
    assert wf["missing_customer"] == (8, 1, 7)
    assert wf["cancelled"] == (7, 2, 5)
    assert wf["invalid_quantity_or_price"] == (5, 3, 2)
    assert quality.clean(raw).count() == 2
    rc = quality.rule_counts(raw).first()
    assert (rc.missing_customer, rc.cancelled, rc.quantity_not_positive, rc.price_not_positive) == (1, 2, 3, 2)


def test_user_metrics_and_intervals(spark):
    rows = [
        ("1", "a", "x", 2, ts("2010-01-01 23:00:00"), Decimal("1.50"), 1, "UK"),
        ("1", "b", "y", 1, ts("2010-01-01 23:00:00"), Decimal("2.00"), 1, "UK"),
        ("2", "a", "x", 1, ts("2010-01-02 22:00:00"), Decimal("10.00"), 1, "UK"),
        ("3", "a", "x", 1, ts("2010-01-05 10:00:00"), Decimal("100.00"), 2, "FR"),
    ]
    u = {r.customer_id: r for r in users.user_metrics(quality.clean(tx(spark, rows))).collect()}
    assert u[1].total_orders == 2 and u[1].total_quantity == 4
    assert u[1].total_revenue == Decimal("15.00") and u[1].avg_order_value == 7.5
    assert u[1].life_days == 0  # 23 hours apart: no whole day
    bands = {r.band: r.users for r in users.spend_bands(users.user_metrics(quality.clean(tx(spark, rows)))).collect()}
    assert bands["<100"] == 2 and bands["100-500"] == 0 and len(bands) == 7  # exactly 100 is in "<100"


def test_segment_rules_cover_all_score_triples(spark):
    triples = [(r, f, m) for r in range(1, 5) for f in range(1, 5) for m in range(1, 5)]
    df = spark.createDataFrame(triples, "r int, f int, m int")
    got = {(x.r, x.f, x.m): x.s for x in df.select("r", "f", "m", rfm.segment_rule(
        F.col("r"), F.col("f"), F.col("m")).alias("s")).collect()}

    # (recency score, frequency score): segment for monetary scores 1 to 4.
    expected = {
        (1, 1): "Lost Lost Lost Lost",
        (1, 2): "Lost Lost Lost Lost",
        (1, 3): "Average Average AtRisk AtRisk",
        (1, 4): "Average Average AtRisk AtRisk",
        (2, 1): "Lost Lost Lost Lost",
        (2, 2): "Lost Lost Lost Lost",
        (2, 3): "Average Average AtRisk AtRisk",
        (2, 4): "Average Average AtRisk AtRisk",
        (3, 1): "New New Average Average",
        (3, 2): "New New Average Average",
        (3, 3): "Average Average Loyal Loyal",
        (3, 4): "Average Average Loyal Loyal",
        (4, 1): "Potential Potential Potential Potential",
        (4, 2): "Potential Potential Potential Potential",
        (4, 3): "Average Average Loyal Loyal",
        (4, 4): "Average Average Loyal Champions",
    }
    assert all(got[r, f, m] == expected[r, f].split()[m - 1] for r, f, m in triples)


def test_rfm_properties_on_test_data(spark):
    from clientele.plans import retail_queries as rq
    seg = rq.segments(spark, "/root/testdata/sf0.001")
    n = seg.count()
    prof = rfm.segment_profile(seg).collect()
    assert sum(r.users for r in prof) == n
    assert abs(sum(r.revenue_pct for r in prof) - 100) < 1e-6
    for c in ("r_score", "f_score", "m_score"):
        assert {r[c] for r in seg.select(c).distinct().collect()} <= {1, 2, 3, 4}


def test_pareto_ends_at_100_and_retention_period0_is_100(spark):
    from clientele.plans import retail_queries as rq
    u = rq.user_table(spark, "/root/testdata/sf0.001")
    last = strategy.pareto_curve(u).orderBy(F.col("user_rank").desc()).first()
    assert abs(last.cum_revenue_pct - 100) < 1e-9 and abs(last.user_pct - 100) < 1e-9
    ret = cohort.cohort_retention(rq.clean(spark, "/root/testdata/sf0.001"))
    assert {r.retention_rate for r in ret.where("period_index = 0").collect()} == {100.0}


def test_cohort_matrix_holds_every_period_of_the_data(spark, tmp_path, monkeypatch):
    """A history of 103 months: the matrix and the long form read back from it lose no cell."""
    from clientele.plans import retail_queries as rq
    lines = tx(spark, [(str(i), "a", "x", 1, ts(f"{day} 10:00:00"), Decimal("1.00"), customer, "UK") for i, (day, customer) in enumerate(
        [("1995-01-31", 1), ("2003-07-01", 1), ("1995-03-01", 2), ("2001-09-30", 2), ("2003-07-31", 3)])])
    monkeypatch.setattr(rq, "clean", lambda s, d: quality.clean(lines))
    matrix = {r["cohort_month"]: r.asDict() for r in rq.QUERIES["cohort_matrix"](spark, f"file://{tmp_path}/long").collect()}
    assert set(matrix["1995-01"]) == {"cohort_month", *map(str, range(103))}
    cells = {(c, int(p), v) for c, r in matrix.items() for p, v in r.items() if p != "cohort_month" and v is not None}
    assert cells == {("1995-01", 0, 100.0), ("1995-01", 102, 100.0), ("1995-03", 0, 100.0), ("1995-03", 78, 100.0), ("2003-07", 0, 100.0)}
    assert {tuple(r) for r in rq.QUERIES["cohort_unpivot"](spark, f"file://{tmp_path}/long").collect()} == cells


def test_golden_month1_retention(spark):
    """Golden replay: the reference's committed month-1 retention column
    (one cohort without month 1).  Existing-cohort mean 20.5, zero-filled 18.9."""
    month1 = [35.3, 20.6, 23.8, 19.0, 19.4, 15.7, 17.4, 15.6, 20.4, 22.6, 25.7, 10.8]
    cohorts = [f"2010-{m:02d}" for m in range(1, 13)] + ["2010-12"]
    rows = [(c, 0, 1, 1, 100.0) for c in cohorts] + [(cohorts[i], 1, 1, 1, v) for i, v in enumerate(month1)]
    ret = spark.createDataFrame(rows, "cohort_month string, period_index int, users long, cohort_size long, "
                                      "retention_rate double")
    mean1 = cohort.retention_curve(ret).where("period_index = 1").first().avg_retention
    zero1 = cohort.retention_zero_filled(ret).where("period_index = 1").first().avg_retention_zero_filled
    assert round(mean1, 1) == 20.5 and round(zero1, 1) == 18.9


def test_column_types_read_the_values(spark):
    rows = [("1", "1.5", "2010-01-01", "x", None, 1.0), (" -2 ", "3", "2010-01-01 10:00:00", "1", None, None), (None, "1e3", None, None, None, 2.0)]
    df = spark.createDataFrame(rows, "a string, b string, c string, `d e` string, f string, g double")
    got = {r.column_name: (r.position, r.data_type, r.value_type, r.value_count) for r in quality.column_types(df).collect()}
    assert got == {"a": (1, "string", "integer", 2), "b": (2, "string", "number", 3), "c": (3, "string", "timestamp", 2),
                   "d e": (4, "string", "text", 2), "f": (5, "string", None, 0), "g": (6, "double", "number", 2)}
    assert {r.value_type for r in quality.column_types(df.where("false")).collect()} == {None}


def test_overview_ignores_nulls_and_takes_an_empty_table(spark):
    rows = [("1", "a", "x", 2, ts("2010-01-01 10:00:00"), Decimal("1.00"), 1, "UK"),
            ("1", "b", "x", 2, ts("2010-01-02 10:00:00"), Decimal("1.00"), None, None),
            (None, None, "x", 2, None, Decimal("1.00"), 1, "FR"),
            ("2", "a", "x", 2, ts("2010-01-03 10:00:00"), Decimal("1.00"), 2, "UK")]
    r = quality.overview(tx(spark, rows)).first()
    assert (r.row_count, r.customers, r.orders, r.countries, r.products) == (4, 2, 2, 2, 2)
    assert (r.first_date, r.last_date) == (ts("2010-01-01 10:00:00"), ts("2010-01-03 10:00:00"))
    empty = quality.overview(tx(spark, [])).first()
    assert (empty.row_count, empty.products, empty.first_date) == (0, 0, None)


def test_categorical_levels_are_bounded(spark):
    df = spark.createDataFrame([(str(i % 7), "x") for i in range(50)], "a string, b string")
    assert churn.categorical_levels(df, ["a", "b"], max_levels=8) == {"a": list("0123456"), "b": ["x"]}
    with pytest.raises(ValueError):
        churn.categorical_levels(df, ["a", "b"], max_levels=7)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 9, 13, 997])
def test_top_share_equals_a_sort(spark, n):
    values = [Decimal((i * 37) % 11 * 100 + (i % 3 == 0) * 50) / 100 for i in range(n)]
    users_df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "customer_id long, total_revenue decimal(32,2)")
    got = strategy.top20_share(users_df).first()
    top = sum(sorted(values, reverse=True)[:n // 5])
    assert (got.users, got.top_users) == (n, n // 5)
    assert got.top_revenue == pytest.approx(float(top))
    assert got.top_share_pct == (pytest.approx(float(top / sum(values) * 100)) if sum(values) else None)
