"""Figures from the lines added up once equal those from the lines."""
import datetime as dt
from decimal import Decimal
import random

import pytest

from clientele.plans import cohort, monthly, quality, users
from clientele.sources.retail import TRANSACTION_SCHEMA


def raw_rows():
    rng = random.Random(11)
    rows = []
    for i in range(400):
        order = rng.randrange(90)
        rows.append((("C" if rng.random() < 0.1 else "") + str(order), rng.choice([None, "p1", "p2", "p3", "p4"]), None, rng.choice([None, -1, 0, 1, 5]),
                     rng.choice([None, dt.datetime(2001, 1 + order % 12, 3), dt.datetime(2001, 1 + order % 12, 9, 4)]),
                     rng.choice([None, Decimal("0.00"), Decimal("2.35")]), rng.choice([None, 1, 2, 3, 4]), None))
    return rows + rows[:40]


def same(a, b):
    key = lambda r: tuple(map(str, r))
    return a.columns == b.columns and sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("rows", [raw_rows(), []])
def test_totals_give_the_figures_of_the_lines(spark, rows):
    raw = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    totals = quality.line_totals(raw).cache()
    clean, orders = quality.clean(raw), quality.clean_orders(totals)
    assert same(quality.waterfall_of_totals(totals), quality.cleaning_waterfall(raw))
    of_lines = users.user_metrics(clean)
    assert same(users.user_metrics(orders), of_lines) and users.user_metrics(orders).dtypes == of_lines.dtypes
    assert same(monthly.monthly_user_stats(orders, of_lines), monthly.monthly_user_stats(clean, of_lines))
    assert same(cohort.cohort_retention(orders), cohort.cohort_retention(clean))
    products = totals.where("NOT is_order AND reason IS NULL")
    assert products.select("stock_code").dropna().count() == clean.select("stock_code").dropna().distinct().count()
