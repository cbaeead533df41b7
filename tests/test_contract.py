"""Driver contract: entry(), queries() ↔ oracle_sql() agreement on a subset
at sf0.001, and no Python UDF in value-checked plans."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SMOKE_DIR

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents"]
SUBSET = ["clean_transactions", "cleaning_waterfall", "user_metrics", "monthly_user_stats", "rfm_segments",
          "segment_profile", "lifecycle_distribution", "purchase_funnel", "pareto_curve", "cohort_retention",
          "cohort_matrix", "retention_zero_filled", "kpi_summary", "churn_customers", "one_hot",
          "stratified_folds", "roc_auc", "average_precision", "best_threshold", "classification_report",
          "stream_clean_transactions", "report_metrics"]


def canon(df):
    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, pd.Timestamp):
            return str(v.to_pydatetime())
        return v.item() if hasattr(v, "item") else v
    cols = sorted(df.columns)
    rows = [tuple(norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert "rfm_segment" in df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", SUBSET)
def test_query_matches_oracle(spark, duck, key):
    got = canon(E.queries()[key](spark, SMOKE_DIR).toPandas())
    want = canon(duck.execute(E.oracle_sql()[key]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("key", ["user_metrics", "rfm_segments", "cohort_retention", "roc_auc", "kpi_summary"])
def test_no_python_udf_in_plan(spark, key):
    plan = E.queries()[key](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
