"""Readers of files a user really has, and a stream that is restarted in a new process."""
import datetime as dt
import json
import subprocess
import sys
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from clientele.plans import cohort, monthly, quality, retail_queries
from clientele.operators import metrics
from clientele.sources import retail, sinks
from tests.conftest import SMOKE_DIR


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


HEADER = " StockCode ,Description, Quantity,Customer ID ,InvoiceDate,Price,Country, Invoice \n"


def test_csv_binds_by_name_and_reads_float_ids_and_other_date_formats(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + '85048,"a, b",12.0,13085.0,01/12/2009 07:45,6.95,United Kingdom,489434\n'
                                              'x,,-1,,31/12/2009 23:59,0.001,,C5\n'
                                              'y,z,two,12.5,2009-12-01,abc,UK,6\n')
    got = [tuple(r) for r in retail.read_csv(spark, path, "dd/MM/yyyy HH:mm").collect()]
    assert got[0] == ("489434", "85048", "a, b", 12, dt.datetime(2009, 12, 1, 7, 45), Decimal("6.95"), 13085, "United Kingdom")
    assert got[1] == ("C5", "x", None, -1, dt.datetime(2009, 12, 31, 23, 59), Decimal("0.00"), None, None)
    assert got[2] == ("6", "y", "z", None, None, None, None, "UK")
    failures = {r.column_name: r.failures for r in retail.csv_failures(spark, path, "dd/MM/yyyy HH:mm").collect()}
    assert {c for c, n in failures.items() if n} == {"quantity", "invoice_date", "price", "customer_id"}
    assert quality.clean(retail.read_csv(spark, path, "dd/MM/yyyy HH:mm")).count() == 1


def test_csv_with_a_missing_column_raises(spark, tmp_path):
    path = write(tmp_path / "b.csv", "Invoice,StockCode\n1,2\n")
    with pytest.raises(ValueError, match="customer_id"):
        retail.read_csv(spark, path)
    schema = T.StructType([T.StructField("StockCode", T.LongType()), T.StructField("Invoice", T.StringType())])
    assert [tuple(r) for r in sinks.read_csv(spark, path, schema).collect()] == [(2, "1")]
    with pytest.raises(ValueError, match="nothing"):
        sinks.read_csv(spark, path, T.StructType([T.StructField("nothing", T.LongType())]))


def test_indented_json_document(spark, tmp_path):
    doc = {"best_model": {"model": "m", "auc": 0.5}, "rates": [1, 2]}
    path = write(tmp_path / "doc.json", json.dumps(doc, indent=2))
    got = sinks.read_json(spark, path, "best_model struct<model: string, auc: double>, rates array<long>").collect()
    assert [r.asDict(recursive=True) for r in got] == [doc]


def test_json_documents_hold_no_nan(spark, tmp_path):
    doc = spark.sql("""SELECT double('NaN') AS a, named_struct('b', double('Infinity'), 'c', 1.5D) AS s,
        array(1.0D, double('-Infinity')) AS l, map('k', double('NaN')) AS m, CAST(NULL AS STRUCT<x: DOUBLE>) AS n, 'NaN' AS t""")
    got = sinks.json_roundtrip(doc, f"file://{tmp_path}/doc").first().asDict(recursive=True)
    assert got == {"a": None, "s": {"b": None, "c": 1.5}, "l": [1.0, None], "m": {"k": None}, "n": None, "t": "NaN"}


def test_wide_cohort_file(spark, tmp_path):
    path = write(tmp_path / "wide.csv", "cohort_month, 0 ,1,2\n2010-01,100.0,35.3,\n2010-02,100.0,,\n")
    got = sorted(tuple(r) for r in sinks.read_wide(spark, path, "cohort_month", "period_index", "retention_rate").collect())
    assert got == [("2010-01", 0, 100.0), ("2010-01", 1, 35.3), ("2010-02", 0, 100.0)]


RUN = """
import sys
sys.path.insert(0, {repo!r})
from clientele.session import build_session
from clientele.streaming.incremental import clean_stream
spark = build_session("local[2]", shuffle_partitions=2, driver_memory="2g", extra={{"spark.checkpoint.dir": {base!r}}})
clean_stream(spark, {raw!r}, {sink!r}).awaitTermination()
print("ROWS", spark.read.parquet({sink!r}).count())
spark.stop()
"""


def test_stream_restarted_in_a_new_process_goes_on(spark, tmp_path):
    rows = [(str(i), "a", "x", 1, dt.datetime(2010, 1, 1 + i), Decimal("1.00"), i, "UK") for i in range(4)]
    raw = f"file://{tmp_path}/raw"
    args = {"repo": sys.path[0], "base": f"file://{tmp_path}/ckpt", "raw": raw, "sink": f"file://{tmp_path}/clean"}
    seen = []
    for part in (rows[:1], rows[1:]):
        spark.createDataFrame(part, retail.TRANSACTION_SCHEMA).coalesce(1).write.mode("append").parquet(raw)
        out = subprocess.run([sys.executable, "-c", RUN.format(**args)], capture_output=True, text=True, timeout=300)
        assert out.returncode == 0, out.stderr[-2000:]
        seen.append(int(out.stdout.split("ROWS")[1]))
    assert seen == [1, 4]


def test_an_invoice_of_two_customers_is_one_order_of_the_month(spark):
    day = dt.datetime(2010, 1, 5)
    rows = [("1", "a", "x", 1, day, Decimal("2.00"), 1, "UK"), ("1", "b", "x", 1, day, Decimal("3.00"), 2, "UK")]
    from clientele.plans import users
    clean = quality.clean(spark.createDataFrame(rows, retail.TRANSACTION_SCHEMA))
    got = monthly.monthly_user_stats(clean, users.user_metrics(clean)).first()
    assert (got.mau, got.total_orders, got.total_revenue, got.new_users) == (2, 1, Decimal("5.00"), 2)


def test_wide_products_do_not_overflow(spark):
    big = 8_000_000_000
    got = spark.range(2).selectExpr(f"{big}L as a", f"{big}L as b").select(metrics._wide_product("a", "b").alias("t"))
    assert got.agg({"t": "sum"}).first()[0] == 2 * big * big


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_rules_reach_the_scan(spark):
    plan = plan_of(retail_queries.QUERIES["clean_transactions"](spark, SMOKE_DIR))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("l_returnflag,R" in line and "l_quantity" in line for line in pushed)
    assert any("p_retailprice" in line for line in pushed) and any("IsNotNull(o_custkey)" in line for line in pushed)


def test_cohorts_scan_the_lines_once(spark):
    df = cohort.cohort_retention(retail_queries.clean(spark, SMOKE_DIR))
    df.collect()
    final = plan_of(df).split("Initial Plan")[0]
    assert final.count("lineitem.parquet") == 1


def test_overview_expands_invoices_not_lines(spark):
    df = quality.overview(retail_queries.raw(spark, SMOKE_DIR))
    text = plan_of(df)
    above = text[text.index("Expand"):]
    assert above.index("HashAggregate") < above.index("lineitem.parquet")


def test_documents_are_read_without_a_schema(spark, tmp_path):
    texts = {"a.json": '{"x": {"y": [1, {"z": "deep"}]}, "rate": 0.25}', "b.json": '{\n  "rate": "text",\n  "only_here": true\n}', "c.json": "no json", "d.json": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    docs = sinks.read_documents(spark, f"file://{tmp_path}")
    got = {r["file"].rsplit("/", 1)[1]: tuple(r)[1:] for r in docs.select(
        "file", sinks.at_path("$.x.y[1].z"), sinks.at_path("$.rate", "double"), sinks.at_path("$.only_here", "boolean")).collect()}
    assert got == {"a.json": ("deep", 0.25, None), "b.json": (None, None, True), "c.json": (None, None, None)}
