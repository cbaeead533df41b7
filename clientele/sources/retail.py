"""The retail ``transactions`` table and its readers.

The logical table is one row per invoice line::

    invoice STRING, stock_code STRING, description STRING, quantity INT,
    invoice_date TIMESTAMP_NTZ, price DECIMAL(12,2), customer_id BIGINT,
    country STRING

``from_tpch`` derives it from the driver's star schema; ``read_csv`` and
``read_parquet`` read it from files a user already has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read_header_csv, table

MONEY = T.DecimalType(12, 2)

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("invoice", T.StringType()),
    T.StructField("stock_code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("invoice_date", T.TimestampNTZType()),
    T.StructField("price", MONEY),
    T.StructField("customer_id", T.LongType()),
    T.StructField("country", T.StringType()),
])

TRANSACTION_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields]


def from_tpch(spark: SparkSession, sf_dir: str, columns: list[str] | None = None,
              valid_only: bool = False) -> DataFrame:
    """Map lineitem ⋈ orders ⋈ part (⟕ customer ⋈ nation) onto ``transactions``.

    * a returned line (``l_returnflag = 'R'``) is a cancellation: invoice ``C<orderkey>``;
    * price is the part's retail price, quantity the line quantity;
    * country comes through customer → nation (left joins: a customer
      without a nation keeps its lines).

    Only the joins the requested ``columns`` need are planned: Spark does
    not drop an unused inner join on its own, and at scale each join here is
    a shuffle of the line table.  Join strategies are left to Catalyst/AQE,
    whose runtime broadcast is size-checked.

    ``valid_only`` is for plans that clean the lines afterwards: it states
    the cleaning rules once more on the raw columns, as plain comparisons
    that the Parquet reader can use to skip data.  They never remove a line
    that the rules on the logical columns would keep.
    """
    want = list(columns or TRANSACTION_COLUMNS)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    if valid_only:
        # Quantity is truncated and price rounded to cents below, so these are the looser bounds.
        lines = lines.where("(l_returnflag <> 'R' OR l_returnflag IS NULL) AND (l_quantity > 0 OR l_quantity IS NULL)")
        orders = orders.where("o_custkey IS NOT NULL")
        parts = parts.where("p_retailprice > 0 OR p_retailprice IS NULL")
    df = (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
          .join(parts, lines.l_partkey == parts.p_partkey))
    if "country" in want:
        cust = _customer_nations(spark, sf_dir)
        df = df.join(cust, df.o_custkey == cust.c_custkey, "left")
    order_key = F.col("l_orderkey").cast("string")
    exprs = {
        "invoice": F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), order_key)).otherwise(order_key),
        "stock_code": F.col("l_partkey").cast("string"),
        "description": F.col("p_name"),
        "quantity": F.col("l_quantity").cast("int"),
        "invoice_date": F.col("o_orderdate"),
        "price": F.col("p_retailprice").cast(MONEY),
        "customer_id": F.col("o_custkey"),
        "country": F.col("n_name"),
    }
    return df.select(*[exprs[c].alias(c) for c in want])


def _customer_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"))


def customer_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer_id, country) as the lines get it."""
    return _customer_nations(spark, sf_dir).select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"))


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _csv_columns(spark: SparkSession, path: str, timestamp_format: str) -> tuple[DataFrame, list[tuple[Column, Column, str]]]:
    """The file as text and (text, typed value, name) of every transaction column."""
    raw = read_header_csv(spark, path)
    # "Customer ID", "customer_id" and " CustomerID" all name the same column.
    by_name = {_plain(c): c for c in raw.columns}
    missing = [c for c in TRANSACTION_COLUMNS if _plain(c) not in by_name]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {raw.columns}")
    out = []
    for field in TRANSACTION_SCHEMA.fields:
        text = F.col(f"`{by_name[_plain(field.name)]}`")
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            # Ids are often written as floats ("13085.0"); a fraction is no id.
            number = F.trim(text).try_cast("decimal(38,6)")
            value = F.when(number == F.floor(number), F.floor(number).try_cast(field.dataType))
        elif isinstance(field.dataType, T.TimestampNTZType):
            value = F.try_to_timestamp(F.trim(text), F.lit(timestamp_format)).cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DecimalType):
            value = F.trim(text).try_cast(field.dataType)
        else:
            value = text
        out.append((text, value, field.name))
    return raw, out


def read_csv(spark: SparkSession, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Transactions from a CSV file, columns found by header name in any order.

    A missing column raises; a value that cannot be read becomes null and is counted by ``csv_failures``.
    """
    raw, columns = _csv_columns(spark, path, timestamp_format)
    return raw.select(*[value.alias(name) for _, value, name in columns])


def csv_failures(spark: SparkSession, path: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """(column_name, failures): values of a CSV file that are present but that ``read_csv`` makes null."""
    raw, columns = _csv_columns(spark, path, timestamp_format)
    one = raw.agg(*[F.count_if((F.trim(text) != "") & value.isNull()).alias(name) for text, value, name in columns])
    return one.unpivot([], TRANSACTION_COLUMNS, "column_name", "failures")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRANSACTION_SCHEMA).parquet(path)


def revenue(quantity: Column | str = "quantity", price: Column | str = "price") -> Column:
    """line revenue, exact decimal (``quantity × price``)."""
    q = F.col(quantity) if isinstance(quantity, str) else quantity
    p = F.col(price) if isinstance(price, str) else price
    return q.cast(T.DecimalType(10, 0)) * p
