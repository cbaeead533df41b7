"""Writers and readers for intermediate tables and result documents.

Paths are created by the writers (no separate "ensure directory" step).
Tables go out as Parquet (line tables partitioned by ``year_month`` so
month filters prune files); CSV is offered for hand-off to other tools;
result documents are one-row nested DataFrames written as JSON.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, year_month
from .tables import read_header_csv


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_transactions(clean: DataFrame, path: str) -> None:
    """Cleaned lines, partitioned by month."""
    write_table(clean.withColumn("year_month", year_month("invoice_date")), path, ["year_month"])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header (leaderboard, importances, small tables)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema (never inferred); columns are found by their (trimmed) name."""
    raw = read_header_csv(spark, path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {raw.columns}")
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_wide(spark: SparkSession, path: str, id_col: str, name_col: str, value_col: str) -> DataFrame:
    """A wide CSV (one id column, one numeric column per integer name) in long form; empty cells are left out."""
    raw = read_header_csv(spark, path)
    cols = [c for c in raw.columns if c != id_col]
    long = raw.unpivot(id_col, cols, name_col, value_col)
    return long.select(id_col, F.expr(f"try_cast(`{name_col}` AS INT)").alias(name_col),
                       F.expr(f"try_cast(`{value_col}` AS DOUBLE)").alias(value_col)).where(F.col(value_col).isNotNull())


def json_safe(value: Column, kind: T.DataType) -> Column:
    """``value`` with every number in it that JSON cannot hold replaced by null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return nan_to_null(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, kind.valueType))
    return value


def write_json(doc: DataFrame, path: str) -> None:
    """A result document (one row of structs/maps/arrays) as JSON; NaN and infinities become null."""
    safe = [json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in doc.schema.fields]
    doc.select(*safe).coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read result documents back with their schema: one document per file, on one line or indented."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_roundtrip(doc: DataFrame, path: str) -> DataFrame:
    write_json(doc, path)
    return read_json(doc.sparkSession, path, doc.schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """S8 without a schema: (file, doc) with each file below ``path`` as one VARIANT; null if it is no JSON.

    Values are taken out by path (``at_path``), whatever document wrote them.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.where(F.length("value") > 0).select("file", F.try_parse_json("value").alias("doc"))


def at_path(path: str, kind: str = "string", doc: str = "doc"):
    """The value at ``path`` (``$.a.b[0]``) of a document as ``kind``; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(doc), path, kind)
