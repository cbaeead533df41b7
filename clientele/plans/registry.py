"""All named queries and their oracle SQL, as exposed by ``__spark_entry__``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round6
from ..session import apply_runtime_conf


def finalize(df: DataFrame) -> DataFrame:
    """Output convention: DECIMAL → DOUBLE, every DOUBLE rounded to 6 places."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType)):
            c = round6(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_conf(spark)
        return finalize(fn(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import churn_queries, model_queries, retail_queries
    merged = {}
    merged.update(retail_queries.QUERIES)
    merged.update(churn_queries.QUERIES)
    merged.update(model_queries.QUERIES)
    return {k: _wrap(v) for k, v in merged.items()}


def all_oracle_sql() -> dict[str, str]:
    from . import oracle_churn, oracle_retail
    merged = {}
    merged.update(oracle_retail.ORACLE_SQL)
    merged.update(oracle_churn.ORACLE_SQL)
    return merged
