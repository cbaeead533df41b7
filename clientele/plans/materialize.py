"""Build-once tables with their lineage cut (shared by the query registries)."""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_MATERIALIZED: dict = {}
_KEY_LOCKS: dict = {}
_LOCK = threading.Lock()


def input_stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Application and state of the input files, from the file system that holds them.

    A new session or changed files give a new stamp, on HDFS and object stores as well as locally.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return (spark.sparkContext.applicationId, sf_dir)
    listed = sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(path))
    total = fs.getContentSummary(path)
    return (spark.sparkContext.applicationId, sf_dir, tuple(listed), total.getFileCount(), total.getLength())


def once(spark: SparkSession, sf_dir: str, name, build):
    """``build()`` once per (application, input files, name); concurrent callers wait for the first."""
    key = (input_stamp(spark, sf_dir), name)
    with _LOCK:
        # Entries of ended sessions hold frames nobody can use.
        for old in [k for k in _MATERIALIZED if k[0][0] != key[0][0]]:
            del _MATERIALIZED[old]
        own = _KEY_LOCKS.setdefault(key, threading.RLock())
    with own:
        if key not in _MATERIALIZED:
            _MATERIALIZED[key] = build()
        return _MATERIALIZED[key]


def materialized(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a user-level table once per (application, input files) and cut
    its lineage with a reliable checkpoint in ``spark.checkpoint.dir``.

    User-level queries make several passes (quantiles, ranks, totals as
    scalar subqueries); starting them from a checkpointed scan keeps their
    plans short and their recomputation after a lost executor cheap.  The
    table is one row per customer — far smaller than the lines it comes from.
    """
    def make() -> DataFrame:
        ensure_checkpoint_dir(spark, local_default=True)
        return build().checkpoint(eager=True)
    return once(spark, sf_dir, name, make)
