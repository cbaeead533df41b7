"""Spark session settings shared by the library, the tests and the bench.

Everything the library computes is a lazy DataFrame; the session only pins
what changes results (UTC) or the physical plan (AQE, skew handling).
"""
from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that every session running these queries should carry.  They are
# applied with ``spark.conf.set`` on an existing session too, so the driver's
# own session gets the same runtime behaviour.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "clientele",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    checkpoint folder then comes from ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RUNTIME_CONF)
    conf["spark.ui.enabled"] = "false"
    # Checkpoints of tables that are no longer referenced are removed.
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory or (master or "").startswith("local"):
        conf["spark.driver.memory"] = driver_memory or "16g"
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


# Spark removes the shuffle files of a query when it ends instead of when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession):
    """For queries whose result is written or collected once: nothing reads their shuffles again."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def ensure_checkpoint_dir(spark: SparkSession, local_default: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The folder must be on storage every executor reaches.  Only when the
    setting is absent, ``local_default`` is requested *and* the master is
    local (tests, local bench) is a private folder under the system temp
    dir created; otherwise a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # A private temp folder is only acceptable when everything runs in
        # this one process (local master); a cluster must name shared storage.
        if not (local_default and sc.master.startswith("local")):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="clientele-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
