"""Fitted models below the shared checkpoint folder.

A family of models has a folder, named by the state of the input files
and by the family's settings, so another application with the same files and
settings reads it instead of fitting again, and changed files or settings
never find an old one.  What was fitted together is one Parquet table in it,
named by its model keys and fit sets.  A table that was not written to its end
is not used.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logistic import Linear
from ..operators.trees import Trees
from ..session import ensure_checkpoint_dir
from .materialize import input_stamp

# Raised when a learner changes in a way that its settings do not show.
VERSION = 2
_NODES = ["feature", "threshold", "left", "right", "value", "cover", "gain"]
_LINEAR = "linear"


def store_path(spark: SparkSession, sf_dir: str, family: str, settings: str) -> str:
    """Folder of a family's models for these input files and settings."""
    ensure_checkpoint_dir(spark, local_default=True)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getCheckpointDir()
    state = input_stamp(spark, sf_dir)[1:]  # without the application
    name = hashlib.md5(repr((VERSION, state, family, settings)).encode()).hexdigest()
    return f"{root.rstrip('/')}/models/{family}-{name}"


def to_rows(models: dict[tuple[int, str], object]) -> pa.Table:
    """One row per node of a tree model, or per weight of a linear one (the intercept last)."""
    parts = []
    for (fit_set, key), m in models.items():
        if isinstance(m, Linear):
            values, kind, base = np.append(m.weights, m.intercept), _LINEAR, 0.0
            columns = {c: values if c == "value" else np.zeros(len(values), np.int64 if c in ("feature", "left", "right") else np.float64) for c in _NODES}
            root = np.zeros(len(values), bool)
        else:
            columns, kind, base = {c: getattr(m, c) for c in _NODES}, "logistic" if m.logistic else "average", m.base
            root = np.isin(np.arange(len(m.feature)), m.root)
        n = len(root)
        parts.append(pa.table({
            "fit_set": pa.array(np.full(n, fit_set, np.int32)), "model_key": pa.array([key] * n), "kind": pa.array([kind] * n),
            "base": pa.array(np.full(n, base)), "place": pa.array(np.arange(n)), "root": pa.array(root),
            **{c: pa.array(np.asarray(columns[c], np.int64 if c in ("feature", "left", "right") else np.float64)) for c in _NODES}}))
    return pa.concat_tables(parts)


def from_rows(rows: pa.Table) -> dict[tuple[int, str], object]:
    """The models written by ``to_rows``."""
    rows = rows.sort_by([("fit_set", "ascending"), ("model_key", "ascending"), ("place", "ascending")])
    names = list(zip(rows.column("fit_set").to_pylist(), rows.column("model_key").to_pylist()))
    first = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
    out = {}
    for a, b in zip(first, [*first[1:], len(names)]):
        part = rows.slice(a, b - a)
        kind, base = part.column("kind")[0].as_py(), part.column("base")[0].as_py()
        c = {name: part.column(name).to_numpy() for name in [*_NODES, "root"]}
        out[names[a]] = Linear(c["value"][:-1], float(c["value"][-1])) if kind == _LINEAR else Trees(
            np.flatnonzero(c["root"]), *[c[name] for name in _NODES], base, kind == "logistic")
    return out


def _tables(spark: SparkSession, path: str) -> dict[str, set[tuple[int, str]]]:
    """Tables of a family's folder that were written to their end, with the (fit set, model key) pairs they hold."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if "@" in name and fs.exists(hadoop(f"{path}/{name}/_SUCCESS")):
            keys, fit_sets = name.split("@")
            found[f"{path}/{name}"] = {(int(s), k) for s in fit_sets.split("-") for k in keys.split("+")}
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    return bool(_tables(spark, path))


def model_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored(spark: SparkSession, sf_dir: str, family: str, settings: str, wanted: list[tuple[int, str]], fit) -> dict[tuple[int, str], object]:
    """The ``wanted`` (fit set, model key) pairs of a family from the store, and whatever lies beside them.

    ``fit(fit sets, model keys)`` fits those that the store does not have."""
    path = store_path(spark, sf_dir, family, settings)
    tables = _tables(spark, path)
    held = set().union(*tables.values())
    todo: dict[tuple[str, ...], list[int]] = {}
    for s in sorted({s for s, _ in wanted}):
        if missing := tuple(sorted(k for of, k in wanted if of == s and (s, k) not in held)):
            todo.setdefault(missing, []).append(s)
    for keys, fit_sets in todo.items():
        table = f"{path}/{'+'.join(keys)}@{'-'.join(map(str, fit_sets))}"
        spark.createDataFrame(to_rows(fit(fit_sets, list(keys)))).withColumn("fit_set", F.col("fit_set").cast("int")).write.mode("overwrite").parquet(table)
        tables[table] = {(s, k) for s in fit_sets for k in keys}
    out: dict[tuple[int, str], object] = {}
    for table, pairs in tables.items():
        if pairs & set(wanted):
            out |= from_rows(model_rows(spark, table).toArrow())
    return out
