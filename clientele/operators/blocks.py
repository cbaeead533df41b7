"""Rows as numpy blocks: the layout on which the iterative learners make their passes.

A block row holds up to ``BLOCK_ROWS`` rows of one fit set as packed columns
(``x``: row-major float64, ``y``: uint8, ``key``: one 64-bit hash a row), so
that a pass moves a few binary values to Python instead of one object a row.
A fit set is one training table; several of them (the folds of a
cross-validation, say) share every pass.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BLOCK_ROWS = 8192
ROWS_PER_PARTITION = 200_000
SCHEMA = "fit_set int, n int, x binary, y binary, key binary"


def matrix(data: bytes, n: int) -> np.ndarray:
    """The ``x`` column of a block."""
    return np.frombuffer(data, np.float64).reshape(n, -1)


def flat_lists(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long double lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values, np.float64).reshape(len(column), -1)


def row_key(*columns: str) -> Column:
    """64-bit number of a row by md5 of its named columns; equal on every engine and every run."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def to_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (fit_set int, key long, label int, x array<double>) as checkpointed blocks.

    Partitions hold about ROWS_PER_PARTITION rows and are dealt by key, so a row's place does not depend on how the
    input arrived.
    """
    def run(batches):
        held: dict[int, list] = {}

        def block(s):
            x, y, key = (np.concatenate(part) for part in zip(*held.pop(s)))
            return pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([len(y)], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (x, y, key)]],
                names=["fit_set", "n", "x", "y", "key"])
        for batch in batches:
            sets, key = (batch.column(c).to_numpy() for c in ("fit_set", "key"))
            x, y = flat_lists(batch.column("x")), batch.column("label").to_numpy().astype(np.uint8)
            for s in np.unique(sets).tolist():
                at = sets == s
                held.setdefault(s, []).append((x[at], y[at], key[at]))
                if sum(len(p[1]) for p in held[s]) >= BLOCK_ROWS:
                    yield block(s)
        for s in list(held):
            yield block(s)

    ensure_checkpoint_dir(rows.sparkSession, local_default=True)
    parts = max(1, math.ceil(rows.count() / ROWS_PER_PARTITION))
    dealt = rows.repartition(parts, "key").sortWithinPartitions("fit_set", "key")
    return dealt.select("fit_set", "key", "label", "x").mapInArrow(run, SCHEMA).checkpoint(eager=True)


# Results of a pass that may come to the driver unsummed, in partitions; more are summed in executors first.
DIRECT_PARTITIONS = 8


def summed(parts: DataFrame, keys: list[str], partitions: int, dtype=np.int64) -> list[tuple]:
    """Rows (*keys, values binary of ``dtype`` sums), added up per key.

    What reaches the driver is one row per key (bounded by the models, not by the rows they are fitted on).
    """
    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, dtype) for v in table.column("values").to_pylist()], axis=0)
        return table.slice(0, 1).set_column(table.column_names.index("values"), "values", pa.array([total.tobytes()], pa.binary()))
    if partitions > DIRECT_PARTITIONS:
        parts = parts.groupBy(*keys).applyInArrow(add, parts.schema)
    out: dict[tuple, np.ndarray] = {}
    found = parts.toArrow()
    for *key, values in zip(*[found.column(c).to_pylist() for c in (*keys, "values")]):
        v = np.frombuffer(values, dtype)
        out[tuple(key)] = out[tuple(key)] + v if tuple(key) in out else v
    return list(out.items())


def partitions_of(blocks: DataFrame) -> int:
    return blocks.select(F.spark_partition_id().alias("p")).distinct().count()
