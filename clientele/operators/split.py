"""Exact, reproducible stratified splits and folds (M1, M2).

Rows are ordered inside each class by ``md5(id ‖ seed)``; the first
``round(fraction·n_class)`` rows of a class form the held-out part, and
folds deal the hashed order round-robin.  The per-class position comes from
one global rank over ``(label, hash)`` minus the class's offset — so a
class holding most of the rows is spread over many tasks rather than one
``partition by label`` window.  ``sampleBy`` would only be approximate.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seeded_key
from .ranking import global_rank


def class_positions(df: DataFrame, label: str, id_col: str, seed: int = 42,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``class_pos`` (1-based position in the class's hashed order) and
    ``class_size``."""
    keyed = df.withColumn("_h", seeded_key(id_col, seed))
    ranked = global_rank(keyed, [F.col(label), F.col("_h"), F.col(id_col)], rank_col="_g",
                         num_partitions=num_partitions)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_size"))
    # One row per class: the offset is the size of the classes before it.
    before = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(label, "class_size", F.coalesce(F.sum("class_size").over(before), F.lit(0)).alias("_off"))
    out = ranked.join(F.broadcast(offsets), label)
    return out.withColumn("class_pos", F.col("_g") - F.col("_off")).drop("_g", "_off", "_h")


def held_out_count(class_size, fraction: float):
    """``round(fraction·n)`` half-up, in integers (fraction given to 1/1000)."""
    milli = int(round(fraction * 1000))
    return F.floor((F.lit(2 * milli) * class_size + F.lit(1000)) / F.lit(2000)).cast("long")


def stratified_split(df: DataFrame, label: str, id_col: str, test_fraction: float = 0.2, seed: int = 42,
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``split`` = ``'test'`` / ``'train'``."""
    pos = class_positions(df, label, id_col, seed, num_partitions)
    is_test = F.col("class_pos") <= held_out_count(F.col("class_size"), test_fraction)
    return pos.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("class_pos", "class_size")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42,
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``fold`` in 0..k-1, dealt round-robin in each class's hashed order
    (fold sizes per class differ by at most one)."""
    pos = class_positions(df, label, id_col, seed, num_partitions)
    return pos.withColumn("fold", ((F.col("class_pos") - 1) % k).cast("int")).drop("class_pos", "class_size")
