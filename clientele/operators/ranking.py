"""Global order statistics without a single-partition window.

``Window.orderBy(x)`` with no partition key moves every row into one task.
At user level on a large cluster that is billions of rows on one core, so
the operators here use the classic distributed form instead:

1. ``repartitionByRange`` on the order key (sampled bounds, balanced ranges),
   ``sortWithinPartitions`` on the same key;
2. each row's position inside its range comes from
   ``monotonically_increasing_id`` (partition id in the upper bits, row
   counter below) — a narrow projection, no shuffle;
3. per-range counts/sums form a table with one row per range (bounded by
   the partition count); prefix offsets over it are broadcast back and
   added to the local position.

The range-tagged rows are checkpointed (reliable, in the shared
checkpoint folder) before the two branches split, so the sampled range
bounds are fixed once: both branches — counts and numbering — see the same
assignment even when the input arrives in shuffle order.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: Sequence[Column | str], *, rank_col: str = "rn",
                running_sum: Column | str | None = None, running_col: str = "running_sum",
                running: Mapping[str, Column | str] | None = None,
                num_partitions: int | None = None) -> DataFrame:
    """Add a 1-based row number over the total order ``order`` and,
    optionally, inclusive running sums in that order (``running`` maps
    output column → value; ``running_sum``/``running_col`` is the one-sum
    shorthand).

    ``order`` must be a total order (end it with a unique key) for the
    numbering to be reproducible.
    """
    sums = dict(running or {})
    if running_sum is not None:
        sums[running_col] = running_sum
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    if num_partitions:
        ranged = df.repartitionByRange(num_partitions, *order_cols)
    else:
        # No fixed count: AQE may merge adjacent small ranges (order kept),
        # so tiny inputs do not become hundreds of empty tasks and files.
        ranged = df.repartitionByRange(*order_cols)
    ranged = ranged.sortWithinPartitions(*order_cols)
    tagged = (ranged.withColumn("_range", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)) + 1))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, (name, value) in enumerate(sums.items()):
        tagged = tagged.withColumn(f"_v{i}", F.col(value) if isinstance(value, str) else value)
        aggs.append(F.sum(f"_v{i}").alias(f"_s{i}"))
    # Range bounds come from sampling the input.  The counts branch and the
    # numbering branch below must see the *same* bounds, but Spark reuses the
    # range exchange only when both branches prune to identical columns, and
    # input read after a shuffle arrives in a different order on every
    # evaluation.  A reliable checkpoint (shared storage, survives lost
    # executors) fixes the assignment once for both branches.
    ensure_checkpoint_dir(df.sparkSession, local_default=True)
    tagged = tagged.checkpoint(eager=True)
    per_range = tagged.groupBy("_range").agg(*aggs)
    # One row per range: a prefix sum over it is a few hundred rows at most.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before")]
    offs += [F.sum(f"_s{i}").over(before).alias(f"_b{i}") for i in range(len(sums))]
    offsets = per_range.select("_range", *offs)
    out = tagged.join(F.broadcast(offsets), "_range")
    out = out.withColumn(rank_col, F.col("_n_before") + F.col("_local"))
    if sums:
        # Running sums inside a range need the range's rows in order: a
        # window keyed by the range id (ranges are balanced by construction).
        local = Window.partitionBy("_range").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
        for i, name in enumerate(sums):
            out = out.withColumn(name, F.coalesce(F.col(f"_b{i}"), F.lit(0)) + F.sum(f"_v{i}").over(local))
        out = out.drop(*[f"_v{i}" for i in range(len(sums))], *[f"_b{i}" for i in range(len(sums))])
    return out.drop("_range", "_local", "_n_before")


# Rank error of the sketch that brackets a quantile, as a share of the rows: 1 / ACCURACY.
ACCURACY = 100_000


def exact_quantiles(df: DataFrame, value: Column | str, probs: Mapping[str, float], *,
                    num_partitions: int | None = None, accuracy: int = ACCURACY,
                    ranks: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row with one struct column ``quantiles`` holding a DOUBLE field
    per entry of ``probs`` (use ``.scalar().getField(name)``): the exact,
    linearly interpolated quantile (``percentile`` / ``quantile_cont``).

    With ``h = (n-1)·p``, ``lo = floor(h)``: ``x[lo] + (x[lo+1] - x[lo])·(h - lo)``
    on the ascending values (nulls ignored).

    No sort of all values: a quantile sketch (whose rank error is guaranteed)
    gives two values that enclose both order statistics; one aggregate then
    counts the rows below that bracket and the distinct values inside it —
    0.02 % of a large table at most — and the order statistics are read off
    their running counts.  ``num_partitions`` spreads the input's scan, if given.

    ``ranks`` names entries that are order statistics instead: a function from
    the number of values to a 0-based rank at most two rows away from ``h``
    (a rank past the last value gives null).
    """
    v = F.col(value) if isinstance(value, str) else value
    xs = df.select(v.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if num_partitions:
        xs = xs.repartition(num_partitions)
    names, ps = list(probs), [float(p) for p in probs.values()]
    # The bracket must reach past the sketch's error and the next row: the narrowest margin that does is taken,
    # which depends on the number of rows and so is chosen inside the plan.
    margins = [m for m in (1.0, 0.1, 0.01, 0.001, 0.0001) if m == 1.0 or m >= 4.0 / accuracy]
    grid = [min(max(p + side * m, 0.0), 1.0) for p in ps for m in margins for side in (-1, 1)]
    sketch = xs.agg(F.struct(F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", grid, accuracy).alias("q")).alias("s")).scalar()
    level = F.lit(0)
    for j, m in enumerate(margins[1:], 1):
        level = F.when(F.lit(m) >= F.lit(2.0 / accuracy) + F.lit(3.0) / F.col("_n"), j).otherwise(level)
    brackets = F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(p).alias("p"), F.element_at("_q", F.lit(2 * len(margins) * i + 1) + 2 * F.col("_level")).alias("lo"),
        F.element_at("_q", F.lit(2 * len(margins) * i + 2) + 2 * F.col("_level")).alias("hi")) for i, p in enumerate(ps)])
    marked = xs.select("_x", sketch.getField("n").alias("_n"), sketch.getField("q").alias("_q")).withColumn("_level", level)
    cells = marked.select(
        "_x", "_n", F.explode(brackets).alias("b")).select("_x", "_n", "b.*").where(F.col("_x") <= F.col("hi"))
    # The null key counts everything below the bracket.
    counted = cells.groupBy("i", "p", "_n", F.when(F.col("_x") >= F.col("lo"), F.col("_x")).alias("k")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("i").orderBy(F.col("k").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    h = (F.col("_n") - 1).cast("double") * F.col("p")
    for i, name in enumerate(names):
        if ranks and name in ranks:
            h = F.when(F.col("i") == i, ranks[name](F.col("_n")).cast("double")).otherwise(h)
    at = (counted.withColumn("stop", F.sum("c").over(upto)).withColumn("_h", h)
          .withColumn("r0", F.floor("_h").cast("long")).withColumn("r1", F.least(F.col("r0") + 1, F.col("_n") - 1)))

    def holds(rank: str) -> Column:
        return (F.col("stop") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("stop"))
    found = at.groupBy("i").agg(F.max(F.when(holds("r0"), F.col("k"))).alias("a"), F.max(F.when(holds("r1"), F.col("k"))).alias("b"),
                                F.max(F.col("_h") - F.col("r0")).alias("part"))
    values = found.select("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))
    return values.agg(F.struct(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(names)])
                      .alias("quantiles"))
