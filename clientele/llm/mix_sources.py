"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of a source, in the order of a hash of their id, form blocks.
Block ``j`` (from 0) of a source of share ``w`` (its given weight over the sum
of all) is released at slot ``floor(j / w)`` and due by slot
``ceil((j + 1) / w)``; in every slot the released block of the earliest
deadline runs (ties: the source's name).  Each block then runs inside its
window, so after any number of slots each source is less than one block away
from its share.  Weights are taken as they are given: releases and deadlines
are worked out in whole numbers, without rounding, for any number of sources.

A block holds ``block_docs`` documents, or as many more as keep the whole
table at about ``MAX_BLOCKS`` blocks.  The schedule of these blocks, at most
``MAX_BLOCKS`` plus one per source whatever the size of the table, is worked
out from the sources' weights and sizes alone, written to the shared folder
and joined back.

No row is dropped or repeated.  The weights hold up to the slot in which a
source could first lack a full block (``in_target``); a source that has run
dry leaves its slots unused and the others go on in the same proportions.

Skew: documents are numbered inside (source, hash range), so a source with a
third of all rows is spread over as many tasks as it has ranges; only the
ranges' counts are added up per source.

Defined results: a null source is a source of its own (named ''); sources
without a given weight get the smallest weight; a weight for a source that
has no documents is left out; an empty table gives an empty result; repeated
rows keep their number, their order among themselves is open; null ids hash
like any other value; texts are not looked at; extra columns travel along untouched.
"""
from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shared_path

BLOCK_DOCS = 16
# Blocks of the whole table, but for one more per source.
MAX_BLOCKS = 1 << 17
# Hash ranges each source is cut into (a power of 2 up to 4096); an order-preserving cut, so results do not depend on it.
RANGES = 1 << 10
# Rows (sources x ranges, or blocks, some 40 bytes each) up to which a table is broadcast.
BROADCAST_ROWS = 1 << 20


def whole_weights(weights: list[float]) -> list[int]:
    """The same proportions in whole numbers, exactly."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*[w.denominator for w in exact]) if exact else 1
    return [int(w * scale) for w in exact]


def schedule(weights: list[int], blocks: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks, by slot: earliest deadline first."""
    total, out, slot = sum(weights), [], 0
    waiting = [(0, s) for s, n in enumerate(blocks) if n]  # release of each source's next block
    following, ready = [0] * len(weights), []
    heapq.heapify(waiting)
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(following[s] + 1) * total // weights[s]), s, release))
        deadline, s, release = heapq.heappop(ready)
        out.append((s, following[s], release, deadline, slot))
        following[s] += 1
        if following[s] < blocks[s]:
            heapq.heappush(waiting, (following[s] * total // weights[s], s))
        slot += 1
    return out


def source_weights(docs: DataFrame, source_col: str = "source", exponent: float = 0.7) -> dict[str, float]:
    """Target weights count ** exponent: below 1, small sources are read more often than their size."""
    rows = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("s")).count().collect()
    # Thousandths, so that other engines can work with the same whole numbers.
    return {r["s"]: float(math.floor(float(r["count"]) ** exponent * 1000)) for r in rows}


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows written to the shared folder as JSON lines and read back."""
    path = shared_path(spark, "slots")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/slots.json")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        for at in range(0, len(rows), 1 << 15):
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows[at:at + (1 << 15)]).encode()))
    finally:
        out.close()
    return spark.read.schema(schema).json(path)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
        block_docs: int = BLOCK_DOCS, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all, as the struct ``row``) with the place of every document in the mix.

    Columns: row, source, block, release, deadline, slot, place (inside the block), in_target.
    """
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    rows = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|mix"))).alias("h"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))
    # The first 12 bits of the hash, cut to RANGES ranges in its order.
    cut = F.expr(f"cast(conv(substr(h, 1, 3), 16, 10) as int) div {4096 // RANGES}").alias("part")
    sizes = checkpointed(rows.groupBy("source", cut).agg(F.count("*").alias("n")))
    before = sizes.select("source", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    present = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    if weights is None:
        weights = {s: float(n) for s, n in present.items()}
    else:
        least = min([w for w in weights.values() if w > 0], default=1.0)
        weights = {s: weights.get(s, 0) if weights.get(s, 0) > 0 else least for s in present}
    block_docs = max(block_docs, -(-sum(present.values()) // MAX_BLOCKS))
    if len(present) * RANGES <= BROADCAST_ROWS:
        before = F.broadcast(before)
    numbered = rows.withColumn("part", cut).join(before, ["source", "part"]).withColumn(
        "number", F.col("before") + F.row_number().over(Window.partitionBy("source", "part").orderBy("h")) - 1)
    out = numbered.withColumn("block", F.expr(f"number div {block_docs}"))
    place = F.expr(f"int(number % {block_docs})").alias("place")
    names = sorted(present)
    given = whole_weights([weights[s] for s in names])
    runs = schedule(given, [-(-present[s] // block_docs) for s in names])
    # The first slot that could need a block beyond a source's last full one.
    dry = min((present[s] // block_docs * sum(given) // w for s, w in zip(names, given)), default=0)
    slots = _table(spark, [{"p_source": names[s], "p_block": block, "release": release, "deadline": deadline, "slot": slot}
                           for s, block, release, deadline, slot in runs],
                   "p_source string, p_block long, release long, deadline long, slot long")
    if len(runs) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    return out.join(slots, F.expr("source = p_source and block = p_block")).select(
        "row", "source", "block", "release", "deadline", "slot", place, (F.col("slot") < dry).alias("in_target"))


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id",
               source_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, range-partitioned and sorted in mix order."""
    return mix(docs, weights, id_col, source_col).orderBy("slot", "place").select("row.*")
