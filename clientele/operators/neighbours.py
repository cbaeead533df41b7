"""Exact k nearest neighbours (Euclidean) without comparing all pairs.

1. A k-d tree is cut on the driver from a bounded sample of the points
   (``SAMPLE_POINTS``) into about ``sqrt(n / LEAF_POINTS)`` regions (at most
   about ``4 * MAX_REGIONS``); it is only a way to deal points out, so the
   sample does not touch the result.
2. The points of a region meet in one task, in pieces of about
   ``PIECE_POINTS`` if there are more.  The task cuts its own k-d tree down to
   leaves of ``LEAF_POINTS`` to twice as many points, whatever the size of the
   table, and finds each point's neighbours inside the piece: nearest boxes
   first, then every box within the distance of the k-th neighbour so far.
3. That distance bounds the true neighbours: a point visits another region
   only if the region's bounding box (one row per region, broadcast) is within
   it.  Visitors come in blocks of about ``VISIT_BLOCK`` and search there as
   in 2, so a region that many points visit is spread over tasks.
4. The k best of all visits, ties by id.

A task returns k ids and distances per point and no vectors.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_POINTS = 1 << 18
MAX_REGIONS = 1 << 13
LEAF_POINTS = 24
PIECE_POINTS = 1 << 18
VISIT_BLOCK = 1 << 14


def _cut(own: np.ndarray, least: int):
    """(dimension, value) that leaves ``least`` points or more on both sides, widest dimension first, or None."""
    spread = own.max(axis=0) - own.min(axis=0)
    for dim in np.argsort(-spread, kind="stable"):
        if not spread[dim] > 0:
            return None
        x = own[:, dim]
        cut = float(np.median(x))
        if cut <= x.min():
            cut = float(x[x > x.min()].min())
        if least <= (x < cut).sum() <= len(x) - least:
            return int(dim), cut
    return None


def build_tree(points: np.ndarray, leaf_points: int, least: int = 1):
    """(dimension, cut, left child, right child) per node; a negative child is the leaf ``-child - 1``.

    Leaves hold at least ``least`` points and at most ``2 * leaf_points``, more only where no cut leaves ``least``
    on both sides (distinct points: fewer than ``least`` per dimension then differ from the rest).
    """
    dims, cuts, left, right = [], [], [], []
    leaves = 0
    todo = [(np.arange(len(points)), -1, False)]
    while todo:
        rows, parent, is_right = todo.pop()
        own = points[rows]
        found = _cut(own, least) if len(rows) > 2 * leaf_points else None
        if found is None:
            child = -leaves - 1
            leaves += 1
        else:
            child, (dim, cut) = len(dims), found
            dims.append(dim)
            cuts.append(cut)
            left.append(0)
            right.append(0)
            todo.append((rows[own[:, dim] < cut], child, False))
            todo.append((rows[own[:, dim] >= cut], child, True))
        if parent >= 0:
            (right if is_right else left)[parent] = child
    return np.array(dims, int), np.array(cuts, float), np.array(left, int), np.array(right, int)


def leaf_of(tree, points: np.ndarray) -> np.ndarray:
    dims, cuts, left, right = tree
    at = np.zeros(len(points), int) if len(dims) else np.full(len(points), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        at[inner] = np.where(points[inner, dims[node]] < cuts[node], left[node], right[node])
    return -at - 1


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows, squares added dimension by dimension (the order any plain loop uses)."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _box_distances(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.sqrt((np.maximum(np.maximum(lo - x, x - hi), 0) ** 2).sum(axis=1))


def _search(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, asked_x: np.ndarray, reach: np.ndarray, k: int):
    """The k nearest points within ``reach`` of each query, not counting a point of the query's own id.

    Gives (query position, id, distance) arrays and the number of points each query was compared with.
    """
    leaf = leaf_of(build_tree(x, LEAF_POINTS, k + 1), x)
    order = np.lexsort((ids, leaf))
    ids, x = ids[order], x[order]
    first = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0]) if len(x) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(x)])
    lo, hi = (f.reduceat(x, first, axis=0) if len(x) else x for f in (np.minimum, np.maximum))
    rows, found, dist, compared = [], [], [], np.zeros(len(asked), np.int64)
    for i in range(len(asked)):
        near = _box_distances(asked_x[i], lo, hi)
        by_box = np.argsort(near, kind="stable")
        # Nearest boxes first, in steps of 1, 3, 12, ...; each step can shorten the bound for the next.
        best_id, best, bound, done = np.zeros(0, ids.dtype), np.zeros(0), reach[i], 0
        while done < len(by_box):
            chosen = by_box[done:max(1, 4 * done)]
            done += len(chosen)
            chosen = chosen[near[chosen] <= bound * (1 + 1e-9)]
            if not len(chosen):
                break
            at = np.concatenate([np.arange(first[c], first[c] + size[c]) for c in chosen])
            compared[i] += len(at)
            d = _distances(asked_x[i][None, :], x[at])[0]
            keep = (ids[at] != asked[i]) & (d <= bound)
            best_id, best = np.r_[best_id, ids[at][keep]], np.r_[best, d[keep]]
            top = np.lexsort((best_id, best))[:k]
            best_id, best = best_id[top], best[top]
            if len(best) == k:
                bound = min(bound, best[-1])
        rows.append(np.full(len(best), i))
        found.append(best_id)
        dist.append(best)
    empty = [np.zeros(0, int)]
    return np.concatenate(rows or empty), np.concatenate(found or empty), np.concatenate(dist or [np.zeros(0)]), compared


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("d", "cid")  # k rows per visited piece
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_neighbours(points: DataFrame, dim: int, k: int = 5) -> DataFrame:
    """(qid, nbr_rank 0..k-1, nbr_id, d) for points (id BIGINT, x ARRAY<DOUBLE>) with distinct vectors."""
    first, second = _found(points, dim, k)
    found = first.union(second).where("cid IS NOT NULL")
    return _best(found, k).select("qid", (F.col("rank") - 1).cast("int").alias("nbr_rank"), F.col("cid").alias("nbr_id"), "d")


def candidates_per_point(points: DataFrame, dim: int, k: int = 5) -> float:
    """Mean number of points each point is compared with (the measure of the search's cost)."""
    first, second = _found(points, dim, k)
    # The row without a neighbour carries the number of comparisons.
    made = first.union(second).where("cid IS NULL").agg(F.sum("d") / F.count_distinct("qid"))
    return made.first()[0] or 0.0


def _dealt(points: DataFrame, dim: int):
    """Points with their region and piece, and (region, n, pieces, lo, hi) of every region."""
    spark = points.sparkSession
    points = points.select(F.col("id").cast("long").alias("id"), "x").checkpoint(eager=True)
    n = points.count()
    rate = min(1.0, SAMPLE_POINTS / max(n, 1))
    draw = F.pmod(F.xxhash64("id", F.lit("tree")), F.lit(1 << 30)) / float(1 << 30)
    # Bounded by SAMPLE_POINTS (in expectation): the tree's shape, not its content, depends on it.
    sample = points.where(draw < rate).select("id", "x").toPandas().sort_values("id")
    fixed = np.array(sample["x"].tolist(), float).reshape(-1, dim)
    # As many regions as leaves in a region: a point is tested against both lists of boxes.
    wanted = min(MAX_REGIONS, max(1, int(np.sqrt(n / LEAF_POINTS))))
    per_region = max(LEAF_POINTS, len(fixed) // wanted)
    shared = spark.sparkContext.broadcast(build_tree(fixed, per_region, max(1, per_region // 4)))

    @F.pandas_udf("int")
    def region(x: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(shared.value, np.array(x.tolist(), float).reshape(-1, dim)).astype(np.int32))

    points = points.withColumn("region", region("x")).checkpoint(eager=True)
    box = [F.array(*[f(F.col("x")[j]) for j in range(dim)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    regions = points.groupBy("region").agg(F.count("*").alias("n"), *box).withColumn(
        "pieces", F.expr(f"int(ceil(n / {PIECE_POINTS}))")).checkpoint(eager=True)
    # One row per region: bounded by the tree.
    points = points.join(F.broadcast(regions.select("region", "pieces")), "region").withColumn(
        "piece", F.expr("pmod(hash(id, 3), pieces)")).drop("pieces")
    return points, regions


_FOUND = "qid long, cid long, d double"


def _answer(asked: np.ndarray, result) -> pa.Table:
    """Neighbours of all queries, and one row without a neighbour per query with its number of comparisons."""
    rows, found, dist, compared = result
    return pa.table({"qid": pa.array(np.r_[asked[rows], asked], pa.int64()),
                     "cid": pa.concat_arrays([pa.array(found, pa.int64()), pa.nulls(len(asked), pa.int64())]),
                     "d": pa.array(np.r_[dist, compared], pa.float64())})


def _found(points: DataFrame, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(qid, cid, d) within each point's own piece, and from its visits elsewhere."""
    points, regions = _dealt(points, dim)

    def inside(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").to_numpy(), _matrix(group.column("x"), dim)
        return _answer(ids, _search(ids, x, ids, x, np.full(len(ids), np.inf), k))

    first = points.select("region", "piece", "id", "x").groupBy("region", "piece").applyInArrow(inside, _FOUND).checkpoint(eager=True)
    visits = _visits(points, regions, first, dim, k)
    blocks = F.broadcast(visits.groupBy("region").agg(F.expr(f"int(ceil(count(*) / {VISIT_BLOCK}))").alias("blocks")))
    pieces = F.broadcast(regions.select("region", "pieces"))
    asked = visits.join(blocks, "region").join(pieces, "region").select(
        "region", F.expr("pmod(hash(qid, 1), blocks)").alias("block"), F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"),
        "qid", "x", "reach", "own_region", "own_piece").where("region <> own_region OR piece <> own_piece")
    data = points.join(blocks, "region").select(
        "region", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "piece", "id", "x")

    def elsewhere(queries: pa.Table, group: pa.Table) -> pa.Table:
        asked, ids = queries.column("qid").to_numpy(), group.column("id").to_numpy()
        if not len(asked) or not len(ids):
            return _answer(asked, (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(len(asked))))
        return _answer(asked, _search(ids, _matrix(group.column("x"), dim), asked, _matrix(queries.column("x"), dim),
                                      queries.column("reach").to_numpy(), k))

    key = ["region", "block", "piece"]
    second = asked.select(*key, "qid", "x", "reach").groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(elsewhere, _FOUND)
    return first, second


def _visits(points: DataFrame, regions: DataFrame, first: DataFrame, dim: int, k: int) -> DataFrame:
    """(qid, x, reach, own_region, own_piece, region): the regions each point still has to visit."""
    spark = points.sparkSession
    reach = first.where("cid IS NOT NULL").groupBy("qid").agg(F.count("*").alias("found"), F.max("d").alias("reach"))
    asked = points.withColumnRenamed("id", "qid").join(reach, "qid", "left").join(
        F.broadcast(regions.select("region", "pieces")), "region").select(
        "qid", "x", F.col("region").alias("own_region"), F.col("piece").alias("own_piece"),
        F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("reach", F.lit(0.0)).alias("reach"), "pieces")
    rows = regions.orderBy("region").collect()  # bounded by the tree
    boxes = spark.sparkContext.broadcast((np.array([r["region"] for r in rows], np.int32), np.array([r["n"] for r in rows]),
                                          np.array([r["lo"] for r in rows], float).reshape(-1, dim),
                                          np.array([r["hi"] for r in rows], float).reshape(-1, dim)))

    def visits(batches):
        names, sizes, lo, hi = boxes.value
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            own, found, pieces = (batch.column(c).to_numpy() for c in ("own_region", "found", "pieces"))
            bound = batch.column("reach").to_numpy().copy()
            q, to = [], []
            for i in range(len(x)):
                if found[i] < k:
                    # Too few in its own piece: the farthest corners of the nearest boxes that hold k more points.
                    far = np.sqrt((np.maximum(np.abs(lo - x[i]), np.abs(hi - x[i])) ** 2).sum(axis=1))
                    order = np.argsort(far, kind="stable")
                    enough = np.searchsorted(np.cumsum(sizes[order]), k + 1)
                    bound[i] = far[order[enough]] * (1 + 1e-9) if enough < len(order) else np.inf
                near = _box_distances(x[i], lo, hi) <= bound[i] * (1 + 1e-9)
                at = np.flatnonzero(near & ((names != own[i]) | (pieces[i] > 1)))
                q.append(np.full(len(at), i))
                to.append(names[at])
            at = np.concatenate(q) if q else np.zeros(0, np.int64)
            cols = [batch.column(c).take(pa.array(at)) for c in ("qid", "x")]
            cols += [pa.array(bound[at]), batch.column("own_region").take(pa.array(at)), batch.column("own_piece").take(pa.array(at)),
                     pa.array(np.concatenate(to) if to else np.zeros(0, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["qid", "x", "reach", "own_region", "own_piece", "region"])

    return asked.mapInArrow(visits, "qid long, x array<double>, reach double, own_region int, own_piece int, region int").checkpoint(eager=True)
