"""SMOTE oversampling as Spark jobs (M3).

For every minority row: its ``k`` nearest minority neighbours (Euclidean,
exact, see ``neighbours``); then synthetic rows ``x + u·(neighbour − x)``
until the minority class matches the majority.

Identical vectors are searched once and expanded afterwards, so a hot group
of copies stays linear.

The draws come from md5 of the row's id and the draw's number, so retries and
re-runs give the same rows and any SQL engine can recompute them: the row at
position ``pos`` (by id) of ``m`` minority rows makes ``S div m`` (+1 while
``pos < S mod m``) synthetic rows, each with a hashed neighbour rank and gap.
"""
from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import distinct_neighbours
from .ranking import global_rank


def _dist(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, x: acc + x))


def nearest_neighbours(points: DataFrame, id_col: str, arr_col: str, dim: int, k: int = 5,
                       num_partitions: int | None = None) -> DataFrame:
    """(id, nbr_rank 0..k-1, nbr_id, nbr_arr): exact k nearest other points,
    ties broken by neighbour id.

    Identical vectors ("copies") are searched once: the search runs on
    distinct vectors (represented by their smallest id), and each copy group
    is expanded through its first k+1 ids only.  A group of copies holding a
    third of all rows therefore costs k+1 candidates per row, not a third of
    the table.  (The true neighbours of a row are its own copies, then ids of
    the k nearest distinct vectors; within a vector the smallest ids come
    first, so the first k+1 ids of each group are enough.)
    """
    pts = points.select(F.col(id_col).alias("_id"), F.col(arr_col).alias("_a"))
    reps = pts.groupBy("_a").agg(F.min("_id").alias("_rep"))
    near = distinct_neighbours(reps.select(F.col("_rep").alias("id"), F.col("_a").alias("x")), dim, k)
    # Vectors come back for the k kept, not for the candidates.
    near = near.join(reps.select(F.col("_rep").alias("nbr_id"), F.col("_a").alias("nbr_arr")), "nbr_id").select(
        F.col("qid").alias("_rep"), "nbr_arr")
    # Position of every row inside its copy group, from one global rank.
    ranked = global_rank(pts, ["_a", "_id"], rank_col="_g", num_partitions=num_partitions)
    starts = ranked.groupBy("_a").agg(F.min("_g").alias("_g0"))
    firsts = (ranked.join(starts, "_a").where(F.col("_g") - F.col("_g0") < k + 1)
              .select("_a", F.col("_id").alias("_cid")))                      # ≤ k+1 per group
    own = (pts.join(firsts, "_a").where(F.col("_cid") != F.col("_id"))
           .select("_id", "_cid", F.col("_a").alias("_ca"), F.lit(0.0).alias("_d")))
    other_groups = near.select(F.col("_rep"), F.col("nbr_arr").alias("_na"))
    other_ids = (other_groups.join(firsts.withColumnRenamed("_a", "_na"), "_na")
                 .select("_rep", "_cid", F.col("_na").alias("_ca")))          # ≤ k(k+1) per group
    rep_of = reps.select("_a", "_rep")
    others = (pts.join(rep_of, "_a").join(other_ids, "_rep")
              .select("_id", "_cid", "_ca", _dist("_a", "_ca").alias("_d")))
    best = Window.partitionBy("_id").orderBy("_d", "_cid")                   # ≤ (k+1)² rows per id
    return (own.unionByName(others).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k)
            .select(F.col("_id").alias(id_col), (F.col("_k") - 1).cast("int").alias("nbr_rank"),
                    F.col("_cid").alias("nbr_id"), F.col("_ca").alias("nbr_arr")))


def _draw(purpose: str, digits: int, seed: int, id_col: str):
    """The first hexadecimal digits of an md5 over (id, draw number, purpose, seed), as a number."""
    text = F.concat_ws("|", F.col(id_col).cast("string"), F.col("_t").cast("string"), F.lit(purpose), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def smote(train: DataFrame, id_col: str = "customer_id", label: str = "label", features: str = "features",
          k: int = 5, seed: int = 42, num_partitions: int | None = None, dim: int | None = None) -> DataFrame:
    """Balance ``train`` (binary ``label``) with synthetic minority rows.

    Returns the original rows plus synthetic ones (``synthetic`` = true,
    id = null) with columns (id, label, features, synthetic, origin, draw):
    ``origin`` is the id of the row a synthetic row starts from, ``draw`` its
    number among that row's.
    """
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    cls = counts.agg(F.struct(F.min_by(label, F.struct("_c", label)).alias("minor"),
                              F.min("_c").alias("n_minor"), F.max("_c").alias("n_major")).alias("s")).scalar()
    if dim is None:
        dim = len(train.select(features).first()[0])  # feature width: metadata of one row
    minor = (train.where(F.col(label) == cls.getField("minor"))
             .select(id_col, vector_to_array(features).alias("_x")))
    nbrs = nearest_neighbours(minor, id_col, "_x", dim, k, num_partitions)
    pos = global_rank(minor.select(id_col, "_x"), [id_col], rank_col="_pos", num_partitions=num_partitions)
    S = cls.getField("n_major") - cls.getField("n_minor")
    m = cls.getField("n_minor")
    reps = F.floor(S / m).cast("long") + F.when((F.col("_pos") - 1) < (S % m), 1).otherwise(0)
    draws = pos.where(reps > 0).select(id_col, "_x", F.explode(F.sequence(F.lit(1).cast("long"), reps)).alias("_t"))
    draws = draws.select(id_col, "_x", "_t",
                         (_draw("neighbour", 8, seed, id_col) % F.nullif(F.least(F.lit(k), m - 1), F.lit(0))).cast("int").alias("nbr_rank"),
                         (_draw("gap", 13, seed, id_col).cast("double") / float(1 << 52)).alias("_u"))
    j = draws.join(nbrs, [id_col, "nbr_rank"])
    synth = j.select(F.lit(None).cast(train.schema[id_col].dataType).alias(id_col),
                     cls.getField("minor").cast(train.schema[label].dataType).alias(label),
                     array_to_vector(F.zip_with("_x", "nbr_arr", lambda a, b: a + F.col("_u") * (b - a)))
                     .alias(features), F.lit(True).alias("synthetic"),
                     F.col(id_col).cast("long").alias("origin"), F.col("_t").alias("draw"))
    real = train.select(id_col, label, features, F.lit(False).alias("synthetic"),
                        F.lit(None).cast("long").alias("origin"), F.lit(None).cast("long").alias("draw"))
    return real.unionByName(synth)
