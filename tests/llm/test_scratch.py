"""What near-duplicate detection leaves on disk while it runs, and after."""
import pathlib

from pyspark.sql import functions as F

from clientele.llm import common, components, minhash_dedup
from clientele.session import SHUFFLE_CLEANUP, ensure_checkpoint_dir


def folders(spark, pattern):
    return set(pathlib.Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob(pattern))


def documents(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(10 * g + c, " ".join([f"g{g}", *words[g:], *(["x"] * c)])) for g in range(6) for c in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_sets_and_old_rounds_are_removed(spark):
    before = folders(spark, "shingle-sets-*"), folders(spark, "rdd-*")
    kept = minhash_dedup.drop_near_duplicates(documents(spark)).collect()
    assert kept
    assert folders(spark, "shingle-sets-*") == before[0]
    chain = spark.range(64).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rdds = folders(spark, "rdd-*")
    found = components.connected_components(chain)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(65)}
    assert len(folders(spark, "rdd-*") - rdds) <= 1  # the last round only


def test_setting_is_restored(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP)
    common.checkpointed(spark.range(10).groupBy("id").count())
    assert spark.conf.get(SHUFFLE_CLEANUP) == before


def test_block_exchange_carries_no_sketch(spark):
    members = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 1, 3)], "key long, hub long, rep long")
    labels = spark.createDataFrame([], "rep long, label long")
    sets = minhash_dedup._full_sets(spark.createDataFrame([(1, "a b c d e f"), (2, "h i j k l m"), (3, "h i j k l m")], "id long, text string"))
    links = minhash_dedup._residual_links(members, labels, sets, 75)
    assert [tuple(r) for r in links.collect()] == [(3, 2)]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    # The operator in front of the blocks' exchange is given the sets alone.
    grouped = next(x for x in plan.splitlines() if "FlatMapGroupsInArrow" in x)
    assert "shingles" in grouped and "sketch" not in grouped
