"""Benchmark decontamination as a prefix-filtered containment join, in DataFrame operations only.

A benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window).  A document contains a window if the window's
words occur in it side by side.  Containment asks for all tokens of the
window, so by the prefix-filter principle one token per window is a
necessary prefix: its rarest word, by counts over the whole corpus.

1. Count the benchmark's words over all documents (map-side aggregate).
2. Index every distinct window under its rarest word, with that word's place.
3. Explode the documents' words, join the prefix words, apply the positional
   bound (the window must fit between the first and the last word at that
   place) and compare the window with the words there.
4. Merge the hit ranges of each document; add up its items.

The joins of steps 1 and 3 broadcast the benchmark's side if it is counted to
have at most ``BLOCK_ROWS`` rows: the corpus is not shuffled, only verified hits
are.  A larger benchmark is joined by shuffles, in which a word travels with
its neighbours instead of its text; the number of passes over the corpus is
the same for any benchmark.

Defined results: null and empty texts have no words and are not contaminated;
very long texts are searched whole; empty tables give no rows, or no hits;
items without a word have no window; rows of documents are keyed by id and
text, so repeated rows repeat their result; null ids are ids like any other;
items without an id count as one item in n_items and are left out of the item
list; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, pick

# Bytes that separate words, in lower-cased and in original text.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
# Rows of the benchmark's side that one join may broadcast (a row is a word or a window: below 64 MB).
BLOCK_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS_ANY_CASE), ""))


def _small(df: DataFrame) -> bool:
    return df.limit(BLOCK_ROWS + 1).count() <= BLOCK_ROWS


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, words) for every window of every item."""
    n = F.size("w")
    return items.select(
        F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(n > 0).select(
        "item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))),
                                      lambda i: F.slice("w", i, F.least(n, F.lit(window))))).alias("words"))


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Verified occurrences (id, text_key, start, stop, window_key) of windows in documents.

    ``docs``: (id, text_key, text); ``windows``: (window_key, words), distinct.
    """
    tokens = docs.select("id", "text_key", words(F.col("text")).alias("w"))
    vocabulary = checkpointed(windows.select(F.explode("words").alias("word")).distinct())
    spoken = tokens.select(F.explode("w").alias("word"))
    if _small(vocabulary):
        spoken = spoken.join(F.broadcast(vocabulary), "word")
    counted = spoken.groupBy("word").agg(F.count("*").alias("n"))
    rarity = checkpointed(vocabulary.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    index = checkpointed(
        windows.select("window_key", "words", F.posexplode("words").alias("place", "word")).join(rarity, "word")
        .groupBy("window_key").agg(F.min(F.struct("n", "word", "place")).alias("rarest"), F.first("words").alias("words"))
        .where("rarest.n > 0").select("window_key", "words", F.col("rarest.word").alias("word"), F.col("rarest.place").alias("place")))
    start, length = F.col("at") - F.col("place"), F.size("words")
    if _small(index):
        placed = tokens.where(F.size("w") > 0).select("id", "text_key", "w", F.posexplode("w").alias("at", "word"))
        found = placed.join(F.broadcast(index), "word").where((start >= 0) & (start + length <= F.size("w"))).where(
            F.slice("w", start + 1, length) == F.col("words"))
    else:
        # A word travels with its neighbours on both sides, all that any window around it can hold, not with its text.
        reach = index.agg(F.max(F.size("words")).alias("n")).first()["n"] or 1
        placed = tokens.where(F.size("w") > 0).select("id", "text_key", "w", F.posexplode("w").alias("at", "word")).select(
            "id", "text_key", "word", "at", F.greatest(F.col("at") - reach + 1, F.lit(0)).alias("from"), F.size("w").alias("n"),
            F.slice("w", F.greatest(F.col("at") - reach + 2, F.lit(1)), 2 * reach).alias("near"))
        found = placed.join(index, "word").where((start >= 0) & (start + length <= F.col("n"))).where(
            F.slice("near", start - F.col("from") + 1, length) == F.col("words"))
    return found.select("id", "text_key", start.alias("start"), (start + length).alias("stop"), "window_key")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, items_sha256, contaminated) for every row of ``docs``."""
    text_key = F.xxhash64("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text", text_key.alias("text_key"))
    of_item = checkpointed(item_windows(items, item_col, item_text_col, window).select(
        "item", "words", F.xxhash64("words").alias("window_key")).distinct())
    windows = of_item.groupBy("window_key", "words").agg(F.count("*").alias("items")).select("window_key", "words")
    hits = window_hits(rows, windows)
    found = hits.join(of_item.select("window_key", "item"), "window_key").groupBy("id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("unnamed"))
    # Spans sorted by start: each adds what lies beyond the furthest stop so far.
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("stop")),
        lambda a, s: F.struct((a["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["stop"]))).alias("sum"),
                              F.greatest(a["stop"], s["stop"]).alias("stop")),
        lambda a: a["sum"])
    found = found.select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), covered.alias("n_hit"), "items", "unnamed")
    sized = rows.select("id", "text_key", n_words(F.col("text")).alias("n_words"))
    out = sized.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, with all their columns."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", "text", F.xxhash64("text").alias("text_key"))
    windows = item_windows(items).select("words", F.xxhash64("words").alias("window_key")).distinct()
    # A document is named by its id and text, as one value that is never null.
    hit = window_hits(rows, checkpointed(windows)).select(F.xxhash64("id", "text_key").alias("name")).distinct()
    named = docs.withColumn("_name", F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col))))
    return pick(named, checkpointed(hit), "_name", "left_anti").drop("_name")
