"""Removal of long repeated byte strings with a logarithmic family of sampled suffix arrays.

A string of WINDOW bytes that starts at two places is to be removed at both.
Indexing every suffix would take more than eight bytes per byte of text, so
the suffixes indexed are those that start at *anchors*: each window of WINDOW
bytes names the leftmost of its 64-byte strings with the least hash, and equal
windows name the same place in them.  One suffix in about 130 is an anchor, no
repeat can miss all of them, and consecutive windows with the same anchor are
kept as one run.

Index (``SuffixLevels``): documents come in batches.  A batch's anchored
suffixes are sorted by the hash of their first 64 bytes (order only has to
bring equal beginnings together) into an array (key, count), which is
merge-scanned against the array of every existing level: keys found twice are
matches.  Then it becomes a level itself; two levels of equal size class are
merged into one of the next class, so n batches leave at most log2 n levels.

Exact lengths: a match of 64 bytes is only a candidate.  In three tiers the
matched anchors are compared on 128-bit hashes of whole strings:
  1. the text of the whole run: equal runs are repeated throughout;
  2. other runs whose beginning is shared: aligned blocks of 16 windows;
  3. blocks that share their common part with a different block: each window.
Every tier keeps one representative of equal strings, so that n copies of a
passage cost n rows in tier 1 and one row after it.

Skew: rows are only ever counted by hash with a map-side aggregate and joined
back by the adaptive join; no group is held in a task but one document's own
spans.

Defined results: strings are judged on the input, never on what is left; null
is the empty text; a text shorter than WINDOW loses nothing; rows that repeat
a whole document are documents of their own (and so repeats of each other);
other columns are ignored.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, delete_path, shared_path, stored, utf8_buffers
from .substring_kernel import SHARED, WINDOW, anchors, blocks, hash_ranges, merge_spans

BATCHES = 4
# Documents with runs to look at, and their runs, up to which these are broadcast to the text scan (some 50 MB).
BROADCAST_RUNS = 1 << 21
_ID = ["id", "text_key"]


class SuffixLevels:
    """Sorted (key, count) arrays whose sizes grow geometrically, stored below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, str] = {}

    def _store(self, array: DataFrame) -> str:
        path = shared_path(self.spark, "suffix-level")
        array.sortWithinPartitions("key").write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key long, n long").parquet(path)

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Index a batch (key); returns the keys that now occur twice and did not match within older batches alone."""
        path = self._store(suffixes.groupBy("key").agg(F.count("*").alias("n")))
        new = self._read(path)
        found = new.where("n > 1").select("key")
        for level in self.levels.values():
            found = found.union(new.select("key").join(self._read(level).select("key").hint("merge"), "key", "left_semi"))
        found = stored(found.distinct(), "suffix-matches")
        size = 0
        while size in self.levels:
            older = self.levels.pop(size)
            merged = self._store(self._read(path).union(self._read(older)).groupBy("key").agg(F.sum("n").alias("n")))
            delete_path(self.spark, path)
            delete_path(self.spark, older)
            path, size = merged, size + 1
        self.levels[size] = path
        return found

    def drop(self) -> None:
        for path in self.levels.values():
            delete_path(self.spark, path)
        self.levels = {}


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def _runs(rows: DataFrame) -> DataFrame:
    """(id, text_key, p, first, last, key, a, b): the anchored runs of every text; positions within the text."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            p, first, last, key, a, b = anchors(raw, offsets)
            doc = np.searchsorted(offsets, first, side="right") - 1
            base = offsets[doc]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(doc)) for c in ("batch", *_ID)], *[pa.array((x - base).astype(np.int32)) for x in (p, first, last)],
                 _i64(key), _i64(a), _i64(b)], names=["batch", *_ID, "p", "first", "last", "key", "a", "b"])
    return rows.select("batch", *_ID, "text").mapInArrow(
        run, "batch int, id long, text_key long, p int, first int, last int, key long, a long, b long")


def _with_text(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """(id, text_key, text, runs): the texts of the documents that have rows in ``found``, those rows as an array."""
    lists = stored(found.groupBy(*_ID).agg(F.collect_list(F.struct(*columns)).alias("runs")), "runs")
    size = lists.agg(F.sum(F.size("runs")), F.count("*")).first()
    # The texts stay where they are if the runs are counted to be few; else both sides are shuffled.
    side = F.broadcast(lists) if (size[0] or 0) + size[1] <= BROADCAST_RUNS else lists
    one = rows.select(*_ID, "text")
    return one.join(side, _ID)


def _flat(column: pa.Array, names: list[str]):
    """(row number, arrays of the fields) of an array<struct> column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    inner = lists.flatten()
    return row, [np.asarray(inner.field(n).to_numpy(zero_copy_only=False)) for n in names]


def _blocks(texts: DataFrame) -> DataFrame:
    """Tier 2: (id, text_key, first, last, known, key, a, b) for every block of the open runs."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            row, (p, first, last, known) = _flat(batch.column("runs"), ["p", "first", "last", "known"])
            base = offsets[row]
            of, lo, hi, common = blocks(p.astype(np.int64), first.astype(np.int64), last.astype(np.int64))
            base = base[of]
            a, b = hash_ranges(raw, lo + base, hi - lo + WINDOW)
            key, _ = hash_ranges(raw, common + base, np.full(len(common), SHARED))
            at = pa.array(row[of])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in _ID], pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                 pa.array(known[of].astype(bool)), _i64(key), _i64(a), _i64(b)],
                names=[*_ID, "first", "last", "known", "key", "a", "b"])
    return texts.select(*_ID, "text", "runs").mapInArrow(
        run, "id long, text_key long, first int, last int, known boolean, key long, a long, b long")


def _windows(texts: DataFrame) -> DataFrame:
    """Tier 3: (id, text_key, first, known, a, b) for every window of the open blocks."""
    def run(batches):
        for batch in batches:
            raw, offsets = utf8_buffers(batch.column("text"))
            row, (first, last, known) = _flat(batch.column("runs"), ["first", "last", "known"])
            count = (last - first + 1).astype(np.int64)
            of = np.repeat(np.arange(len(row)), count)
            start = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
            a, b = hash_ranges(raw, start + offsets[row[of]], np.full(len(start), WINDOW))
            at = pa.array(row[of])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(at) for c in _ID], pa.array(start.astype(np.int32)), pa.array(known[of].astype(bool)),
                 _i64(a), _i64(b)], names=[*_ID, "first", "known", "a", "b"])
    return texts.select(*_ID, "text", "runs").mapInArrow(
        run, "id long, text_key long, first int, known boolean, a long, b long")


def _open(counted: DataFrame) -> DataFrame:
    """Representatives of the strings (key, a, b, n, known, rep) that share their key with another string while one of the two is not known to repeat."""
    contested = counted.groupBy("key").agg(F.count("*").alias("strings"), F.min(F.col("known").cast("int")).alias("all_known")).where(
        "strings > 1 and all_known = 0").select("key")
    return counted.join(contested, "key").select("rep.*", "known")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, text_key, first, last): windows first..last of a document, each of which also starts elsewhere."""
    rows = _rows(docs, id_col, text_col).withColumn("batch", F.pmod(F.hash("id"), F.lit(batches)))
    spark = docs.sparkSession
    path = shared_path(spark, "anchored-runs")
    _runs(rows).write.partitionBy("batch").parquet(path)
    schema = "id long, text_key long, p int, first int, last int, key long, a long, b long, batch int"
    runs = spark.read.schema(schema).parquet(path)

    index = SuffixLevels(spark)
    matches = [index.add(runs.where(F.col("batch") == i).select("key")) for i in range(batches)]
    index.drop()
    matched = matches[0]
    for more in matches[1:]:
        matched = matched.union(more)
    # Stored first: the join then reads plain exchanges on both sides, which Spark can split at a hot key.
    matched = stored(matched.distinct(), "matched-keys")
    hits = stored(runs.join(matched, "key", "left_semi").drop("batch"), "matched-runs")
    delete_path(spark, path)

    counted = stored(hits.groupBy("key", "a", "b").agg(
        F.count("*").alias("n"), F.min(F.struct(*_ID, "p", "first", "last")).alias("rep")).withColumn("known", F.expr("n > 1")), "counted-runs")
    spans = hits.join(counted.where("known").select("key", "a", "b"), ["key", "a", "b"], "left_semi").select(*_ID, "first", "last")

    tier2 = stored(_blocks(_with_text(rows, _open(counted), ["p", "first", "last", "known"])), "blocks")
    counted2 = stored(tier2.groupBy("key", "a", "b").agg(
        F.count("*").alias("n"), F.max("known").alias("was_known"), F.min(F.struct(*_ID, "first", "last")).alias("rep")).withColumn(
        "known", F.expr("n > 1 or was_known")), "counted-blocks")
    spans = spans.union(tier2.where("not known").join(
        counted2.where("known").select("key", "a", "b"), ["key", "a", "b"], "left_semi").select(*_ID, "first", "last"))

    tier3 = stored(_windows(_with_text(rows, _open(counted2), ["first", "last", "known"])), "windows")
    counted3 = tier3.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("known").alias("was_known")).where("n > 1 or was_known")
    return spans.union(tier3.where("not known").join(counted3.select("a", "b"), ["a", "b"], "left_semi").select(
        *_ID, "first", F.col("first").alias("last")))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A row without an id is named by its text.
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text, F.lit("no id"))).alias("id"),
                       F.xxhash64(text).alias("text_key"), text.alias("text"), F.col(id_col).alias("own_id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row of ``docs``; ``kept`` holds the remaining bytes."""
    spans = repeated_spans(docs, id_col, text_col, batches)
    gathered = spans.groupBy(*_ID).agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def merge(parts):
        for batch in parts:
            row, (first, last) = _flat(batch.column("runs"), ["first", "last"])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for lo, hi in zip(ends[:-1], ends[1:]):
                start, stop = merge_spans(first[lo:hi].astype(np.int64), last[lo:hi].astype(np.int64) + WINDOW)
                out.append([{"start": s, "stop": e} for s, e in zip(start.tolist(), stop.tolist())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _ID], pa.array(
                out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=[*_ID, "cuts"])

    cuts = stored(gathered.mapInArrow(merge, "id long, text_key long, cuts array<struct<start: long, stop: long>>"), "cuts")
    size = cuts.agg(F.sum(F.size("cuts")), F.count("*")).first()
    if (size[0] or 0) + size[1] <= BROADCAST_RUNS:
        cuts = F.broadcast(cuts)
    rows = _rows(docs, id_col, text_col)
    joined = rows.join(cuts, _ID, "left").select("own_id", "text", "cuts")

    def cut(parts):
        for batch in parts:
            raw, offsets = utf8_buffers(batch.column("text"))
            found = batch.column("cuts").to_pylist()
            n, removed, spans_n, kept = [], [], [], []
            for i, own in enumerate(found):
                text = raw[offsets[i]:offsets[i + 1]].tobytes()
                own = own or []
                edges = [0, *[x for c in own for x in (c["start"], c["stop"])], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                n.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                spans_n.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("own_id"), *[pa.array(x, pa.int64()) for x in (n, removed, spans_n)], pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["own_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    id_type = rows.schema["own_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"own_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumnRenamed("own_id", id_col)
