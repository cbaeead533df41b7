"""Near-duplicate detection: one-permutation MinHash, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives every document its set of 5-word shingles, a
   digest of the set and the bucket keys of 40 bands of 4 bins (one-permutation
   hashing, empty bins filled by optimal densification).  A pair of similarity
   0.75 shares no bucket with odds 3e-7.  The texts are not read again, but for
   the documents of the next point.
2. Documents with equal sets collapse to the one of smallest id, so that groups
   of copies cost one row each from here on.
3. In each bucket only edges to its smallest document are candidates: a bucket
   of n documents gives n - 1 edges.  A second pass over the texts of the
   documents in shared buckets gives their full sets and a wide sketch; edges
   that sizes or the sketch do not rule out are confirmed on the full sets.
4. Stars alone would lose a link between two documents that both differ from
   the bucket's centre.  So the members outside the component of the bucket's
   centre (components of the confirmed star links) are compared, as a query
   set in blocks of bounded bytes, with the bucket's other members: by sketch,
   then on the full sets, inside the task, which gives out one row
   for each component it joined to a smaller one and nothing else.
5. Components by large-star/small-star rounds: of the star links, then of
   their components.

Skew: a hot set digest meets a partial aggregate; a hot bucket only gives star
edges and blocks of bounded bytes; hot centres are split by the adaptive skew join.

Defined results: null and empty texts have no shingles and are linked with
nothing; a text of fewer than five words is one shingle; very long texts are
compared on their whole sets; rows that repeat id and text count as one
document, rows that repeat an id with another text are documents of their own
(under that id); a row without id never represents a group and is ``kept`` if
its text is no copy of another row's; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .common import TextBatch, checkpointed, delete_path, drop_checkpoint, pick, shared_path, shingles, stored, utf8_buffers, written
from .components import connected_components
from .minhash_kernel import (SKETCH_BINS, band_keys, may_reach, set_digest, signature, sketch)

SHINGLE = 5
# Bytes of sets in a block of queries and in a block they are compared with.
QUERY_BYTES, DATA_BYTES = 2 << 20, 16 << 20


def _shingle_sets(texts: pa.Array):
    words = TextBatch(texts, "space")
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        yield np.unique(shingles(words.hash[lo:hi], SHINGLE))


def _profiles(docs: DataFrame) -> DataFrame:
    """(id, n, digest, bands) of every document."""
    def run(batches):
        for batch in batches:
            n, digest, sigs, has = [], [], [], []
            for s in _shingle_sets(batch.column("text")):
                n.append(len(s))
                digest.append(set_digest(s) if len(s) else None)
                has.append(len(s) > 0)
                if len(s):
                    sigs.append(signature(s))
            keys = iter(band_keys(np.array(sigs)).view(np.int64).tolist() if sigs else [])
            bands = [next(keys) if h else None for h in has]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])
    return docs.mapInArrow(run, "id long, n long, digest binary, bands array<long>")


def _full_sets(docs: DataFrame) -> DataFrame:
    """(id, n, sketch, shingles) with the sorted 64-bit shingle hashes as bytes."""
    def run(batches):
        for batch in batches:
            n, wide, full = [], [], []
            for s in _shingle_sets(batch.column("text")):
                n.append(len(s))
                wide.append(sketch(s))
                full.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(wide, pa.binary()), pa.array(full, pa.large_binary()).cast(pa.binary())],
                names=["id", "n", "sketch", "shingles"])
    return docs.mapInArrow(run, "id long, n long, sketch binary, shingles binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |A and B| >= percent * |A or B| for two sorted sets."""
    both_n = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both_n >= percent * (len(a) + len(b) - both_n)


def _matrix(column: pa.Array) -> np.ndarray:
    return utf8_buffers(column)[0].reshape(-1, SKETCH_BINS)


def _plausible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (u, v) that sizes and sketches do not rule out."""
    side = sets.select("id", "n", "sketch")
    both = pairs.join(side.toDF("u", "un", "us"), "u").join(side.toDF("v", "vn", "vs"), "v")

    def run(batches):
        for batch in batches:
            us, vs = _matrix(batch.column("us")), _matrix(batch.column("vs"))
            un, vn = (batch.column(c).to_numpy() for c in ("un", "vn"))
            ok = [bool(may_reach(us[i], un[i], vs[i:i + 1], vn[i:i + 1], threshold)[0]) for i in range(batch.num_rows)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
    return both.select("u", "v", "un", "vn", "us", "vs").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on the full shingle sets."""
    side = sets.select("id", "shingles")
    both = pairs.join(side.toDF("u", "us"), "u").join(side.toDF("v", "vs"), "v")

    def run(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent)
                  for a, b in zip(batch.column("us"), batch.column("vs"))]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))
    return both.select("u", "v", "us", "vs").mapInArrow(run, "u long, v long")


def _residual_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components of the star links: in each block a star to the smallest component joined.

    The members of a bucket outside its centre's component are the queries, all its members but the centre the data,
    both in blocks of bounded bytes.  Every pair of different components is screened by sketch and confirmed on the
    full sets inside the task; a confirmed pair joins its components there, so that a block of m rows gives at most
    m - 1 links.
    """
    tagged = members.join(labels.toDF("rep", "label"), "rep", "left").select(
        "key", "hub", "rep", F.coalesce("label", "rep").alias("label"))
    hub_label = tagged.where("rep = hub").select("key", F.col("label").alias("hub_label"))
    marked = tagged.join(hub_label, "key").withColumn("query", F.expr("label <> hub_label")).where("rep <> hub").join(
        sets.select(F.col("id").alias("rep"), (F.col("n") * 8 + SKETCH_BINS).alias("bytes")), "rep")
    blocks = marked.groupBy("key").agg(
        F.count("*").alias("size"), F.sum("bytes").alias("bytes"), F.sum(F.expr("if(query, bytes, 0)")).alias("asked")).where(
        "asked > 0 and size > 1").select(
        "key", F.expr(f"int(ceil(asked / {QUERY_BYTES}))").alias("nq"), F.expr(f"int(ceil(bytes / {DATA_BYTES}))").alias("nd"))
    # A set comes with its sketch only once it is in its blocks: the sketch follows from the set.
    rows = marked.join(blocks, "key").join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")
    own_q, own_d = F.expr("pmod(hash(rep, 1), nq)"), F.expr("pmod(hash(rep, 2), nd)")
    side = [F.col(c) for c in ("label", "shingles")]
    as_query = rows.where("query").select("key", own_q.alias("qb"), F.explode(F.sequence(F.lit(0), F.expr("nd - 1"))).alias("db"), F.lit(True).alias("query"), *side)
    as_data = rows.select("key", F.explode(F.sequence(F.lit(0), F.expr("nq - 1"))).alias("qb"), own_d.alias("db"), F.lit(False).alias("query"), *side)

    def compare(group: pa.Table) -> pa.Table:
        mask = group.column("query").to_numpy(zero_copy_only=False)
        label = group.column("label").to_numpy()
        full = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        n = np.array([len(s) for s in full])
        wide = _matrix(pa.array([sketch(s) for s in full], pa.binary()))
        root = label.copy()
        data = np.flatnonzero(~mask)
        for q in np.flatnonzero(mask):
            others = data[root[data] != root[q]]
            for h in others[may_reach(wide[q], n[q], wide[others], n[others], percent / 100)]:
                if root[h] != root[q] and _linked(full[q], full[h], percent):
                    a, b = sorted((root[h], root[q]))
                    root[root == b] = a
        moved = root != label
        u, first = np.unique(label[moved], return_index=True)
        return pa.table({"u": pa.array(u), "v": pa.array(root[moved][first])})

    return as_query.union(as_data).groupBy("key", "qb", "db").applyInArrow(compare, "u long, v long").distinct()


def _components(rows: DataFrame, percent: int) -> DataFrame:
    """(id, n, component) for ``rows`` (id, text) whose ids differ unless the texts are equal, too."""
    profile = stored(_profiles(rows), "profiles")
    classes = profile.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = checkpointed(classes)
    banded = classes.where("rep is not null").select("rep", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = checkpointed(banded.join(hubs, "key").select("key", "hub", "rep"))
    path = shared_path(rows.sparkSession, "shingle-sets")
    sets = written(_full_sets(pick(rows, members.select("rep"), "id", "left_semi").dropDuplicates(["id"])), path)
    star = members.where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct()
    links = _confirmed(_plausible(star, sets, percent / 100), sets, percent)
    stars = checkpointed(connected_components(links).toDF("node", "label"))
    more = connected_components(_residual_links(members, stars, sets, percent)).toDF("label", "component")
    # The components are written: the large tables they come from are not read again.
    delete_path(rows.sparkSession, path)
    drop_checkpoint(members)
    labels = stars.join(more, "label", "full").select(
        F.coalesce("node", "label").alias("node"), F.coalesce("component", "label").alias("component")).union(
        more.toDF("node", "component")).distinct()
    # From sets back to documents: only sets with copies need the class, only linked nodes the component.
    shared = classes.where("copies > 1").select("digest", "rep")
    node = profile.select("id", "n", "digest").join(shared, "digest", "left").select(
        "id", "n", F.coalesce("rep", "id").alias("node"))
    return node.join(labels, "node", "left").select("id", "n", F.coalesce("component", "node").alias("component"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows (id, text), None) if no id has several rows; else rows keyed by a number per (id, text) in the order of
    the ids, and (number, own_id) of those."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1")
    if not repeated.limit(1).count():
        return rows, None
    texts = rows.where("id is not null").select(F.col("id").alias("own_id"), _text_key(F.col("text")).alias("text_key")).distinct()
    numbers = checkpointed(global_rank(texts, ["own_id", "text_key"], rank_col="number"))
    keyed = rows.withColumn("text_key", _text_key(F.col("text"))).join(
        numbers.withColumnRenamed("text_key", "key"), F.expr("id = own_id and text_key = key"), "left")
    return keyed.select(F.col("number").alias("id"), "text"), numbers.select("number", "own_id", "text_key")


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on their 5-word shingle sets;
    a component is represented by its smallest id.
    """
    rows, numbers = _keyed(docs, id_col, text_col)
    out = _components(rows, percent)
    if numbers is not None:
        names = numbers.select("number", "own_id")
        out = out.join(names.toDF("component", "component_id"), "component", "left").join(
            names.toDF("id", "own_id"), "id", "left").select(F.col("own_id").alias("id"), "n", F.col("component_id").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document represents its component, with all their columns.

    Of rows that repeat both id and text one stays; rows without an id stay unless their text copies another row's.
    """
    rows, numbers = _keyed(docs, id_col, text_col)
    found = _components(rows, 75)
    dropped = found.where("id is not null and not id <=> component").select("id")
    if numbers is None:
        return pick(docs, dropped, id_col, "left_anti")
    named = docs.withColumn("_text_key", _text_key(F.col(text_col).cast("string")))
    numbered = named.join(numbers.toDF("_number", "_own_id", "_key"),
                          (F.col(id_col).cast("long") == F.col("_own_id")) & (F.col("_text_key") == F.col("_key")), "left").drop("_own_id", "_key", "_text_key")
    kept = stored(pick(numbered, dropped, "_number", "left_anti"), "kept-rows")
    return kept.where("_number is null").unionByName(kept.where("_number is not null").dropDuplicates(["_number"])).drop("_number")
