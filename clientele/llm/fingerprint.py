"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its 2-word shingles (weight: how often each
occurs; a one-word text is one term).  For each of ``SAMPLES`` samples every
term of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) that depend on the
term alone, and t = floor(ln w / r + b); the sample is the (term, t) of the
least ln c - r (t - b) - r.  Two texts agree in a sample with a probability
equal to their generalised Jaccard similarity, sum of min(w) over sum of
max(w); ``likeness`` is the share of agreeing samples.

The draws come from two tables of ``TABLE`` rows that a term enters at two
independent places, so they are made once per task and not per term; two terms
share both places with odds 1 / TABLE**2.

Defined results: null and empty texts, and texts without a word, have the
empty fingerprint (all 0), which agrees with nothing but itself; equal texts
have equal fingerprints; very long texts count whole; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, TextBatch, hash_stream, mix64, shingles

SAMPLES = 64
TABLE = 1 << 13
_TERM_BLOCK = 4096


def _uniform(n: int, seed: int) -> np.ndarray:
    return ((hash_stream(n, seed) >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ln c, r, b and r (1 - b) of every table row and sample."""
    n = TABLE * SAMPLES
    r = -np.log(_uniform(n, 51) * _uniform(n, 52))
    c = -np.log(_uniform(n, 53) * _uniform(n, 54))
    b = _uniform(n, 55)
    return tuple(x.astype(np.float32).reshape(TABLE, SAMPLES) for x in (np.log(c), r, b, r * (1 - b)))


def fingerprint(words: np.ndarray) -> np.ndarray:
    """Signature (int32) of a text given by the hashes of its words."""
    terms, weights = np.unique(shingles(words, 2), return_counts=True)
    if not len(terms):
        return np.zeros(SAMPLES, np.int32)
    log_c, r, b, once = _tables()
    at_c, at_r = (terms % U64(TABLE)).astype(np.int64), ((terms >> U64(32)) % U64(TABLE)).astype(np.int64)
    least, chosen, step = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
    columns = np.arange(SAMPLES)
    for lo in range(0, len(terms), _TERM_BLOCK):
        part = slice(lo, lo + _TERM_BLOCK)
        a = log_c[at_c[part]] - once[at_r[part]]  # weight 1: t is 0
        t = None
        heavy = np.flatnonzero(weights[part] > 1)
        if len(heavy):
            rows = at_r[part][heavy]
            rh, bh = r[rows], b[rows]
            th = np.floor(np.log(weights[part][heavy]).astype(np.float32)[:, None] / rh + bh)
            a[heavy] = log_c[at_c[part][heavy]] - rh * (th - bh) - rh
            t = np.zeros(a.shape, np.int32)
            t[heavy] = th
        best = a.argmin(axis=0)
        value = a[best, columns]
        better = np.flatnonzero(value < least)
        least[better] = value[better]
        chosen[better] = best[better] + lo
        step[better] = t[best[better], better] if t is not None else 0
    with np.errstate(over="ignore"):
        picked = mix64(terms[chosen] + step.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15))
    return ((picked >> U64(32)).astype(np.uint32) | np.uint32(1)).view(np.int32)


def fingerprints(texts: pa.Array) -> np.ndarray:
    words = TextBatch(texts, "alnum")
    rows = [fingerprint(words.hash[lo:hi]) for lo, hi in zip(words.first[:-1], words.first[1:])]
    return np.array(rows, np.int32).reshape(-1, SAMPLES)


def as_text(prints: np.ndarray) -> pa.Array:
    """Each fingerprint as 8 hexadecimal digits per sample."""
    return pa.array([row.tobytes().hex() for row in prints.astype(">i4")], pa.string())


def from_text(texts: list[str]) -> np.ndarray:
    """The samples of fingerprints written by ``as_text``."""
    return np.array([np.frombuffer(bytes.fromhex(t), ">i4") for t in texts], np.int32).reshape(-1, SAMPLES)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of agreeing samples, row by row."""
    return (a == b).mean(axis=-1)


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; one pass, no shuffle."""
    def run(batches):
        for batch in batches:
            prints = fingerprints(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), as_text(prints)], names=["id", "fingerprint"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, cut, borrowed) sorted so that each row's next document follows it in its partition.

    The order is by descending id (null ids last, equal ids by text); after the last comes the first.
    Ids are cut into ranges at approximate quantiles; each range is sorted on its own, and the first
    document of the range below is sent along as a ``borrowed`` last row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * parts
    points = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    # Range k holds the ids from points[k - 1] on, below points[k]; the points are as many as tasks, not rows.
    edges = spark.sparkContext.broadcast(np.array(sorted(set(points or [])), np.int64))

    @F.pandas_udf("int")
    def cut_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(edges.value, ids[known].astype("int64"), side="right")
        return pd.Series(out)

    cut = rows.select("id", cut_of("id").alias("cut"))
    # At most one row per range; a null head means that the range holds null ids only.
    heads = sorted(((r["cut"], r["head"]) for r in cut.groupBy("cut").agg(F.max("id").alias("head")).collect()), reverse=True)
    # The head of each range closes the range above it, the head of the highest closes the lowest.
    closes = {head: above for (above, _), (_, head) in zip([heads[-1], *heads[:-1]], heads)} if heads else {}
    head_ids = np.array(sorted(h for h in closes if h is not None), np.int64)
    above_of = np.array([closes[h] for h in head_ids.tolist()], np.int32)
    null_above = closes.get(None)
    lookup = spark.sparkContext.broadcast((head_ids, above_of, null_above))

    @F.pandas_udf("array<int>")
    def cuts_of(ids: pd.Series) -> pd.Series:
        head, above, for_null = lookup.value
        own = np.zeros(len(ids), np.int64)
        known = ids.notna().to_numpy()
        values = ids[known].astype("int64").to_numpy()
        own[known] = np.searchsorted(edges.value, values, side="right")
        extra = np.full(len(ids), -1, np.int64)
        if len(head):
            at = np.minimum(np.searchsorted(head, values), len(head) - 1)
            extra[known] = np.where(head[at] == values, above[at], -1)
        if for_null is not None:
            extra[~known] = for_null
        return pd.Series([[o] if e < 0 else [o, e] for o, e in zip(own.tolist(), extra.tolist())])

    dealt = rows.select("id", "text", F.posexplode(cuts_of("id")).alias("borrowed", "cut"))
    return dealt.repartition(parts, "cut").sortWithinPartitions("cut", "borrowed", F.col("id").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside that of its edited text and its likeness to that and to the next document.

    The edited text replaces the last floor(n / 3) characters by as many from the start of the next document.
    """
    ordered = with_next(docs, id_col, text_col)

    def run(batches):
        held = None  # last row of the batch before: (cut, id, text, print)
        for batch in batches:
            cut, borrowed, ids, texts = (batch.column(c).to_pylist() for c in ("cut", "borrowed", "id", "text"))
            prints = fingerprints(batch.column("text"))
            if held is not None:
                cut, borrowed, ids, texts = [held[0], *cut], [0, *borrowed], [held[1], *ids], [held[2], *texts]
                prints = np.vstack([held[3], prints])
            # A row is done if its follower is here; of several borrowed rows only the first follows.
            done = [i for i in range(len(ids) - 1) if not borrowed[i]]
            if borrowed[-1]:
                held = None
            else:
                held = cut[-1], ids[-1], texts[-1], prints[-1]
            if done:
                yield _finished(ids, texts, prints, done)
        if held is not None:
            raise ValueError("a range without a closing row")

    return ordered.select("cut", "borrowed", "id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double").withColumnRenamed("doc_id", id_col)


def _finished(ids: list, texts: list, prints: np.ndarray, done: list[int]) -> pa.RecordBatch:
    edited = []
    for i in done:
        text = texts[i]
        k = len(text) // 3
        edited.append(text[:len(text) - k] + texts[i + 1][:k])
    column = pa.array(edited, pa.large_string())
    after = fingerprints(column)
    own = prints[done]
    following = prints[np.array(done) + 1]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[i] for i in done], pa.int64()), pa.array([len(texts[i]) for i in done], pa.int64()),
         pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
         as_text(own), as_text(after),
         pa.array(likeness(own, after)), pa.array(likeness(own, following))],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
