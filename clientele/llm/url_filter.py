"""URL allow and block lists by a cascade of Bloom filters.

A rule is a host with a path prefix; it fits the host and all subdomains of it
for paths that start with the prefix, and the longest fitting rule decides.
So a URL has few candidate keys: each dot-aligned suffix of its host with
each prefix of its path that has the length of some rule's path.

All candidate keys of the corpus are its key universe.  For each list (block,
allow) a cascade is built over it: level 1 is a Bloom filter of the listed
keys, level 2 one of the unlisted keys that pass level 1, level 3 one of the
listed keys that pass level 2, and so on until no key passes wrongly.  A key
is listed if and only if the first level it fails is an even one (or it fails
none and the last is odd): exact for every key of the universe.  The corpus is
then judged without a join, by the filters alone.

The universe (two 64-bit hashes a key, made distinct by a map-side aggregate)
stays in Spark; only filter words travel, OR-ed per word on the executors.
A filter may have ``MAX_FILTER_BYTES``: enough for some hundred million listed
keys; a longer list is refused with an error rather than broadcast.

Defined results: a null URL or one without ``://`` has empty host and path and
no rule; no fitting rule means the default verdict; a key on both lists is
blocked; rules with a null or empty host are ignored, a null path is empty;
repeated rows repeat their result; other columns are ignored.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpointed, hash_stream, lower_ascii, mix64

MAX_FILTER_BYTES = 256 << 20
ALLOW, BLOCK = 1, 2
_SEED = hash_stream(256, 41)


@dataclass
class Bloom:
    words: np.ndarray  # uint64
    hashes: int
    seed: np.uint64

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return bit_places(h1, h2, self.seed, self.hashes, 64 * len(self.words))

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self.places(h1, h2)
        return (((self.words[at >> U64(6)] >> (at & U64(63))) & U64(1)) == 1).all(axis=0)


def bit_places(h1: np.ndarray, h2: np.ndarray, seed: np.uint64, hashes: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a, b = mix64(h1 ^ seed), mix64(h2 ^ seed) | U64(1)
        return (a + np.arange(hashes, dtype=U64)[:, None] * b) % U64(bits)


def bloom_shape(n: int, odds: float) -> tuple[int, int]:
    """(64-bit words, hash functions) for ``n`` keys at false-positive odds ``odds``."""
    words = -(-int(math.ceil(n * -math.log(odds) / math.log(2) ** 2)) // 64)
    if words * 8 > MAX_FILTER_BYTES:
        raise ValueError(f"{n} listed keys need a filter of {words * 8} bytes, more than may be broadcast")
    return max(1, words), max(1, round(-math.log2(odds)))


def listed(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership of keys of the universe."""
    out = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for i, level in enumerate(levels):
        live = live[level.passes(h1[live], h2[live])]
        # Who passes an odd level counts as listed until an even one is passed too.
        out[live] = i % 2 == 0
    return out


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy().view(U64) for c in ("h1", "h2"))


def build_cascade(universe: DataFrame) -> list[Bloom]:
    """Levels for a universe (h1, h2, listed)."""
    spark = universe.sparkSession
    levels: list[Bloom] = []
    sizes = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n_in, n_out = sizes.get(True, 0), sizes.get(False, 0)
    n = n_in
    while n:
        odds = min(0.5, max(1e-6, n_in / max(n_out, 1) / math.sqrt(2))) if not levels else 0.5
        words, hashes = bloom_shape(n, odds)
        seed = _SEED[len(levels)]
        # The keys of this level's side that passed all levels of the other side.
        side = len(levels) % 2 == 0
        against = spark.sparkContext.broadcast([b for i, b in enumerate(levels) if (i % 2 == 0) != side])

        def survivors(batches):
            for batch in batches:
                h1, h2 = _hashes(batch)
                keep = np.ones(len(h1), bool)
                for level in against.value:
                    keep &= level.passes(h1, h2)
                yield h1[keep], h2[keep]

        def filter_words(batches):
            bits = np.zeros(words, U64)
            for h1, h2 in survivors(batches):
                at = bit_places(h1, h2, seed, hashes, 64 * words).ravel()
                np.bitwise_or.at(bits, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
            used = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view(np.int64))], names=["word", "bits"])

        rows = universe.where(F.col("listed") == side).select("h1", "h2")
        bits = np.zeros(words, U64)
        for r in rows.mapInArrow(filter_words, "word long, bits long").groupBy("word").agg(
                F.bit_or("bits").alias("bits")).toLocalIterator():
            bits[r["word"]] = np.array(r["bits"], np.int64).view(U64)
        levels.append(Bloom(bits, hashes, seed))
        # What passes wrongly on the other side is the next level's set.
        other = spark.sparkContext.broadcast([b for i, b in enumerate(levels) if (i % 2 == 0) == side])

        def wrong(batches):
            n_wrong = 0
            for batch in batches:
                h1, h2 = _hashes(batch)
                keep = np.ones(len(h1), bool)
                for level in other.value:
                    keep &= level.passes(h1, h2)
                n_wrong += int(keep.sum())
            yield pa.RecordBatch.from_arrays([pa.array([n_wrong])], names=["n"])

        n = universe.where(F.col("listed") != side).select("h1", "h2").mapInArrow(wrong, "n long").agg(
            F.sum("n")).first()[0] or 0
    return levels


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first '://', or an empty string."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit("second")).alias("h2")]


def candidate_keys(host: Column, path: Column, path_lengths: list[int], most_labels: int) -> Column:
    """Keys a rule for this URL could have, longest first (ties: the longer host).

    No rule's host has more than ``most_labels`` labels, so longer suffixes of the host cannot match."""
    labels = F.split(F.substring_index(host, ".", -max(most_labels, 1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]).cast("array<int>"), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(
        (F.length(s) + n).alias("size"), F.length(s).alias("host_size"), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    ordered = F.sort_array(pairs, asc=False)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(ordered, lambda p: p["key"]))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``.

    ``rules``: (host, path, action) with action 'allow' or 'block'.
    """
    spark = pages.sparkSession
    keys = checkpointed(rules.where("host is not null and host <> ''").select(
        F.concat(lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))).alias("key"),
        F.length(F.coalesce("path", F.lit(""))).alias("path_length"), F.size(F.split("host", r"\.")).alias("labels"),
        F.when(F.col("action") == "block", BLOCK).otherwise(ALLOW).alias("code")))
    # Distinct lengths of path prefixes: bounded by the length of a URL.
    lengths = sorted(r[0] for r in keys.select("path_length").distinct().collect())
    most_labels = keys.agg(F.max("labels")).first()[0] or 0
    parsed = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    named = parsed.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths, most_labels))
    asked = named.select(F.explode("keys").alias("key")).select(*_key_hashes(F.col("key")), F.lit(0).alias("code"))
    universe = checkpointed(asked.union(keys.select(*_key_hashes(F.col("key")), "code")).groupBy("h1", "h2").agg(
        F.max("code").alias("code")))
    cascades = {code: build_cascade(universe.select("h1", "h2", (F.col("code") == code).alias("listed"))) for code in (ALLOW, BLOCK)}
    shared = spark.sparkContext.broadcast(cascades)

    def first_listed(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            codes = np.zeros(batch.num_rows, np.int32)
            lists = batch.column("h1"), batch.column("h2")
            offsets = lists[0].offsets.to_numpy()
            h1, h2 = (x.flatten().to_numpy().view(U64) for x in lists)
            code = np.zeros(len(h1), np.int32)
            for c, levels in shared.value.items():
                code[listed(levels, h1, h2)] = c
            hit = np.flatnonzero(code)
            row = np.searchsorted(offsets - offsets[0], hit, side="right") - 1
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(hit) else hit
            found[row[first]] = hit[first] - (offsets[row[first]] - offsets[0]) + 1
            codes[row[first]] = code[hit[first]]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(found), pa.array(codes)],
                                             names=["kept", "found", "code"])

    asked = named.select(F.struct("id", "host", "path", "keys").alias("kept"),
                         F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"),
                         F.transform("keys", lambda k: F.xxhash64(k, F.lit("second"))).alias("h2"))
    out = asked.mapInArrow(first_listed, f"kept {asked.schema['kept'].dataType.simpleString()}, found int, code int")
    rule = F.when(F.col("found") > 0, F.try_element_at("kept.keys", F.col("found")))
    verdict = F.when(F.col("code") == BLOCK, "block").when(F.col("code") == ALLOW, "allow").otherwise(default)
    return out.select(F.col("kept.id").alias(id_col), "kept.host", "kept.path", rule.alias("rule"), verdict.alias("verdict"))
