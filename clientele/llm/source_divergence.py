"""Source divergence audit: how far the word shares of each (language, source) group lie from those of others.

1. One pass counts terms per (lang, source): occurrences and documents that
   hold the term, summed inside the tasks before they are written.
2. Terms are dealt to blocks by hash, about ``BLOCK_ROWS`` rows each.  A task
   per (lang, block) keeps the terms that enough documents of the language
   hold and numbers them in UTF-8 order, which makes every group a sorted
   (term id, count) array per block, beside the language's own.
3. Pair tasks co-group two tiles of groups' arrays per block and merge each
   unordered pair once: a galloping intersection finds the terms both have;
   overlapping, one-sided and absent terms are priced in both directions.
4. Terms are priced against the language's own shares, and the best of each block compete.

Shares are whole billionths, p = 1 + floor(10^9 (count + 1) / (N + V)), and the
price of p against q is floor((p - q)^2 / q); all arithmetic is on integers and
exact (counts from 2^33 on go through unbounded integers).  The sum of a
group's prices stays below (10^9 + V)^2 + 2 (10^9 + V), inside 64 bits up to V = 2 * 10^9 terms.

Skew: a hot source is one row per task and term, and its array is cut into
blocks like any other; blocks are bounded by their share of the counted rows.
The answer itself has a row for each ordered pair of sources of a language.

Defined results: null text, lang and source read as ''; groups without terms are kept (all their counts are 0); a language
without kept terms has value 0 for all pairs and no terms; ties rank by the UTF-8 bytes of the item; very long texts count
whole; repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .wordcodes import TableSums, WordCodes, batches_of, byte_class, run_sums, text_column

# Fixed value: bytes that end a term, all ASCII but letters.
TERM_BYTES = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
BILLION = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BLOCK_ROWS = 1 << 18
TILE = 16
GALLOP = 256


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed per task only."""
    def run(batches):
        held = TableSums(["lang", "source", "term"], ["n", "docs"])
        for batch in batches:
            words = WordCodes(batch.column("text"), TERM_BYTES)
            if not len(words.codes):
                continue
            lang, source = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            k = len(words.words)
            held_by, n = np.unique(words.doc() * k + words.codes, return_counts=True)
            keys, n, docs = run_sums(group[held_by // k] * k + held_by % k, n, np.ones(len(held_by), np.int64))
            group, term = keys // k, keys % k
            yield from batches_of(held.add(pa.table({
                "lang": lang.dictionary.take(pa.array(group // len(source.dictionary))),
                "source": source.dictionary.take(pa.array(group % len(source.dictionary))),
                "term": text_column(words.words).take(pa.array(term)), "n": pa.array(n), "docs": pa.array(docs)})))
        yield from batches_of(held.take())
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _packed(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def group_arrays(counts: DataFrame, blocks: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """Sorted (term id, count) arrays of every (lang, block, source), and of the language (null source, with its terms)."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, block = (k.as_py() for k in key)
        term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
        words = term.dictionary
        order = pc.sort_indices(words.cast(pa.binary())).to_numpy()
        code = term.indices.to_numpy()
        n, docs = (table.column(c).to_numpy() for c in ("n", "docs"))
        in_docs = np.zeros(len(words), np.int64)
        np.add.at(in_docs, code, docs)
        kept = order[in_docs[order] >= min_docs]
        ids = np.full(len(words), -1, np.int64)
        ids[kept] = np.arange(len(kept))
        at = ids[code]
        mask, v = at >= 0, len(kept)
        keys, n = run_sums(source.indices.to_numpy()[mask].astype(np.int64) * max(v, 1) + at[mask], n[mask])
        owner = keys // max(v, 1)
        cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner)) if len(owner) else np.zeros(1, np.int64)
        own_ids = [keys[a:b] % v for a, b in zip(cut[:-1], cut[1:])]
        own_n = [n[a:b] for a, b in zip(cut[:-1], cut[1:])]
        names = source.dictionary.take(pa.array(owner[cut[:-1]])).to_pylist()
        total = np.zeros(v, np.int64)
        np.add.at(total, keys % max(v, 1), n)
        size = len(names) + 1
        return pa.table({
            "lang": pa.array([lang] * size, pa.string()), "block": pa.array([block] * size, pa.int32()),
            "source": pa.array([*names, None], pa.string()), "ids": _packed([*own_ids, np.arange(v)]),
            "counts": _packed([*own_n, total]), "n": pa.array([int(x.sum()) for x in [*own_n, total]], pa.int64()),
            "v": pa.array([v] * size, pa.int64()),
            "terms": pa.array([*[None] * len(names), words.take(pa.array(kept)).to_pylist()], pa.list_(pa.string()))})

    dealt = counts.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("lang", "block").applyInArrow(
        run, "lang string, block int, source string, ids binary, counts binary, n long, v long, terms array<string>")


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), exactly; ``whole`` is N + V > 0."""
    if not len(counts) or int(counts.max()) < (1 << 33) - 1:
        return 1 + BILLION * (counts + 1) // whole
    return np.array([1 + BILLION * (int(c) + 1) // whole for c in counts], np.int64)


def price(p, q):
    return (p - q) * (p - q) // q


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of their common values (both sorted, without repeats).

    Walks the shorter list in runs; for each the reach in the longer one doubles until it passes the run's end.
    """
    if len(short) > len(long):
        b, a = gallop(long, short)
        return a, b
    mine, other, at = [], [], 0
    for lo in range(0, len(short), GALLOP):
        run = short[lo:lo + GALLOP]
        step = len(run)
        while at + step < len(long) and long[at + step] <= run[-1]:
            step *= 2
        window = long[at:at + step + 1]
        place = np.searchsorted(window, run)
        hit = np.flatnonzero(place < len(window))
        hit = hit[window[place[hit]] == run[hit]]
        mine.append(hit + lo)
        other.append(place[hit] + at)
        at = min(at + int(place[-1]), len(long))
    none = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(other)) if mine else (none, none)


class _Side:
    """A group's array in one block: term ids, shares, and the share of a term it lacks."""

    def __init__(self, name: str, ids: bytes, counts: bytes, whole: int):
        self.name, self.ids = name, np.frombuffer(ids, np.int64)
        self.p = shares(np.frombuffer(counts, np.int64), whole) if len(self.ids) else np.zeros(0, np.int64)
        self.absent = 1 + BILLION // whole if whole else 1


def _sides(table: pa.Table) -> list[_Side]:
    return [_Side(r["source"], r["ids"], r["counts"], r["whole"]) for r in table.select(["source", "ids", "counts", "whole"]).to_pylist()]


def _merge(a: _Side, b: _Side) -> tuple[int, int, int]:
    """(price of a against b, of b against a, terms either has) in one block, terms neither has left out."""
    at, bt = gallop(a.ids, b.ids)
    both_a, both_b = a.p[at], b.p[bt]
    only_a, only_b = np.delete(a.p, at), np.delete(b.p, bt)
    ab = price(both_a, both_b).sum() + price(only_a, b.absent).sum() + price(a.absent, only_b).sum()
    ba = price(both_b, both_a).sum() + price(b.absent, only_a).sum() + price(only_b, a.absent).sum()
    return int(ab), int(ba), len(a.ids) + len(b.ids) - len(at)


def _pairs(arrays: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    # Every group has a place in every block of its language, so that a term only the other side has is priced;
    # block -1 brings the groups of languages without any kept term.
    blocks = arrays.where("source is null").select("lang", "block").union(groups.select("lang", F.lit(-1)).distinct())
    own = arrays.where("source is not null").select("lang", "block", "source", "ids", "counts")
    rows = groups.select("lang", "source", (F.col("big_n") + F.col("v")).alias("whole")).join(blocks, "lang").join(
        own, ["lang", "block", "source"], "left").select(
        "lang", "block", "source", *[F.coalesce(c, F.lit(b"")).alias(c) for c in ("ids", "counts")], "whole")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    tiles = -(-widest // TILE)
    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int"))
    left = tiled.select("*", F.col("tile").alias("t"), F.explode(F.sequence(F.col("tile"), F.lit(tiles - 1))).alias("u"))
    right = tiled.toDF(*tiled.columns).select("*", F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("t"), F.col("tile").alias("u"))
    key = ["lang", "block", "t", "u"]

    def run(key: tuple[pa.Scalar, ...], one: pa.Table, two: pa.Table) -> pa.Table:
        lang, _, t, u = (k.as_py() for k in key)
        one, two, out = _sides(one), _sides(two), []
        for a in one:
            for b in two:
                if t != u or a.name < b.name:
                    out.append((lang, a.name, b.name, a.absent, b.absent, *_merge(a, b)))
        types = [pa.string()] * 3 + [pa.int64()] * 5
        names = ["lang", "a", "b", "pa", "pb", "ab", "ba", "seen"]
        return pa.table({c: pa.array([r[i] for r in out], ty) for i, (c, ty) in enumerate(zip(names, types))})

    merged = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(
        run, "lang string, a string, b string, pa long, pb long, ab long, ba long, seen long")
    whole = merged.groupBy("lang", "a", "b").agg(*[F.max(c).alias(c) for c in ("pa", "pb")],
                                                 *[F.sum(c).alias(c) for c in ("ab", "ba", "seen")])
    whole = whole.join(groups.select("lang", "v").distinct(), "lang").withColumn("unseen", F.expr("v - seen"))
    both = F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.expr("ab + unseen * ((pa - pb) * (pa - pb) div pb)").alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.expr("ba + unseen * ((pb - pa) * (pb - pa) div pa)").alias("value"))))
    return whole.select("lang", both.alias("r")).select("lang", "r.source", "r.item", "r.value")


def _terms(arrays: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): in each block the ``top`` terms a source has more often than its language."""
    own = groups.select("lang", "source", (F.col("big_n") + F.col("v")).alias("whole"))
    language = groups.groupBy("lang").agg((F.sum("big_n") + F.max("v")).alias("whole")).select(
        "lang", F.lit(None).cast("string").alias("source"), "whole")
    rows = arrays.select("lang", "block", "source", "ids", "counts", "terms").join(
        own.union(language).toDF("_l", "_s", "whole"), F.expr("lang = _l and source <=> _s")).drop("_l", "_s")

    def run(table: pa.Table) -> pa.Table:
        head = table.column("source").is_null().to_numpy().nonzero()[0][0]
        lang, terms = table.column("lang")[0].as_py(), table.column("terms")[int(head)].values
        q = shares(np.frombuffer(table.column("counts")[int(head)].as_py(), np.int64), table.column("whole")[int(head)].as_py())
        out = []
        for side in _sides(table.filter(pc.is_valid(table.column("source")))):
            more = np.flatnonzero(side.p > q[side.ids])
            value = price(side.p[more], q[side.ids[more]])
            best = np.lexsort((side.ids[more], -value))[:top]
            out.append(pa.table({"lang": pa.array([lang] * len(best), pa.string()), "source": pa.array([side.name] * len(best), pa.string()),
                                 "item": terms.take(pa.array(side.ids[more[best]])), "value": pa.array(value[best])}))
        return pa.concat_tables(out) if out else pa.table({
            "lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})

    return rows.groupBy("lang", "block").applyInArrow(run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
               min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language,
    part ``term`` the ``top_terms`` terms that mark the source off from its language."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts = stored(term_counts(rows), "term-counts")
    blocks = max(1, -(-counts.count() // block_rows))
    arrays = stored(group_arrays(counts, blocks, min_docs), "group-arrays")
    sizes = arrays.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("big_n"))
    kept = arrays.where("source is null").groupBy("lang").agg(F.sum("v").alias("v"))
    groups = stored(rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").select(
        "lang", "source", F.coalesce("big_n", F.lit(0)).alias("big_n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = _pairs(arrays, groups).withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    term = _terms(arrays, groups, top_terms).withColumn("rank", F.row_number().over(best)).where(
        F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(columns).union(term.select(columns))
