"""Phrase collocations by SON partitioning: shards mined completely, candidates united, then counted exactly.

1. Words are counted per language.
2. Each task belongs to one of ``SHARDS`` shards.  A phrase with ``min_count``
   occurrences has at least ``ceil(min_count / SHARDS)`` of them in some
   shard, so every shard is mined completely at that lowered support: tasks
   pre-aggregate the hashes of all their phrases and ship them as sorted,
   delta-coded runs to a task per (shard, hash range), which sums them.
3. The union of the locally frequent hashes is a bitmap of at most 2^30 bits
   (128 MB), broadcast to a second pass that counts the occurrences of all
   marked phrases by their own words, exactly and over all rows.  Shared
   hashes and shared bits can only add a candidate, never lose one; its exact
   count decides.  Tasks ship counted phrases as lists, one per hash range.
4. Candidates are scored at their worst cut by joins with the counts of their
   parts, and phrases that live mostly inside a longer candidate are dropped.

More shards would lower the local support (from ten shards on to 1, where
nothing is pruned); the shards are large and each is mined by many tasks.

Skew: a hot phrase is one entry per task and run; runs are dealt by hash
ranges sized from the word count; nothing is held per language or per word.

Defined results: null text is empty, null language is ``und``; empty texts have no words; very long texts are read whole and
words of any length count; repeated rows count as often as they occur; phrases never cross texts or the
marks ``.,;:!?`` and line ends; equal scores rank by count, then by UTF-8 bytes; an empty table gives no rows; other columns are ignored.
Counts up to 10^12 keep every product inside 38 digits.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix64, stored
from .wordcodes import TableSums, WordCodes, batches_of, byte_class, run_sums, text_column

# Bytes that end a piece, and those between its words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
WORD = byte_class([(b, b) for b in BREAKS + b"\x20\x09"])
MIN_COUNT = 10
TOP = 2000
SHARDS = 3
INSIDE_PERCENT = 50
UNKNOWN = "und"
# Entries a task or a reducer holds at once; bits of the candidates' bitmap at least and at most.
HELD = 1 << 22
MARK_BITS = (20, 30)
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


class Phrases:
    """All phrases of two and three words of some texts of one language, by occurrence."""

    def __init__(self, column, lang: str):
        words = WordCodes(column, WORD)
        self.words, codes = words.words, words.codes
        breaks = np.flatnonzero(_BREAK[words.raw])
        piece = np.searchsorted(breaks, words.start) + words.doc()  # grows from each piece or text to the next
        self.codes = codes
        self.pair = np.flatnonzero(piece[1:] == piece[:-1])
        self.triple = np.flatnonzero(piece[2:] == piece[:-2])
        self.lang = lang

    def hashes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash (of ``bits`` bits, language included) of every pair and every triple."""
        import xxhash
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()), U64, len(self.words))
        with np.errstate(over="ignore"):
            w = own[self.codes]
            pair = mix64(w[self.pair] * _A + mix64(w[self.pair + 1] * _B))
            triple = mix64(w[self.triple] * _A + mix64(w[self.triple + 1] * _B + mix64(w[self.triple + 2] * _C)))
        return pair >> U64(64 - bits), triple >> U64(64 - bits)

    def counted(self, in_pair: np.ndarray, in_triple: np.ndarray, pair_part: np.ndarray, triple_part: np.ndarray) -> pa.Table:
        """(lang, part, phrase, n) of the marked occurrences, told apart by their words; ``part`` is their hash range."""
        k = len(self.words)
        text, tables = text_column(self.words), []
        at = self.pair[in_pair]
        keys, first, n = np.unique(self.codes[at] * k + self.codes[at + 1], return_index=True, return_counts=True)
        tables.append((pair_part[in_pair][first], [keys // k, keys % k], n))
        at = self.triple[in_triple]
        heads, head = np.unique(self.codes[at] * k + self.codes[at + 1], return_inverse=True)
        keys, first, n = np.unique(head * k + self.codes[at + 2], return_index=True, return_counts=True)
        heads = heads[keys // k] if len(keys) else heads[:0]
        tables.append((triple_part[in_triple][first], [heads // k, heads % k, keys % k], n))
        return pa.concat_tables([pa.table({
            "lang": pa.array([self.lang] * len(n), pa.string()), "part": pa.array(part.astype(np.int64)),
            "phrase": pc.binary_join_element_wise(*[text.take(pa.array(p)) for p in parts], " "),
            "n": pa.array(n.astype(np.int64))}) for part, parts, n in tables])


def _by_lang(batch: pa.RecordBatch):
    """(language, its texts) of a batch."""
    langs = batch.column("lang")
    for lang in langs.unique().to_pylist():
        yield lang, batch.column("text").filter(pc.equal(langs, lang))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""
    def run(batches):
        held = TableSums(["lang", "word"], ["n"])
        for batch in batches:
            for lang, texts in _by_lang(batch):
                words = WordCodes(texts, WORD)
                n = np.bincount(words.codes, minlength=len(words.words))
                yield from batches_of(held.add(pa.table({
                    "lang": pa.array([lang] * len(n), pa.string()), "word": text_column(words.words), "n": pa.array(n.astype(np.int64))})))
        yield from batches_of(held.take())
    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian values as byte planes; high planes are mostly zero and cost nothing once compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _runs(keys: np.ndarray, counts: np.ndarray, shard: int, bits: int, range_bits: int, width: int) -> pa.RecordBatch:
    """One row per hash range: the sorted hashes as differences, and their counts."""
    part = (keys >> U64(bits - range_bits)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys))
    rows = [(shard, int(part[a]), int(b - a), _planes(np.diff(keys[a:b], prepend=U64(0)), width), _planes(counts[a:b], 5))
            for a, b in zip(cut[:-1], cut[1:])]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      names=["shard", "part", "n", "steps", "counts"])


def _marks(rows: DataFrame, bits: int, range_bits: int, mark_bits: int, shards: int, support: int, limit: int) -> np.ndarray:
    """Bitmap over the first ``mark_bits`` bits of the hashes of all phrases that some shard holds ``support`` times."""
    width, slice_bits = -(-bits // 8), mark_bits - range_bits

    def shard_runs(batches):
        shard, held, n_held = TaskContext.get().partitionId() % shards, [], 0

        def summed():
            return run_sums(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for h in Phrases(texts, lang).hashes(bits):
                    keys, n = np.unique(h, return_counts=True)
                    held.append((keys, n.astype(np.int64)))
                    n_held += len(keys)
            if n_held > limit:
                held = [summed()]
                n_held = len(held[0][0])
                if n_held > limit // 2:
                    yield _runs(*held[0], shard, bits, range_bits, width)
                    held, n_held = [], 0
        if n_held:
            yield _runs(*summed(), shard, bits, range_bits, width)

    def frequent(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[1].as_py()
        keys, counts = [], []
        for chunk in table.to_batches():
            for n, steps, c in zip(chunk.column("n").to_pylist(), chunk.column("steps"), chunk.column("counts")):
                keys.append(np.cumsum(_from_planes(steps.as_buffer(), n, width), dtype=U64))
                counts.append(_from_planes(c.as_buffer(), n, 5).astype(np.int64))
        keys, total = run_sums(np.concatenate(keys), np.concatenate(counts))
        found = np.zeros(1 << slice_bits, bool)
        found[(keys[total >= support] >> U64(bits - mark_bits)).astype(np.int64) - (part << slice_bits)] = True
        return pa.table({"part": pa.array([part]), "marks": pa.array([np.packbits(found).tobytes()], pa.binary())})

    def united(table: pa.Table) -> pa.Table:
        slices = [np.frombuffer(m, np.uint8) for m in table.column("marks").to_pylist()]
        return pa.table({"part": table.column("part")[:1], "marks": pa.array([np.bitwise_or.reduce(slices).tobytes()], pa.binary())})

    runs = rows.mapInArrow(shard_runs, "shard int, part long, n long, steps binary, counts binary")
    found = runs.groupBy("shard", "part").applyInArrow(frequent, "part long, marks binary")
    slices = stored(found.groupBy("part").applyInArrow(united, "part long, marks binary"), "local-phrases").toArrow()
    out = np.zeros((1 << range_bits, (1 << slice_bits) // 8), np.uint8)
    for part, marks in zip(slices.column("part").to_pylist(), slices.column("marks").to_pylist()):
        out[part] = np.frombuffer(marks, np.uint8)
    return out.reshape(-1)


def _as_lists(table: pa.Table | None):
    """One row per (lang, part) with its phrases and their counts as lists."""
    if table is None or not table.num_rows:
        return
    table = table.sort_by([("lang", "ascending"), ("part", "ascending")]).combine_chunks()
    lang, part = table.column("lang").combine_chunks(), table.column("part").to_numpy()
    code = lang.dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])))
    ends = pa.array(np.append(first, len(part)).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [lang.take(pa.array(first)), pa.array(part[first]),
         *[pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in ("phrase", "n")]],
        names=["lang", "part", "phrases", "n"])


def _counted(rows: DataFrame, marks: np.ndarray, bits: int, range_bits: int, mark_bits: int, min_count: int) -> DataFrame:
    """(lang, phrase, size, a) of all phrases with at least ``min_count`` occurrences, counted exactly."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def count(batches):
        found = shared.value

        def marked(h):
            at = (h >> U64(bits - mark_bits)).astype(np.int64)
            return (found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        held = TableSums(["lang", "part", "phrase"], ["n"])
        for batch in batches:
            for lang, texts in _by_lang(batch):
                phrases = Phrases(texts, lang)
                pair, triple = phrases.hashes(bits)
                shift = U64(bits - range_bits)
                yield from _as_lists(held.add(phrases.counted(marked(pair), marked(triple), pair >> shift, triple >> shift)))
        yield from _as_lists(held.take())

    def total(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = pa.table({"phrase": pc.list_flatten(table.column("phrases")), "n": pc.list_flatten(table.column("n"))})
        sums = flat.group_by("phrase").aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("n_sum"), min_count))
        return pa.table({"lang": pa.array([key[0].as_py()] * sums.num_rows, pa.string()), "phrase": sums.column("phrase"),
                         "size": pc.add(pc.count_substring(sums.column("phrase"), " "), 1).cast(pa.int32()), "a": sums.column("n_sum")})

    lists = rows.mapInArrow(count, "lang string, part long, phrases array<string>, n array<long>")
    return lists.groupBy("lang", "part").applyInArrow(total, "lang string, phrase string, size int, a long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int | None = TOP,
                 shards: int = SHARDS, held: int = HELD, mark_bits: tuple[int, int] = MARK_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases (all of them if None).

    a, l, r: occurrences of the phrase and of both parts at its worst cut; n: words of the language.
    ``held``: entries a task holds before it gives runs out, and about what a hash range of a shard has;
    ``mark_bits``: size of the candidates' bitmap at least and at most, as a power of two.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    words = stored(word_counts(rows), "word-counts")
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(56, max(32, total.bit_length() + 12))
    range_bits = max(0, (2 * total // (shards * held)).bit_length())
    least, most = mark_bits
    own_bits = max(range_bits + 3, min(most, max(least, total.bit_length() - 1)))
    marks = _marks(rows, bits, range_bits, own_bits, shards, -(-min_count // shards), held)
    grams = stored(_counted(rows, marks, bits, range_bits, own_bits, min_count), "phrases")

    parts = grams.select("lang", "phrase", "a").union(words.select("lang", "word", "n"))
    word = F.split("phrase", " ")
    cut = F.when(F.col("size") == 2, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    cuts = grams.select("lang", "phrase", "size", "a", F.explode(cut).alias("k")).withColumn("w", word).select(
        "lang", "phrase", "size", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"),
        F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("tail"))
    scored = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"])
    big = "cast({} as decimal(13, 0))"
    score = F.expr(f"({big.format('a')} * {big.format('a')} * 1000000) div ({big.format('l')} * {big.format('r')})")
    worst = scored.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("worst")).select("lang", "phrase", "size", "a", "worst.l", "worst.r", "worst.score")
    inside = grams.where("size = 3").withColumn("w", word).select("lang", "a", F.explode(F.array(
        F.expr("array_join(slice(w, 1, 2), ' ')"), F.expr("array_join(slice(w, 2, 2), ' ')"))).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("a").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * INSIDE_PERCENT))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")) if top is None else kept.withColumn(
        "rank", F.row_number().over(best)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(F.broadcast(sizes) if sizes.limit(1001).count() <= 1000 else sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
