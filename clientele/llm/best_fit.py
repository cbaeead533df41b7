"""Best-fit packing of whole documents into token sequences, with Martello-Toth dominance reduction.

1. One pass encodes every text with a public tokenizer and cuts documents
   longer than a sequence into pieces; only (document, piece, length, digest)
   is kept, or the ids too where they are asked for.
2. The counts per length, at most ``seq_len`` numbers whatever the table,
   decide the packing (``packing_plan``): sets that provably belong to a best
   packing are fixed, the rest is packed best-fit decreasing.  So the whole
   table is one instance: no partition leaves half-empty sequences behind.
3. The pieces of each length are numbered (in salted windows of about
   ``WINDOW_ROWS`` rows, so a length that a third of all pieces have is no
   single task) and every number has its place by arithmetic.

Encoding goes word by word: the vocabulary's tokenizer never joins text across
white space, so the ids of a text are the ids of its words in a row, and each
distinct word of a batch is encoded once.

Defined results: a null or empty text is the end marker alone; a null id stays
null; rows of equal id are packed separately (equal rows are interchangeable);
texts of any length are cut, never dropped; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, stored
from .packing_plan import places, plan
from .wordcodes import WordCodes

SEQ_LEN = 4096
END_ID = 1
WINDOW_ROWS = 1 << 18
VOCABULARY = "word_bpe_49k.json"
# Words (of at most 64 bytes) whose ids a task remembers, about 100 MB.
CACHE_WORDS = 1 << 19
# Bytes of text encoded at once.
GROUP_BYTES = 8 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# A word of Latin letters, and marks behind it: neither is changed by the tokenizer's normaliser but for A-Z,
# and its split pattern cuts between them.
_PLAIN = re.compile("([A-Za-zß-öø-ÿ]+)([.,;:!?]*)")
# The steps of a vocabulary file whose text is cut at white space for certain.
_BY_WORD = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"]}


def _steps(part: dict | None) -> list[str]:
    return [x["type"] for x in ((part or {}).get("normalizers") or (part or {}).get("pretokenizers") or [])]


class WordEncoder:
    """Token ids of whole batches of texts, each distinct word encoded once.

    Words of plain letters go to the vocabulary's merge model directly, all others through the whole tokenizer.
    A vocabulary of another kind encodes whole texts.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        self.by_word = all(_steps(parts.get(name)) == steps for name, steps in _BY_WORD.items()) and not parts.get("post_processor")
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({chr(c): bytes_of.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)})
        self.cache: dict[bytes, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        ids = self.plain.get(text)
        if ids is None:
            if text[0] in ".,;:!?":
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                found = [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else text.translate(self.letters))]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(text) <= 64 and len(self.plain) < CACHE_WORDS:
                self.plain[text] = ids
        return ids

    def _keep(self, word: bytes, ids: bytes) -> None:
        if len(word) <= 64 and len(self.cache) < CACHE_WORDS:
            self.cache[word] = ids

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out, other = [self.cache.get(w) for w in words], []
        for i, ids in enumerate(out):
            if ids is not None:
                continue
            plain = _PLAIN.fullmatch(words[i].decode())
            if plain:
                letters, marks = plain.groups()
                out[i] = self._plain(letters.lower()) + (self._plain(marks) if marks else b"")
                self._keep(words[i], out[i])
            else:
                other.append(i)
        for at in range(0, len(other), 1 << 14):
            part = other[at:at + (1 << 14)]
            for i, coded in zip(part, self.tokenizer.encode_batch_fast([words[i].decode() for i in part], add_special_tokens=False)):
                out[i] = struct.pack(f"<{len(coded.ids)}I", *coded.ids)
                self._keep(words[i], out[i])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, position where each text begins, and the end)."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            at = np.cumsum([0, *[len(c.ids) for c in coded]])
            return np.array([i for c in coded for i in c.ids], "<u4"), at
        words = WordCodes(texts, WORD_BYTES["space"], lower=False)
        ids = self._ids(words.words.to_pylist())
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        begin = np.cumsum(size) - size
        n = size[words.codes]
        ends = np.cumsum(n)
        at = np.append(0, ends)[words.first]
        source = np.repeat(begin[words.codes] - (ends - n), n) + np.arange(int(n.sum()))
        return flat[source], at


def _gathered(batches):
    """Batches joined up to about GROUP_BYTES: a distinct word is looked up once per group."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > GROUP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID,
           vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]) of every piece of every document."""
    with open(vocabulary or vocabulary_path(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of a few MB

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(shared.value)
        for batch in _gathered(batches):
            ids, at = encoder.encode(batch.column("text"))
            rows, piece, start, length, crc, held = [], [], [], [], [], []
            for row, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                doc = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(doc), seq_len)):
                    part = doc[s:s + seq_len]
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        held.append(part.tobytes())
            columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, schema).withColumnRenamed("id", "doc_id")


def _numbered(cut: DataFrame, lengths: list) -> DataFrame:
    """``cut`` with ``number``: 0, 1, ... within each length."""
    spark = cut.sparkSession
    salts = spark.createDataFrame([(r["length"], -(-r["n"] // WINDOW_ROWS)) for r in lengths], "length long, salts long")
    dealt = cut.join(F.broadcast(salts), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    sizes = dealt.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("number", F.row_number().over(inside) - 1).join(base, ["length", "salt"]).withColumn(
        "number", F.col("number") + F.col("base")).drop("base", "salt")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, end_id: int = END_ID,
         vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; ``with_ids`` carries the ids along (see ``sequences``)."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, id_col, text_col, seq_len, end_id, vocabulary, with_ids), "pieces")
    lengths = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most seq_len rows
    count = np.zeros(seq_len + 1, np.int64)
    for r in lengths:
        count[r["length"]] = r["n"]
    # Bounded by the lengths, not the table: a few entries per length.
    shared = spark.sparkContext.broadcast(places(plan(count, seq_len)))
    names = [c for c in cut.columns]

    def run(batches):
        p = shared.value
        key = (p["length"] << 48) | p["start"]
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(key, (length << 48) | number, side="right") - 1
            rank = number - p["start"][at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(p["sequence"][at] + rank // p["per"][at]),
                 pa.array(p["offset"][at] + rank % p["per"][at] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return _numbered(cut, lengths).select(*names, "number").mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence of ``pack(..., with_ids=True)``: its ids, and document, piece and offset of each segment."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(
        "offset", F.col(id_col).alias("doc_id"), "piece", "length", "ids"))).alias("s"))
    return whole.select("sequence_id", F.expr("aggregate(s, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
                        F.expr("transform(s, x -> x.doc_id)").alias("doc_ids"), F.expr("transform(s, x -> x.piece)").alias("pieces"),
                        F.expr("transform(s, x -> x.offset)").alias("resets"))
