"""Helpers shared by the training-data operators.

``TextBatch`` turns an Arrow string column into flat numpy arrays without
making one Python object per document or per word: all UTF-8 bytes of the
batch in one buffer, the word boundaries in it and a 64-bit hash per word.
"""
from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_runtime_conf, ensure_checkpoint_dir, shuffles_released

U64 = np.uint64
# Bytes handled at once by the byte-level kernels; their temporaries are a
# small multiple of it, whatever the batch holds.
PIECE_BYTES = 1 << 21
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the library; Arrow batches bounded by bytes, since documents can be very long."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_PATHS: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder; what is left of it goes when this process ends."""
    path = f"{ensure_checkpoint_dir(spark, local_default=True)}/{name}-{uuid.uuid4().hex}"
    _OWN_PATHS.add(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote below the shared checkpoint folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _OWN_PATHS.discard(path)


@atexit.register
def _delete_own_paths() -> None:
    spark = SparkSession.getActiveSession()
    # After spark.stop() nothing can be deleted any more: the folder is the application's own checkpoint folder.
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_OWN_PATHS):
            delete_path(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut the lineage: write to ``path``, read back."""
    spark = df.sparkSession
    with shuffles_released(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder, read back."""
    return written(df, shared_path(df.sparkSession, name))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the files go with ``drop_checkpoint`` or at the session's end."""
    ensure_checkpoint_dir(df.sparkSession, local_default=True)
    with shuffles_released(df.sparkSession):
        return df.checkpoint(eager=True)


def drop_checkpoint(df: DataFrame) -> None:
    """Remove the files of a ``checkpointed`` frame that no later query reads."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        delete_path(df.sparkSession, file.get())


# Ids that may be broadcast to pick documents (16 MB); more go through a shuffled join.
BROADCAST_IDS = 1 << 21


def if_small(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """``df`` for a join: written once, and broadcast if its rows are counted to be at most ``rows``."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def pick(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join by id; the id list is broadcast only if it is counted to be small."""
    ids = ids.select(F.col(ids.columns[0]).alias("_picked_id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["_picked_id"], how)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` does just that on pure ASCII and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (wraps modulo 2**64)."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def hash_stream(n: int, seed: int) -> np.ndarray:
    """``n`` 64-bit pseudo-random numbers that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64((seed * 0x632BE59BD9B4E019) & (2**64 - 1))) * U64(_GOLDEN))


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]] if len(off) else raw, off - (off[0] if len(off) else 0)


# Byte classes of the two word definitions.
# "alnum": 0-9, a-z, A-Z and every non-ASCII byte; "space": all but space and \t..\r.
_ALL = np.arange(256)
WORD_BYTES = {
    "alnum": (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A))
    | ((_ALL >= 0x61) & (_ALL <= 0x7A)),
    "space": ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D))),
}
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
_BYTE_HASH = hash_stream(256, 1)[LOWER]
_BASE = U64(0x9FB21C651E98DF25)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class TextBatch:
    """Words of a batch of texts.

    ``start``/``length``: byte position (in ``raw``) and byte length of every
    word; ``hash``: 64-bit hash of the word after A-Z are lower-cased;
    ``first``: document ``i`` owns words ``first[i]:first[i + 1]``.
    """

    def __init__(self, column: pa.Array, words: str = "alnum"):
        self.raw, self.offsets = utf8_buffers(column)
        is_word = WORD_BYTES[words]
        starts, lengths, hashes = [], [], []
        for lo, hi in self._pieces(is_word):
            s, n, h = self._words(lo, hi, is_word)
            starts.append(s)
            lengths.append(n)
            hashes.append(h)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.first = np.searchsorted(self.start, self.offsets)

    def _pieces(self, is_word):
        """Byte ranges of about PIECE_BYTES that end at a document's end or after a separator."""
        lo, total = 0, len(self.raw)
        while lo < total:
            hi = min(total, lo + PIECE_BYTES)
            if hi < total:
                end = int(self.offsets[np.searchsorted(self.offsets, hi, side="right") - 1])
                if end > lo:
                    hi = end
                else:  # inside one long text: grow to the next separator
                    text_end = int(self.offsets[np.searchsorted(self.offsets, lo, side="right")])
                    while hi < text_end and is_word[self.raw[hi - 1]]:
                        hi += 1
            yield lo, hi
            lo = hi

    def _words(self, lo: int, hi: int, is_word):
        raw = self.raw[lo:hi]
        inside = is_word[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = self.offsets[np.searchsorted(self.offsets, lo):np.searchsorted(self.offsets, hi)] - lo
        begins[cut] = inside[cut]
        if not len(raw) or not inside.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(inside)
        first = np.flatnonzero(begins[at])
        start = at[first]
        length = np.diff(np.append(first, len(at)))
        place = np.arange(len(at)) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            value = _BYTE_HASH[raw[at]] * _powers(int(length.max()))[place]
            h = mix64(np.add.reduceat(value, first) + length.astype(U64) * U64(_GOLDEN))
        return start + lo, length, h


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words; a shorter, non-empty sequence is one shingle."""
    if not len(words):
        return np.zeros(0, U64)
    k = min(n, len(words))
    factors = hash_stream(k, 100 + k) | U64(1)
    out = np.zeros(len(words) - k + 1, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += words[i:len(words) - k + 1 + i] * factors[i]
    return mix64(out)
