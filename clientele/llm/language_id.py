"""Language identification: multinomial naive Bayes over hashed character n-grams.

Model: for every language the smoothed log-probability of each of
``2**bits`` n-gram buckets, a matrix of (buckets x languages) float32 that is
broadcast to the scoring tasks (its size is set by ``bits`` and the number of
languages, not by the data).  The n-grams are runs of 1 to 4 characters of the
text with ASCII letters lower-cased and everything that is not a letter
reduced to one blank.

Training counts the n-grams of all labelled documents.  Counts are summed in
Spark; only the finished matrix reaches the driver.

Scoring is one pass without a shuffle: the n-gram buckets of a batch of texts
form a sparse row matrix (indices and row pointers), which is multiplied with
the log-probability matrix in numpy.

Defined results: null texts and texts without a letter are ``und`` with score
0; an empty training set makes every text ``und``; ties go to the language
that sorts first; rows are scored one by one, so repeated rows repeat their
result; very long texts are scored whole, in pieces; an empty table gives no
rows.  Columns other than the named ones are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, hash_stream, mix64, utf8_buffers

ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"
# Languages whose counts a training task holds at once (0.5 MB each).
HELD_LANGS = 64
_PIECE = 1 << 18  # bytes decoded, and code points whose n-grams are held at once


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # (2**bits, len(langs)) float32
    log_prior: np.ndarray
    bits: int


def _decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of UTF-8 bytes that end with a whole character."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
    cp = b[at]
    wide = np.flatnonzero(cp >= 0x80)
    p, c0 = at[wide], cp[wide]
    c1, c2, c3 = b[p + 1] & 0x3F, b[p + 2] & 0x3F, b[p + 3] & 0x3F
    cp[wide] = np.where(c0 < 0xE0, ((c0 & 0x1F) << 6) | c1, np.where(
        c0 < 0xF0, ((c0 & 0x0F) << 12) | (c1 << 6) | c2, ((c0 & 0x07) << 18) | (c1 << 12) | (c2 << 6) | c3))
    return cp, at


def _code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of a UTF-8 buffer and the row offsets in characters, decoded piece by piece."""
    parts, first, done, lo = [], np.zeros(len(offsets), np.int64), 0, 0
    while lo < len(raw):
        hi = min(len(raw), lo + _PIECE)
        while hi < len(raw) and (raw[hi] & 0xC0) == 0x80:
            hi += 1
        cp, at = _decode(raw[lo:hi])
        inside = slice(np.searchsorted(offsets, lo), np.searchsorted(offsets, hi))
        first[inside] = done + np.searchsorted(at, offsets[inside] - lo)
        parts.append(_normalise(cp))
        done += len(cp)
        lo = hi
    first[np.searchsorted(offsets, len(raw)):] = done
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), first


# ASCII letters in lower case, all else a blank.
_ASCII = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def _normalise(cp: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters; all other ASCII characters become a blank."""
    ascii_ = np.flatnonzero(cp < 128)
    cp[ascii_] = _ASCII[cp[ascii_]]
    return cp


_FACTOR = hash_stream(max(ORDERS), 7) | U64(1)


def _buckets(cp: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each of the ``len(cp) - order + 1`` positions."""
    n = len(cp) - order + 1
    cp = cp.astype(U64)
    with np.errstate(over="ignore"):
        h = np.full(max(n, 0), U64(order * 0x51ED270B), U64)
        for i in range(order):
            h += cp[i:i + n] * _FACTOR[i]
        return (mix64(h) >> U64(64 - bits)).astype(np.int64)


def _pieces(first: np.ndarray):
    """(row_lo, row_hi, char_lo, char_hi): rows of up to _PIECE characters; a longer row comes in parts."""
    row, n = 0, len(first) - 1
    while row < n:
        end = int(np.searchsorted(first, first[row] + _PIECE, side="right")) - 1
        if end > row:
            yield row, end, int(first[row]), int(first[end])
            row = end
        else:
            for lo in range(int(first[row]), int(first[row + 1]), _PIECE):
                yield row, row + 1, lo, min(lo + _PIECE, int(first[row + 1]))
            row += 1


def _gram_rows(cp: np.ndarray, first: np.ndarray, bits: int):
    """Yield (rows, row pointers, buckets): a sparse count matrix, piece by piece."""
    for row_lo, row_hi, lo, hi in _pieces(first):
        for order in ORDERS:
            # An n-gram belongs to the row it starts in and must end in it.
            reach = min(hi + order - 1, int(first[row_hi]))
            if reach - lo < order:
                continue
            part = cp[lo:reach]
            bucket = _buckets(part, order, bits)
            inner = first[row_lo + 1:row_hi]
            if len(inner) and order > 1:
                keep = np.ones(len(bucket), bool)
                for back in range(1, order):
                    gone = inner - lo - back
                    keep[gone[(gone >= 0) & (gone < len(keep))]] = False
                at = np.flatnonzero(keep)
                bucket = bucket[at]
                ptr = np.searchsorted(at, np.concatenate([[lo], inner]) - lo)
            else:
                ptr = np.concatenate([[lo], inner]) - lo
            yield np.arange(row_lo, row_hi), np.append(ptr, len(bucket)), bucket


def _prepare(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return _code_points(*utf8_buffers(column))


def _row_sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of the slices between row pointers (empty slices are 0)."""
    out = np.zeros((len(ptr) - 1, values.shape[1]), np.float64)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        out[full] = np.add.reduceat(values, ptr[full], axis=0, dtype=np.float32)
    return out


def _labelled(docs: DataFrame, where: Column | None, text_col: str, lang_col: str, id_col: str) -> DataFrame:
    """(lang, text) of all rows with text, id and language (and ``where``)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       (F.lit(True) if where is None else where).alias("use"))
    return rows.where("use and text is not null and lang is not null and id is not null").select("lang", "text")


def train(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang",
          id_col: str = "doc_id", bits: int = 16, alpha: float = 0.5) -> LanguageModel:
    """Fit on all rows of ``docs`` with text, id and language (and ``where``, if given)."""
    def count(batches):
        totals: dict[str, np.ndarray] = {}

        def cells():
            for lang, own in totals.items():
                used = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1)),
                                                  pa.array(np.append(own[used], 0))], names=["lang", "bucket", "n"])
            totals.clear()
        for batch in batches:
            names, code = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            code = code.astype(np.uint16 if len(names) < 1 << 16 else np.int64)  # small numbers sort by radix
            cp, first = _prepare(batch.column("text"))
            for rows_, ptr, bucket in _gram_rows(cp, first, bits):
                own = np.repeat(code[rows_], np.diff(ptr))
                order = np.argsort(own, kind="stable")
                present, at = np.unique(own[order], return_index=True)
                for k, part in zip(present, np.split(bucket[order], at[1:])):
                    totals[names[k]] = totals.get(names[k], 0) + np.bincount(part, minlength=1 << bits)
            for lang in names:  # languages without an n-gram are learned, too
                totals.setdefault(lang, np.zeros(1 << bits, np.int64))
            if len(totals) > HELD_LANGS:
                yield from cells()
        yield from cells()

    rows = _labelled(docs, where, text_col, lang_col, id_col)
    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    counts_of = {}
    # Bounded by languages x buckets, whatever the size of the corpus.
    for row in summed.toLocalIterator():
        dense = np.zeros((1 << bits) + 1, np.float64)
        dense[[c[0] for c in row["cells"]]] = [c[1] for c in row["cells"]]
        counts_of[row["lang"]] = dense
    langs = sorted(counts_of)
    log_prob = np.zeros((1 << bits, len(langs)), np.float32)
    for j, lang in enumerate(langs):
        cells = counts_of[lang][:-1] + alpha
        log_prob[:, j] = np.log(cells / cells.sum())
    # Flat prior: how many documents a language has says nothing about a text.
    return LanguageModel(langs, log_prob, np.zeros(len(langs)), bits)


def score_batch(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """Log-likelihood of every row under every language."""
    cp, first = _prepare(column)
    total = np.tile(model.log_prior, (len(first) - 1, 1))
    for rows, ptr, bucket in _gram_rows(cp, first, model.bits):
        total[rows] += _row_sums(model.log_prob[bucket], ptr)
    return total, np.diff(first)


def n_grams(chars: np.ndarray) -> np.ndarray:
    """N-grams of all orders in a text of so many prepared characters."""
    return sum(np.maximum(chars - k + 1, 0) for k in ORDERS)


def fit_floor(docs: DataFrame, model: LanguageModel, where: Column | None = None, text_col: str = "text", lang_col: str = "lang",
              id_col: str = "doc_id", quantile: float = 0.001, slack: float = 1.4) -> float:
    """Least mean log-probability per n-gram of a text in a learned language.

    The lowest ``quantile`` of all training rows, times ``slack``: letters and letter sequences that no learned
    language has are far below it at any length, short texts of common letters are not.
    """
    rows = _labelled(docs, where, text_col, lang_col, id_col)
    found = predict(rows.select("text"), model, keep=[], fit_col="fit").where(F.col("lang_pred") != UNDETERMINED)
    # Off by at most a millionth of the rows in rank; exact up to a million rows.
    low = found.agg(F.percentile_approx("fit", quantile, 1_000_000)).first()[0]
    return slack * low if low is not None else float("-inf")


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred",
            score_col: str = "score", keep: list[str] | None = None, fit_col: str | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus the predicted language and its posterior; ``fit_col`` names a further
    column for the mean log-probability of the text's n-grams in that language (see ``fit_floor``).

    The posterior is the softmax of the log-likelihood tempered by the square root of the text's
    length: neighbouring n-grams overlap, so their log-odds do not add up as independent ones would.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    # A text column of our own name, so that extra columns cannot clash with it.
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("kept"),
                        F.when(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.col(f"`{text_col}`")).alias("text"))
    kept_type = inner.schema["kept"].dataType.simpleString()

    def run(batches):
        m: LanguageModel = shared.value
        for batch in batches:
            text = batch.column("text")
            n = batch.num_rows
            pred, score, fit = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n)
            known = np.flatnonzero(~np.asarray(text.is_null()))
            if len(known) and m.langs:
                total, chars = score_batch(m, text)
                scaled = total / np.sqrt(np.maximum(chars, 1))[:, None]
                scaled -= scaled.max(axis=1, keepdims=True)
                p = np.exp(scaled)
                p /= p.sum(axis=1, keepdims=True)
                best = total.argmax(axis=1)
                pred[known] = np.array(m.langs, object)[best[known]]
                score[known] = p[known, best[known]]
                fit[known] = total[known, best[known]] / np.maximum(n_grams(chars[known]), 1)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(pred, pa.string()), pa.array(score), pa.array(fit)],
                                             names=["kept", "pred", "score", "fit"])

    out = inner.mapInArrow(run, f"kept {kept_type}, pred string, score double, fit double")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], F.col("pred").alias(pred_col),
                      F.col("score").alias(score_col), *([F.col("fit").alias(fit_col)] if fit_col else []))
