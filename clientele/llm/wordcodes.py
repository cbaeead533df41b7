"""Words of a batch of texts as codes into a dictionary of its distinct words.

Unlike ``TextBatch`` this is exact (no hashing): Arrow's own dictionary
encoder compares the words' bytes.  Byte positions are worked out in chunks of
``PIECE_BYTES``, so that temporaries stay a small multiple of the text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import LOWER, PIECE_BYTES, utf8_buffers


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Word bytes: all but the closed ranges given."""
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo:hi + 1] = False
    return table


def _chunks(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Byte ranges of about PIECE_BYTES that end between two words."""
    lo, total = 0, len(raw)
    while lo < total:
        hi = min(total, lo + PIECE_BYTES)
        if hi < total:
            end = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            if end > lo:
                hi = end
            else:  # inside one long text
                text_end = int(offsets[np.searchsorted(offsets, lo, side="right")])
                while hi < text_end and is_word[raw[hi - 1]]:
                    hi += 1
        yield lo, hi
        lo = hi


class WordCodes:
    """``codes``: one number per word; ``words``: the distinct words (binary); ``start``: byte position of every
    word in ``raw``; ``first``: text ``i`` owns words ``first[i]:first[i + 1]``."""

    def __init__(self, column, is_word: np.ndarray, lower: bool = True):
        self.raw, self.offsets = utf8_buffers(column)
        starts, arrays = [], []
        for lo, hi in _chunks(self.raw, self.offsets, is_word):
            raw = self.raw[lo:hi]
            inside = is_word[raw]
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            cut = self.offsets[np.searchsorted(self.offsets, lo):np.searchsorted(self.offsets, hi)] - lo
            begins[cut] = inside[cut]
            first = np.flatnonzero(begins[at])
            data = raw[at]
            if lower:
                data = LOWER[data]
            ends = np.append(first, len(at)).astype(np.int64)
            arrays.append(pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]))
            starts.append(at[first] + lo)
        if arrays:
            coded = pc.dictionary_encode(pa.chunked_array(arrays)).unify_dictionaries()
            self.words = coded.chunk(0).dictionary
            self.codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
            self.start = np.concatenate(starts)
        else:
            self.words = pa.array([], pa.large_binary())
            self.codes = self.start = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)

    def doc(self) -> np.ndarray:
        """Number of the text every word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def run_sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and, for each array of values, its sum per key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def text_column(words: pa.Array) -> pa.Array:
    """Binary words as an Arrow string column (words never cut a UTF-8 character: their edges are ASCII)."""
    return words.cast(pa.large_string()).cast(pa.string())


class TableSums:
    """Rows of a task, pre-aggregated in bounded memory: equal keys are summed whenever ``limit`` rows are held."""

    def __init__(self, keys: list[str], sums: list[str], limit: int = 1 << 20):
        self.keys, self.sums, self.limit = keys, sums, limit
        self.parts, self.rows = [], 0

    def add(self, table: pa.Table):
        """Take rows in; returns a table to give out when even the summed rows exceed the limit, else None."""
        self.parts.append(table)
        self.rows += table.num_rows
        if self.rows <= self.limit:
            return None
        held = self.take()
        if held.num_rows > self.limit // 2:
            return held
        self.parts, self.rows = [held], held.num_rows
        return None

    def take(self) -> pa.Table | None:
        """All rows held, summed by key; None if there are none."""
        if not self.parts:
            return None
        table = pa.concat_tables(self.parts)
        self.parts, self.rows = [], 0
        columns = table.column_names
        # In this thread only: Arrow would take a thread per core of the machine, each with its own table of keys.
        out = table.group_by(self.keys, use_threads=False).aggregate([(c, "sum") for c in self.sums])
        del table
        # Arrow keeps what it freed; a worker outlives its task and counts beside the executor's heap.
        pa.default_memory_pool().release_unused()
        return out.rename_columns([c[:-4] if c.endswith("_sum") else c for c in out.column_names]).select(columns)


def batches_of(table: pa.Table | None, rows: int = 1 << 16):
    """Record batches of a table, in slices that keep a batch's strings far below Arrow's 2 GB."""
    if table is not None:
        yield from table.combine_chunks().to_batches(max_chunksize=rows)
