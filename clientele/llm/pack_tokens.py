"""Token ids packed into fixed-length rows by best-fit decreasing.

Every text is encoded by a public byte-level BPE, an end marker is added, and
documents longer than a row are cut into consecutive pieces, so that nothing
is lost.  The pieces of a group of documents are then packed, longest first,
each into the row with the least room that still takes it; rows are found by
their room in a segment tree over the capacities 0..row length.

One pass, no shuffle: a group is what a task has read until it holds
``GROUP_TOKENS`` tokens, so memory is bounded whatever the size of a
partition, and a group of that size leaves little room unused.  The order of
the input is kept from group to group.

Output, one row per packed sequence:
  ids         binary, ``seq_len`` little-endian unsigned integers (2 or 4 bytes, by vocabulary), padded with the end marker
  n_tokens    tokens before the padding
  cu_seqlens  cumulative segment lengths: 0, end of segment 1, ..., n_tokens
  resets      offsets at which the position ids start at 0 again (one per segment)
  doc_ids     document of each segment
  pieces      number of the segment within its document (0 unless it was cut)
``write`` stores this as Parquet; a part file's ``ids`` column is the id
matrix (``matrix``), ``position_ids`` expands the resets.

Defined results: null and empty texts are one end marker; a null id stays
null in ``doc_ids``; repeated rows are packed as often as they occur; an empty
table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ_LEN = 2048
GROUP_TOKENS = 1 << 21
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def make_encoder(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Segment tree over the rooms 0..capacity: how many open rows have each room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, step: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += step
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the least room >= ``least``."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; each length is between 1 and ``capacity``."""
    tree, rows = RoomTree(capacity), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[piece])
        found = tree.take(n) if n < capacity else None
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(piece)
        if room > n:
            tree.put(room - n, row)
    return rows


def _pack(docs: list[tuple], seq_len: int, pad: int, dtype) -> pa.RecordBatch:
    pieces = [(doc_id, k, ids[at:at + seq_len]) for doc_id, ids in docs
              for k, at in enumerate(range(0, len(ids), seq_len))]
    rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), seq_len)
    out = {"ids": [], "n_tokens": [], "cu_seqlens": [], "resets": [], "doc_ids": [], "pieces": []}
    for row in rows:
        row.sort()  # input order inside a row
        segments = [pieces[i] for i in row]
        ends = np.cumsum([len(s[2]) for s in segments])
        line = np.full(seq_len, pad, dtype)
        line[:ends[-1]] = np.concatenate([s[2] for s in segments])
        out["ids"].append(line.tobytes())
        out["n_tokens"].append(int(ends[-1]))
        out["cu_seqlens"].append([0, *ends.tolist()])
        out["resets"].append([0, *ends[:-1].tolist()])
        out["doc_ids"].append([s[0] for s in segments])
        out["pieces"].append([s[1] for s in segments])
    types = (pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN,
         vocabulary: str = VOCABULARY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed sequences of all documents; ``vocabulary`` is read on the driver and broadcast (its size is fixed)."""
    ranks = load_ranks(vocabulary)
    end = len(ranks)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    dtype = np.dtype("<u2" if end < 1 << 16 else "<u4")

    def run(batches):
        encode = make_encoder(shared.value).encode_ordinary
        group, held = [], 0
        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("id").to_pylist()):
                ids = np.array([*encode(texts[i].as_py() or ""), end], dtype)
                group.append((doc_id, ids))
                held += len(ids)
                if held >= group_tokens:
                    yield _pack(group, seq_len, end, dtype)
                    group, held = [], 0
        if group:
            yield _pack(group, seq_len, end, dtype)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "ids binary, n_tokens int, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, pieces array<int>")


def write(packed: DataFrame, path: str) -> None:
    """Store packed sequences as Parquet, one id matrix per part file."""
    packed.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], seq_len: int = SEQ_LEN) -> np.ndarray:
    """(rows, seq_len) id matrix of an ``ids`` column."""
    raw = b"".join(ids)
    return np.frombuffer(raw, "<u2" if not ids or len(ids[0]) == 2 * seq_len else "<u4").reshape(-1, seq_len)


def position_ids(cu_seqlens: list[int], seq_len: int = SEQ_LEN) -> np.ndarray:
    """Position of every token within its segment; the padding is 0."""
    out = np.zeros(seq_len, np.int32)
    for a, b in zip(cu_seqlens[:-1], cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out
