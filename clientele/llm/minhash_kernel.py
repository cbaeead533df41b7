"""Numpy kernels of the near-duplicate operator: shingle sets and one-permutation signatures."""
from __future__ import annotations

import numpy as np

from .common import U64, hash_stream, mix64

BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
_LOW = U64(0xFFFFFFFF)
# For every bin its own random order in which donors are tried (optimal densification).
_PROBE = np.argsort(hash_stream(BINS * BINS, 31).reshape(BINS, BINS), axis=1)
_BAND_SEED = hash_stream(BANDS, 32)
_ROW_FACTOR = hash_stream(ROWS, 33) | U64(1)
_BIN_SEED = U64(0x5851F42D4C957F2D)


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a non-empty sorted set of 64-bit hashes, empty bins densified."""
    with np.errstate(over="ignore"):
        h = mix64(shingle_set ^ _BIN_SEED)
    bins = ((h >> U64(32)) * U64(BINS)) >> U64(32)
    order = np.argsort(h)  # the bin is monotone in h, so this sorts by (bin, value)
    h, bins = h[order], bins[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out = np.zeros(BINS, U64)
    filled = np.zeros(BINS, bool)
    out[bins[first]] = h[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        probe = _PROBE[empty]
        out[empty] = out[probe[np.arange(len(empty)), filled[probe].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band of a signature matrix (documents x BINS)."""
    with np.errstate(over="ignore"):
        rows = (sig.reshape(-1, BANDS, ROWS) * _ROW_FACTOR).sum(axis=2, dtype=U64)
        return mix64(rows ^ _BAND_SEED)


def set_digest(shingle_set: np.ndarray) -> bytes:
    """128-bit digest that depends on the set alone."""
    with np.errstate(over="ignore"):
        a = mix64(shingle_set + U64(1)).sum(dtype=U64)
        b = mix64(shingle_set * U64(0x2545F4914F6CDD1D) + U64(7)).sum(dtype=U64)
    return np.array([a ^ U64(len(shingle_set)), b], U64).tobytes()


SKETCH_BINS = 1024


def sketch(shingle_set: np.ndarray) -> bytes:
    """One byte per bin of a wide one-permutation hash; 0 marks an empty bin (no densification)."""
    with np.errstate(over="ignore"):
        h = mix64(shingle_set * U64(0xD6E8FEB86659FD93) + U64(11))
    bins = ((h >> U64(32)) * U64(SKETCH_BINS)) >> U64(32)
    order = np.argsort(h)
    h, bins = h[order], bins[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out = np.zeros(SKETCH_BINS, np.uint8)
    out[bins[first]] = (h[first] & _LOW) % U64(255) + U64(1)
    return out.tobytes()


def may_reach(query: np.ndarray, query_n: int, others: np.ndarray, others_n: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``others`` can have Jaccard similarity >= threshold with ``query``.

    Sizes decide exactly (min/max >= threshold is necessary).  The sketch estimate is compared with the
    threshold less 4.5 standard deviations, so that a pair at the threshold is lost with odds below 1e-5;
    one-byte hash clashes only raise the estimate.
    """
    small, large = np.minimum(query_n, others_n), np.maximum(query_n, others_n)
    ok = small >= threshold * large
    at = np.flatnonzero(ok)
    if len(at):
        rows = others[at]
        match = ((rows == query) & (query > 0)).sum(axis=1)
        either = ((rows | query) > 0).sum(axis=1)
        union = (query_n + others_n[at]) / (1 + threshold)
        share = np.clip(1 - either / np.maximum(union, 1), 0.05, 1)
        margin = 4.5 * np.sqrt(threshold * (1 - threshold) / np.maximum(either, 1) * share)
        ok[at] = match >= (threshold - margin) * either
    return ok
