"""Numpy kernels of the repeated-substring operator: range hashes and content-defined anchors."""
from __future__ import annotations

import numpy as np

from .common import U64, hash_stream, mix64

WINDOW = 400  # length of a repeated string, in bytes
GRAM = 64     # bytes hashed at an anchor
BLOCK = 16    # windows examined together in the second tier
_SPAN = WINDOW - GRAM + 1
_PIECE = 1 << 18
_LONGEST = 2 * WINDOW  # longest range that is hashed
_POSITION_BITS = U64(20)
_LOW = (U64(1) << _POSITION_BITS) - U64(1)


def _tables(seed: int):
    """Byte values, powers of an odd base and of its inverse modulo 2**64."""
    n = _PIECE + _LONGEST + 1
    base = int(hash_stream(1, seed)[0]) | 5
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, U64(b), U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return hash_stream(256, seed + 1), *out


_HASHES = (_tables(61), _tables(63))


def _prefix(piece: np.ndarray, which: int) -> np.ndarray:
    value, power, _ = _HASHES[which]
    out = np.zeros(len(piece) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(value[piece] * power[:len(piece)], out=out[1:])
    return out


def _range(prefix: np.ndarray, which: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((prefix[start + length] - prefix[start]) * _HASHES[which][2][start] + length.astype(U64) * U64(0x9E3779B97F4A7C15))


def hash_ranges(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each ``raw[start:start + length]``; lengths up to ``_LONGEST``."""
    out = np.zeros(len(start), U64), np.zeros(len(start), U64)
    order = np.argsort(start, kind="stable")
    ordered = start[order]
    at = 0
    while at < len(order):
        lo = int(ordered[at])
        to = int(np.searchsorted(ordered, lo + _PIECE))
        which = order[at:to]
        piece = raw[lo:lo + _PIECE + _LONGEST]
        for k in (0, 1):
            out[k][which] = _range(_prefix(piece, k), k, start[which] - lo, length[which])
        at = to
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step:width - step + n])


def anchors(raw: np.ndarray, offsets: np.ndarray):
    """Anchors of all windows of the texts in ``raw``.

    The anchor of a window is the leftmost of its GRAM-byte strings with the least hash, so equal windows
    have their anchor at the same place.  Consecutive windows with one anchor form a run.  Returns arrays
    (anchor position, first window, last window, hash of the anchor's string, two hashes of the run's text);
    positions count from the start of ``raw``.
    """
    out = []
    for lo in range(0, max(len(raw) - WINDOW + 1, 0), _PIECE):
        hi = min(lo + _PIECE, len(raw) - WINDOW + 1)  # window starts lo..hi-1
        piece = raw[lo:hi + WINDOW - 1]
        prefix = _prefix(piece, 0)
        n = len(piece) - GRAM + 1
        with np.errstate(over="ignore"):
            gram = (prefix[GRAM:GRAM + n] - prefix[:n]) * _HASHES[0][2][:n]
        tagged = (gram & ~_LOW) | np.arange(n, dtype=U64)
        anchor = (_sliding_min(tagged, _SPAN) & _LOW).astype(np.int64)
        # A window counts if it ends within the text it starts in.
        first_text = int(np.searchsorted(offsets, lo, side="right")) - 1
        last_text = int(np.searchsorted(offsets, hi, side="left"))
        edges = np.clip(offsets[first_text:last_text + 1], lo, hi)
        ends = np.repeat(offsets[first_text + 1:last_text + 1], np.diff(edges))
        start = np.flatnonzero(np.arange(lo, hi) + WINDOW <= ends)
        if not len(start):
            continue
        own = anchor[start]
        new = np.append(True, (own[1:] != own[:-1]) | (np.diff(start) != 1))
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(start)) - 1
        p, first, last = own[begin], start[begin], start[stop]
        length = last - first + WINDOW
        second = _prefix(piece, 1)
        out.append((p + lo, first + lo, last + lo, mix64(gram[p]), _range(prefix, 0, first, length), _range(second, 1, first, length)))
    if not out:
        return (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, U64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*out))


def blocks(p: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Cut runs into blocks of BLOCK windows that are aligned to the anchor.

    Returns (run number, first window, last window, start of the text all windows of the full block share).
    """
    low, high = (p - last) // BLOCK, (p - first) // BLOCK
    count = high - low + 1
    run = np.repeat(np.arange(len(p)), count)
    j = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    return (run, np.maximum(first[run], p[run] - BLOCK * j - BLOCK + 1), np.minimum(last[run], p[run] - BLOCK * j), p[run] - BLOCK * j)


SHARED = WINDOW - BLOCK + 1  # length of the text that all windows of a block share


def merge_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges; touching ranges merge."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return start[new], np.append(stop[:-1][new[1:]], stop[-1])
