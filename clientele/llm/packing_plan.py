"""Which lengths share a sequence: dominance reduction, then best-fit decreasing, on counts per length.

Lengths are whole numbers up to the capacity, so a table of pieces of any size
is, for packing, one count per length (4,096 numbers); equal lengths are
interchangeable and every step below handles all their copies at once.

``reduce`` is the reduction of Martello and Toth (Knapsack Problems, 1990,
chapter 8): for a piece j it looks for a set of at most three pieces that
holds j and dominates every other set holding j, that is, some best packing
has that set as one whole sequence.  Removing pieces keeps the premises true,
so a set is fixed for as many copies as there are.
  * nothing fits beside j: {j}
  * j's largest partner fills the sequence, or no two pieces fit beside j: {j, partner}
  * exactly two of the smallest fit: {j, partner} if the partner is at least as long as the best pair;
    {j, a, b} for the best pair a >= b if a is the largest partner and no two pieces longer than b fit.

``best_fit`` is best-fit decreasing on what is left.

A plan is a list of (copies, pattern); a pattern lists (length, pieces of that length) of one sequence.
"""
from __future__ import annotations

from collections import Counter

import numpy as np


def _dominating(count: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """A set holding a piece of length ``j`` that dominates all others, or None; ``count`` is of all pieces."""
    room = capacity - j
    count[j] -= 1
    try:
        fits = np.flatnonzero(count[:room + 1])
        if not len(fits):
            return [j]
        partner = int(fits[-1])
        if partner == room:
            return [j, partner]
        # the three smallest pieces, copies counted
        small = np.repeat(fits[:3], np.minimum(count[fits[:3]], 3))[:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return [j, partner]
        if len(small) == 3 and small.sum() <= room:
            return None
        # best pair a >= b: the largest b that goes with each a
        present = np.where(count[:room + 1] > 0, np.arange(room + 1), 0)
        below = np.maximum.accumulate(present)
        a = fits
        mate = np.minimum(room - a, a)
        b = below[mate]
        own = (b == a) & (count[a] < 2)
        b = np.where(own, below[np.maximum(a - 1, 0)], b)
        total = np.where(b > 0, a + b, 0)
        best = int(total.max())
        if partner >= best:
            return [j, partner]
        if total[-1] != best:
            return None
        low = int(b[-1])
        above = np.flatnonzero(count[low + 1:])[:2] + low + 1
        two = np.repeat(above, np.minimum(count[above], 2))[:2]
        return [j, partner, low] if len(two) < 2 or two.sum() > room else None
    finally:
        count[j] += 1


def reduce(count: np.ndarray, capacity: int) -> tuple[list, np.ndarray]:
    """(fixed sequences, counts of the pieces that are left)."""
    count, fixed, changed = count.copy(), [], True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                chosen = _dominating(count, j, capacity)
                if chosen is None:
                    break
                need = Counter(chosen)
                copies = min(int(count[x]) // k for x, k in need.items())
                for x, k in need.items():
                    count[x] -= k * copies
                fixed.append((copies, sorted(need.items(), reverse=True)))
                changed = True
    return fixed, count


def best_fit(count: np.ndarray, capacity: int) -> list:
    """Best-fit decreasing: each piece, longest first, into the fullest sequence that takes it."""
    open_rows: dict[int, list] = {}
    rooms = np.zeros(capacity + 1, np.int64)

    def put(room, copies, pattern):
        open_rows.setdefault(room, []).append((copies, pattern))
        rooms[room] += copies

    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        for room in (np.flatnonzero(rooms[length:]) + length).tolist():
            # a sequence that took one piece is the fullest that takes the next, as long as there is room
            per = room // length
            waiting = open_rows.pop(room, [])
            rooms[room] = 0
            for copies, pattern in waiting:
                used = min(copies, left // per)
                if used:
                    put(room - per * length, used, [*pattern, (length, per)])
                    left -= used * per
                    copies -= used
                if copies and left:  # fewer than ``per`` pieces are left
                    put(room - left * length, 1, [*pattern, (length, left)])
                    copies, left = copies - 1, 0
                if copies:
                    put(room, copies, pattern)
            if not left:
                break
        per = capacity // length
        if left // per:
            put(capacity - per * length, left // per, [(length, per)])
        if left % per:
            put(capacity - left % per * length, 1, [(length, left % per)])
    return [row for rows in open_rows.values() for row in rows]


def plan(count: np.ndarray, capacity: int) -> list:
    """(copies, pattern) of all sequences for ``count[length]`` pieces of each length 1..capacity."""
    fixed, rest = reduce(count, capacity)
    return fixed + best_fit(rest, capacity)


def places(sequences: list) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: the piece numbers from ``start`` on lie ``per`` to a sequence,
    the first in sequence ``sequence`` from ``offset`` on.  Sorted by (length, start)."""
    rows, taken, sequence = [], Counter(), 0
    for copies, pattern in sequences:
        offset = 0
        for length, per in pattern:
            rows.append((length, taken[length], per, sequence, offset))
            taken[length] += copies * per
            offset += length * per
        sequence += copies
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "per", "sequence", "offset"), rows.T))
