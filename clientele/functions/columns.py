"""Column expressions shared by the plans.  All are built-in Spark
expressions: nothing here leaves whole-stage codegen."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: Column | str) -> Column:
    return col(c).cast("double")


def round6(c: Column | str) -> Column:
    """Doubles leave the library rounded to 6 places (sums of doubles
    depend on addition order, so raw bits are not stable across engines)."""
    return F.round(as_double(c), 6)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Zero-safe division as DOUBLE (F19): ``num / nullif(den, 0)``."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def pct_rounded(num: Column | str, den: Column | str, places: int = 1) -> Column:
    """``round(100·num/den, places)`` computed on integers, half-up.

    Counts in, exact decimal rounding out: no binary-float tie can round
    differently between engines.  Null when ``den`` is 0.
    """
    scale = 10 ** (places + 2)
    n, d = col(num).cast("long"), F.nullif(col(den).cast("long"), F.lit(0))
    units = F.floor((F.lit(2) * n * F.lit(scale) + d) / (F.lit(2) * d))
    return units.cast("double") / F.lit(float(10 ** places))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole 24-hour blocks from ``start`` to ``end`` (pandas ``.dt.days``),
    not calendar-midnight crossings."""
    return F.timestamp_diff("DAY", col(start), col(end))


def year_month(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def month_index(first: Column | str, later: Column | str) -> Column:
    """``(y2 - y1)·12 + (m2 - m1)`` between two timestamps' months."""
    a, b = col(first), col(later)
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))


def seeded_key(id_col: Column | str, seed: int) -> Column:
    """Hash-stable pseudo-random order key: ``md5(id ‖ seed)``.

    The same value in every engine and every retry, unlike ``rand()``.
    """
    return F.md5(F.concat(col(id_col).cast("string"), F.lit(str(seed))))


def band_index(x: Column | str, edges: Sequence[float], right_closed: bool = True) -> Column:
    """0-based bin of ``x`` for cut points ``edges`` (``pd.cut`` semantics
    when right-closed: ``(e0, e1], (e1, e2], …``; the last edge may be
    ``inf``).  Values outside every bin give null."""
    v = col(x)
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        if right_closed:
            cond = v > F.lit(lo)
            if hi != float("inf"):
                cond = cond & (v <= F.lit(hi))
        else:
            cond = v >= F.lit(lo)
            if hi != float("inf"):
                cond = cond & (v < F.lit(hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def quartile_by_rank(rn: Column | str, n: Column | str, q: int = 4) -> Column:
    """``qcut(rank(method='first'), q)`` score (1..q) from a 1-based row
    number among ``n`` rows: ``ceil(q·(rn-1)/(n-1))``, at least 1.

    Integer arithmetic only.  This is *not* ``ntile``: it differs whenever
    ``n`` is not a multiple of ``q``.
    """
    r, m = col(rn).cast("long"), col(n).cast("long")
    den = F.nullif(m - 1, F.lit(0))
    score = F.floor((F.lit(q) * (r - 1) + den - 1) / den)
    return F.greatest(F.lit(1), F.coalesce(score, F.lit(1))).cast("int")


def translate(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """look a value up in a small literal map, passing unknown values
    through unchanged (``dict.get(v, v)``)."""
    if not mapping:
        return col(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, col(c)), col(c))


def format_rate(x: Column | str) -> Column:
    """``0.1234 → '12.3%'``."""
    return F.format_string("%.1f%%", as_double(x) * 100)


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """``min(max(x, lo), hi)``."""
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def nan_to_null(x: Column | str) -> Column:
    """JSON cleaning: NaN / ±inf become null."""
    v = as_double(x)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)
