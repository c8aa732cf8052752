"""Numeric expressions: half-even rounding, zero-guarded ratios, clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column | str, digits: int) -> Column:
    """Half-even rounding (NumPy / pandas ``round``), not ``round`` (half-up)."""
    return F.bround(F.col(c) if isinstance(c, str) else c, digits)


def guarded_ratio(num: Column | str, den: Column | str, digits: int = 4) -> Column:
    """``num / den`` rounded half-even, 0.0 when ``den`` is 0 or null (never an ANSI error)."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.coalesce(F.bround(F.try_divide(n.cast("double"), d.cast("double")), digits), F.lit(0.0))


def clip_lower(c: Column | str, bound: int | float = 0) -> Column:
    return F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(bound))
