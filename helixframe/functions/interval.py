"""Predicates and measures on half-open intervals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def touches(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The first holds the second."""
    return (s1 <= s2) & (e2 <= e1)


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def overlaps_by(s1: Column, e1: Column, s2: Column, e2: Column, share: float) -> Column:
    """Overlap beyond a whole-numbered share of the first one's length on either side."""
    o = F.floor((e1 - s1) * F.lit(share))
    return (e2 > s1 + o) & (s2 < e1 - o)


def within(tolerance: float, short: Column, long: Column) -> Column:
    share = float(1 - Decimal(str(tolerance)))  # 1 - 0.95 in binary is more than 0.05, and 5 would not be within it of 100
    return short >= long * F.lit(share)


def ends_close(s1: Column, e1: Column, s2: Column, e2: Column, share: float) -> Column:
    reach = F.floor((e1 - s1) * F.lit(share))
    return (F.abs(s1 - s2) <= reach) & (F.abs(e1 - e2) <= reach)


def elliptically_close(s1: Column, e1: Column, s2: Column, e2: Column, epsilon: float) -> Column:
    ds, de, width = s1 - s2, e1 - e2, (F.greatest(e1, e2) - F.least(s1, s2)) / F.lit(4.0)
    return (ds * ds + de * de) < F.lit(epsilon) * width * width
