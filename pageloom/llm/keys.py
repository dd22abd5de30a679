"""Comparisons of two-part keys with a list of boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The least BIGINT is -SIGN.
SIGN = 1 << 63


def _below(key: tuple[int, int], first: str, second: str) -> Column:
    a, b = key
    if b == -SIGN:
        return F.col(first) < a
    return (F.col(first) < a) | ((F.col(first) == a) & (F.col(second) < b))


def rank_among(bounds: list[tuple[int, int]], first: str, second: str, low: int = 0) -> Column:
    """Number of sorted boundaries at or below (first, second), as a binary tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(_below(bounds[mid], first, second), rank_among(bounds[:mid], first, second, low)).otherwise(
        rank_among(bounds[mid + 1 :], first, second, low + mid + 1)
    )
