"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it.

    A Column is an expression, not a variable: mentioned three times, it is computed three times
    wherever the branches of a ``when`` keep the code generator from sharing it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
