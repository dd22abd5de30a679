"""Row-level helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[str | Column], array: Column | str, pos: str, value: str) -> DataFrame:
    """One row per array element: (keep, pos, value); none for an empty or NULL array.

    The inner ``posexplode`` makes the optimizer infer a filter on the array's size, which it pushes
    below the projection that computes the array, so the array would be computed twice. The outer
    form with a filter on the position computes it once.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
