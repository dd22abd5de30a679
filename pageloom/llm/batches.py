"""Arrow batches of bounded size for row-local Python work."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows handled at once: short texts in reach of the cache, a few long ones at most.
ROWS = 512
BATCH_ROWS = 512


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ``BATCH_ROWS`` rows: a row here is a whole text.

    The default of 10,000 rows would hold a gigabyte of long texts on either side at once.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def first_by_hash(rows: DataFrame, keys: list[str], n: int, total: int) -> DataFrame:
    """The ``n`` rows that come first in a hash order of their keys (all, if there are fewer); ``total`` rows there are.

    A threshold on the hash leaves little more than ``n`` rows before anything is ordered, so the task that
    ends the ordering reads as much at any size.
    """
    place = F.xxhash64(*keys, F.lit("sample"))
    if total > 2 * n:
        share = min(1.0, (n + 10 * n**0.5 + 10) / total)
        rows = rows.filter(place < F.lit(int(share * (1 << 64)) - (1 << 63)))
    return rows.orderBy(place, *keys).limit(n)


def by_rows(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices; slicing copies nothing."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def add_columns(
    df: DataFrame, text: str, names: dict[str, str], work: Callable[[list], list[pa.Array]], rows: int = ROWS
) -> DataFrame:
    """``df`` with the columns ``names`` (name -> type) that ``work`` makes from a list of texts.

    Row-local: every row passes through with all of its columns; a column of the same name is replaced.
    """
    kept = [c for c in df.columns if c not in names]
    source = df.select(*kept)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema] + [f"`{n}` {t}" for n, t in names.items()])
    place = kept.index(text)

    def run(batches):
        for batch in by_rows(batches, rows):
            made = work(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*kept, *names])

    return bounded(source).mapInArrow(run, schema)
