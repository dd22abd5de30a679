"""Distinct questions of a stream by keyed state that expires.

State is a row per question, in the state store of the stream's own checkpoint: a question is passed on when it
has no state, and its state goes a fixed time after it was last seen. So a batch costs what the batch holds, whatever has been
stored before, and the state is bounded by the questions of that time. It is kept in RocksDB, whose
snapshots lie in the checkpoint and outlive lost executors.

A question asked again after its time is new again. Without a time it is kept for good.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
SCHEMA = "question string"


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB and run no batch without data, which would
    never end here, as state may always expire. The session is left as it was: a started stream has its own copy."""
    before = {key: spark.conf.get(key) for key in _SETTINGS}
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class FirstSight(StatefulProcessor):
    """Passes on a key that has no state, and remembers it for ``ttl_ms`` milliseconds from its last sight."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "times bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(r) for r in rows)
        known = self.seen.get() if self.seen.exists() else None
        self.seen.update(((known[0] if known else 0) + n,))
        if known is None:
            yield pd.DataFrame({"question": [key[0]]})

    def close(self) -> None:
        pass


def _once_per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within an Arrow batch go before the exchange: a question that is a third of the stream is a row per batch."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], names=["question"])


def first_seen_questions(stream: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(question): each question of the stream when it is first seen, and again after ``ttl_ms`` without it.

    NULL is a question like any other here; filter it out before if it is none.
    """
    narrow = stream.select("question").mapInArrow(_once_per_batch, SCHEMA)
    return narrow.groupBy("question").transformWithStateInPandas(
        statefulProcessor=FirstSight(ttl_ms), outputStructType=SCHEMA, outputMode="append", timeMode="processingTime" if ttl_ms else "none"
    )


def store_first_seen(stream: DataFrame, path: str, checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Append what :func:`first_seen_questions` passes on to files below ``path``, once each over restarts; nothing stored is read."""
    made = first_seen_questions(stream, ttl_ms)
    with state_settings(stream.sparkSession):
        return (
            made.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
