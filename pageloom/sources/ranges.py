"""Large files of one JSON array each, read by many tasks.

An array without line breaks cannot be split where a byte range begins: the byte may lie inside a string, after
a backslash, or at any depth. So a file is read twice in ranges. The first pass (the data source
``json_array_ranges``) says for each range, and for each state it may begin in, in which state it ends and by how much the depth
changes; folding these few numbers in file order gives the state at the head of every range. In the second
pass each range yields the records that begin in it, and reads on to the end of its last one.

A record is an object or array directly inside the file's array; other elements give no row. A last record
that the file breaks off is returned as far as it goes. A file that does not begin with an array is an error;
an empty one has no records. Paths are those of pyarrow file systems (plain paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``),
and every executor must reach them.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pageloom.session import checkpointed

RANGE_BYTES = 64 << 20
PIECE = 1 << 20
MAX_TASKS = 100_000
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2  # of a string; after a backslash in one
_RANGES = "file string, start bigint, stop bigint, ends array<int>, depths array<bigint>"
_PLACED = "file string, start bigint, stop bigint, state int, depth bigint"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else path
    return fs.FileSystem.from_uri(path)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at and below ``path``; names that begin with a dot or underscore are skipped."""
    system, own = _opened(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    scheme = urlparse(path).scheme
    prefix = f"{scheme}://" if scheme else ""
    found = [i for i in system.get_file_info(fs.FileSelector(own, recursive=True)) if i.type == fs.FileType.File]
    hidden = lambda i: any(p[:1] in "._" for p in i.path[len(own.rstrip("/")) :].strip("/").split("/"))
    return sorted((prefix + i.path, i.size) for i in found if not hidden(i))


def _pieces(path: str, start: int, stop: int | None = None, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) from ``start`` to ``stop`` or the end of the file."""
    system, own = _opened(path)
    with system.open_input_file(own) as source:
        source.seek(start)
        while stop is None or start < stop:
            data = source.read(min(size or PIECE, stop - start) if stop is not None else size or PIECE)
            if not data:
                return
            yield start, data
            start += len(data)


def structure(codes: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets outside strings, +1 or -1 each, state after the bytes) for bytes that begin in ``state``."""
    place = np.arange(len(codes))
    slash = codes == 0x5C
    if state == ESCAPED:
        slash[:1] = False
    run = place - np.maximum.accumulate(np.where(slash, -1, place))  # backslashes up to here
    escaped = np.concatenate([[state == ESCAPED], run[:-1] % 2 == 1])
    quote = (codes == 0x22) & ~escaped
    inside = (np.cumsum(quote) + (state != OUTSIDE)) % 2 == 1
    up, down = (codes == 0x7B) | (codes == 0x5B), (codes == 0x7D) | (codes == 0x5D)
    at = np.flatnonzero((up | down) & ~inside)
    end = (ESCAPED if run[-1] % 2 == 1 else INSIDE) if inside[-1] else OUTSIDE
    return at, np.where(up[at], 1, -1), end


def summary(pieces: Iterator[bytes]) -> tuple[list[int], list[int]]:
    """For each state that some bytes may begin in: the state they end in, and the change of depth."""
    ends, depths = [OUTSIDE, INSIDE, ESCAPED], [0, 0, 0]
    for data in pieces:
        codes = np.frombuffer(data, np.uint8)
        found = {s: structure(codes, s) for s in set(ends)}  # soon two states are left
        depths = [d + int(found[s][1].sum()) for s, d in zip(ends, depths)]
        ends = [found[s][2] for s in ends]
    return ends, depths


def records(pieces: Iterator[tuple[int, bytes]], stop: int, state: int, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that begin before ``stop``; ``pieces`` may go on beyond it."""
    skip, held, parts = depth >= 2, None, []
    for at, data in pieces:
        place, step, state = structure(np.frombuffer(data, np.uint8), state)
        after = depth + np.cumsum(step)
        depth = int(after[-1]) if len(after) else depth
        starts, ends = place[(step > 0) & (after == 2)], place[(step < 0) & (after == 1)] + 1
        if held is not None:
            if not len(ends):
                parts.append(data)
                continue
            yield held, b"".join([*parts, data[: ends[0]]])
            held, ends = None, ends[1:]
        elif skip and len(ends):
            skip, ends = False, ends[1:]
        for s, e in zip(starts.tolist(), ends.tolist()):
            if at + s >= stop:
                return
            yield at + s, data[s:e]
        if len(starts) > len(ends):
            held, parts = at + int(starts[-1]), [data[starts[-1] :]]
        if at + len(data) >= stop and (held is None or held >= stop):
            return
    if held is not None and held < stop:
        yield held, b"".join(parts)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        super().__init__((file, start, stop))


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        return [
            _Range(file, at, min(at + self.size, n)) for file, n in list_files(self.path) for at in range(0, n, self.size)
        ] or [_Range("", 0, 0)]

    def read(self, partition):
        file, start, stop = partition.value
        if not file:
            return
        if start == 0:
            head = next(_pieces(file, 0, size=4096))[1].removeprefix(b"\xef\xbb\xbf").lstrip()
            if head and not head.startswith(b"["):
                raise ValueError(f"{file} does not begin with an array")
        ends, depths = summary(data for _, data in _pieces(file, start, stop))
        yield file, start, stop, ends, depths


class ArrayRanges(DataSource):
    """Byte ranges of the files below a path with what each does to the state of a reader; option ``rangeBytes``."""

    @classmethod
    def name(cls):
        return "json_array_ranges"

    def schema(self):
        return _RANGES

    def reader(self, schema):
        return _RangeReader(self.options)


def _heads(rows: pd.DataFrame) -> pd.DataFrame:
    """The state and depth at the head of each range of one file: a few numbers a range."""
    rows = rows.sort_values("start")
    state, depth, states, level = OUTSIDE, 0, [], []
    for ends, depths in zip(rows["ends"], rows["depths"]):
        states.append(state)
        level.append(depth)
        state, depth = int(ends[state]), depth + int(depths[state])
    return rows[["file", "start", "stop"]].assign(state=states, depth=level)


def read_array_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, offset, value): the records of all array files at and below ``path``, a task for each range."""
    spark.dataSource.register(ArrayRanges)
    ranges = spark.read.format("json_array_ranges").option("rangeBytes", range_bytes).load(path)
    heads = checkpointed(ranges.groupBy("file").applyInPandas(_heads, _PLACED))  # the first pass runs once
    tasks = max(1, min(heads.count(), MAX_TASKS))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                held, size = [], 0
                for offset, value in records(_pieces(r["file"], r["start"]), r["stop"], r["state"], r["depth"]):
                    held.append((offset, value.decode("utf-8", "replace")))
                    size += len(value)
                    if size >= PIECE:
                        yield _rows(r["file"], held)
                        held, size = [], 0
                if held:
                    yield _rows(r["file"], held)

    # the number is given, so that adaptive execution does not join the few bytes that name the ranges into one task
    return heads.repartition(tasks, F.xxhash64("file", "start")).mapInArrow(run, "file string, offset bigint, value string")


def _rows(file: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
    offsets, values = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(held)), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=["file", "offset", "value"]
    )
