"""Greedy packing of sentences into chunks of a token budget.

A sentence joins the open chunk while tokens + its own + 2 stay within ``chunk_size`` (two places
are kept for the begin and end marks); otherwise the chunk closes and the sentence opens the next.
A sentence over the budget makes a chunk of its own and is never split.

The running total restarts at every chunk, so no window frame expresses it. Two forms:

* :func:`chunk_documents` for texts held in one row each: everything happens inside the row, only
  sentence lengths go to Python, and nothing is shuffled.
* :func:`chunk_sentence_rows` for sentence tables, where one document may hold any share of the
  rows. Long documents are cut into blocks that are packed in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import text as tx
from pageloom.operators.rows import unnest
from pageloom.session import checkpointed

MAX_CHUNK_SIZE = 900
MARKS = 2
BLOCK_ROWS = 20_000

_RANGES = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("n_sentences", T.IntegerType()),
    T.StructField("n_tokens", T.IntegerType()),
]))


def check_chunk_size(chunk_size: int) -> None:
    if not MARKS < chunk_size < MAX_CHUNK_SIZE:
        raise ValueError(f"chunk_size must lie between {MARKS + 1} and {MAX_CHUNK_SIZE - 1}, not {chunk_size}")


def pack(counts: np.ndarray, chunk_size: int, held: int = 0, chunk: int = 0) -> tuple[np.ndarray, int, int]:
    """Chunk number of each sentence, given an open chunk of ``held`` tokens; also the final state."""
    numbers, room = [], chunk_size - MARKS
    for count in counts.tolist():
        if held + count > room:
            chunk += held > 0
            held = 0
        held += count
        numbers.append(chunk)
    return np.array(numbers, dtype=np.int64), held, chunk


def _chunk_bounds(counts: list[int], chunk_size: int) -> list[tuple[int, int, int]]:
    """(start, sentences, tokens) of each chunk; a chunk without tokens is none."""
    bounds, room, start, held = [], chunk_size - MARKS, 0, 0
    for at, count in enumerate(counts):
        if held + count > room:
            if held:
                bounds.append((start, at - start, held))
                start = at
            held = 0
        held += count
    if held:
        bounds.append((start, len(counts) - start, held))
    return bounds


def chunk_ranges(counts: Column, chunk_size: int) -> Column:
    """Array of (start, n_sentences, n_tokens) over an array of sentence token counts."""
    check_chunk_size(chunk_size)

    @F.arrow_udf(_RANGES)
    def ranges(batch: pa.Array) -> pa.Array:
        values = batch.flatten().to_pylist()
        rows, offsets, at = [], [0], 0
        for size in batch.value_lengths().fill_null(0).to_pylist():
            rows += _chunk_bounds(values[at:at + size], chunk_size)
            offsets.append(len(rows))
            at += size
        columns = zip(*rows) if rows else ([], [], [])
        structs = pa.StructArray.from_arrays(
            [pa.array(column, type=pa.int32()) for column in columns], names=["start", "n_sentences", "n_tokens"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), structs)

    return ranges(counts)


def chunk_documents(
    df: DataFrame,
    chunk_size: int,
    keys: list[str],
    text: str = "text",
    count: Callable[[Column], Column] = tx.token_count,
    sentences: Callable[[Column], Column] = tx.split_sentences,
) -> DataFrame:
    """Chunks of each row's text: (keys, chunk_no, n_sentences, n_tokens, sentences).

    Empty and NULL texts give no chunk. ``count`` measures a sentence, ``sentences`` splits a text.
    """
    return chunk_documents_by_size(df, [chunk_size], keys, text, count, sentences).drop("chunk_size")


def chunk_documents_by_size(
    df: DataFrame,
    chunk_sizes: list[int],
    keys: list[str],
    text: str = "text",
    count: Callable[[Column], Column] = tx.token_count,
    sentences: Callable[[Column], Column] = tx.split_sentences,
) -> DataFrame:
    """Chunks of every size, preceded by ``chunk_size``; each text is read, split and measured once."""
    for size in chunk_sizes:
        check_chunk_size(size)
    parts = df.select(*keys, sentences(F.col(text)).alias("parts"))
    measured = parts.withColumn("counts", F.transform("parts", lambda s: count(s).cast("int")))
    ranged = measured.select("*", *[chunk_ranges(F.col("counts"), n).alias(f"ranges_{n}") for n in chunk_sizes])

    # each chunk takes its own sentences along, so that no row repeats the document
    def pieces(size: int) -> Column:
        return F.transform(
            f"ranges_{size}",
            lambda r, i: F.struct(
                F.lit(size).alias("chunk_size"), i.alias("chunk_no"),
                r["n_sentences"].alias("n_sentences"), r["n_tokens"].alias("n_tokens"),
                F.slice("parts", r["start"] + 1, r["n_sentences"]).alias("sentences"),
            ),
        )

    every = F.concat(*[F.coalesce(pieces(n), F.array()) for n in chunk_sizes])
    return unnest(ranged, keys, every, "_at", "r").select(*keys, "r.*")


def chunk_text(sentences: str = "sentences") -> Column:
    """The chunk as one string."""
    return F.array_join(F.col(sentences), " ")


def chunk_sentence_rows(df: DataFrame, chunk_size: int, doc: str, ord: str, n: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``chunk_no`` to a sentence table; ``ord`` counts a document's sentences from 0 without gaps.

    Documents of up to ``block_rows`` sentences are packed in one pass over sorted partitions, many
    documents per Arrow batch and none held in memory. A longer one is cut into blocks of that many
    sentences. A block's effect depends only on how many tokens the chunk open at its start holds,
    at most ``chunk_size`` possibilities, so every block is summarised for all of them at once, the
    summaries of a document are chained (one small row per block), and each block is then packed
    from its now known start. The result is that of one sequential pass.

    The table is written to the checkpoint folder first, as it is read more than once.
    """
    check_chunk_size(chunk_size)
    out = T.StructType([*df.schema.fields, T.StructField("chunk_no", T.LongType())])
    df = checkpointed(df)
    long_docs = df.filter(F.col(ord) >= block_rows).select(doc).distinct()
    if long_docs.isEmpty():
        return _pack_sorted(df, chunk_size, doc, ord, n, out)
    short = df.join(long_docs, doc, "left_anti").select(*df.columns)
    long = df.join(long_docs, doc, "left_semi").select(*df.columns)
    blocks = long.withColumn("block", F.floor(F.col(ord) / block_rows).cast("long"))
    doc_type = df.schema[doc].dataType
    summary_schema = T.StructType([
        T.StructField(doc, doc_type), T.StructField("block", T.LongType()),
        T.StructField("held", T.ArrayType(T.IntegerType())), T.StructField("closed", T.ArrayType(T.LongType())),
    ])

    def summarize_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf.sort_values(ord)[n].to_numpy()
        held, closed = _block_effect(counts, chunk_size)
        return pd.DataFrame({doc: [key[0]], "block": [key[1]], "held": [held], "closed": [closed]})

    start_schema = T.StructType([
        T.StructField(doc, doc_type), T.StructField("block", T.LongType()),
        T.StructField("start_held", T.LongType()), T.StructField("start_chunk", T.LongType()),
    ])

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        held, chunk, rows = 0, 0, []
        for block, ends, closed in zip(pdf["block"], pdf["held"], pdf["closed"]):
            rows.append((key[0], block, held, chunk))
            chunk, held = chunk + int(closed[held]), int(ends[held])
        return pd.DataFrame(rows, columns=[doc, "block", "start_held", "start_chunk"])

    def resume(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ord)
        held, chunk = int(pdf["start_held"].iloc[0]), int(pdf["start_chunk"].iloc[0])
        numbers = pack(pdf[n].to_numpy(), chunk_size, held, chunk)[0]
        return pdf.assign(chunk_no=numbers)[[f.name for f in out.fields]]

    effects = blocks.select(doc, "block", ord, n).groupBy(doc, "block").applyInPandas(summarize_block, summary_schema)
    starts = effects.groupBy(doc).applyInPandas(chain, start_schema)
    packed = blocks.join(starts, [doc, "block"]).groupBy(doc, "block").applyInPandas(resume, out)
    return _pack_sorted(short, chunk_size, doc, ord, n, out).unionByName(packed)


def _pack_sorted(df: DataFrame, chunk_size: int, doc: str, ord: str, n: str, out: T.StructType) -> DataFrame:
    """One pass over partitions sorted by document and order; only the open chunk is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, chunk = None, 0, 0
        for batch in batches:
            docs, counts = batch.column(doc), batch.column(n).to_numpy()
            codes = np.asarray(docs.dictionary_encode().indices)
            cuts = np.flatnonzero(np.diff(codes)) + 1
            numbers = []
            for start, end in zip([0, *cuts], [*cuts, len(counts)]):
                if start == end:
                    continue
                name = docs[int(start)].as_py()
                if name != last:
                    last, held, chunk = name, 0, 0
                part, held, chunk = pack(counts[start:end], chunk_size, held, chunk)
                numbers.append(part)
            added = np.concatenate(numbers) if numbers else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(added, type=pa.int64())], names=[*batch.schema.names, "chunk_no"]
            )

    # by a digest: a shuffle by ``doc`` itself may be left out after a join by it, whose large partitions are then split
    return df.repartition(F.xxhash64(doc)).sortWithinPartitions(doc, ord).mapInArrow(run, out)


def _block_effect(counts: np.ndarray, chunk_size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every possible fill at the start: the fill at the end and the chunks closed on the way.

    A chunk over the budget acts like a full one, so fills stop at ``chunk_size - 1``.
    """
    held = np.arange(chunk_size, dtype=np.int64)
    closed = np.zeros(chunk_size, dtype=np.int64)
    for at, count in enumerate(counts):
        if held[0] == held[-1] and (held == held[0]).all():
            _, end, chunks = pack(counts[at:], chunk_size, int(held[0]))
            return np.full(chunk_size, min(end, chunk_size - 1)), closed + chunks
        over = held + count + MARKS > chunk_size
        closed += over & (held > 0)
        held = np.minimum(np.where(over, count, held + count), chunk_size - 1)
    return held, closed
