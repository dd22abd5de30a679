"""Embeddings: masked mean pooling, and a hashed default model with a plug point for others."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import text as tx


def pooled_vectors(tokens: DataFrame, keys: list[str], vec: str, mask: str, dim: int) -> DataFrame:
    """Masked mean of token vectors: (keys, vector). Rows are (keys, vec, mask).

    One sum per dimension in a single aggregation: partial sums leave each map task as one row per
    key, however many tokens a key has, where exploding the vectors would multiply rows by ``dim``.
    All-masked keys give zeros.
    """
    weight = F.col(mask).cast("double")
    sums = [F.sum(F.get(F.col(vec), F.lit(i)).cast("double") * weight).alias(f"s{i}") for i in range(dim)]
    pooled = tokens.groupBy(*keys).agg(F.sum(weight).alias("weight"), *sums)
    size = F.greatest(F.col("weight"), F.lit(1e-9))
    return pooled.select(*keys, F.array(*[F.col(f"s{i}") / size for i in range(dim)]).alias("vector"))


# digits of a term's MD5 that place it: eight for the bucket, one for the sign
_DIGITS = 9
# terms weighed at a time
POOLED_TERMS = 1 << 17
_HEX = np.zeros(256, dtype=np.int64)
_HEX[np.frombuffer(b"0123456789abcdef", dtype=np.uint8)] = np.arange(16)


def term_digests(terms: Column) -> Column:
    """The leading hexadecimal digits of every term's MD5, in one string."""
    digits = F.transform(terms, lambda term: F.substring(F.md5(term.cast("binary")), 1, _DIGITS))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def _pooled(text: np.ndarray, sizes: np.ndarray, dim: int) -> np.ndarray:
    """Means of rows of ``sizes`` terms, whose digits follow each other."""
    digits = _HEX[text].reshape(-1, _DIGITS)
    bucket = digits[:, :8] @ (16 ** np.arange(7, -1, -1)) % dim
    sign = np.where(digits[:, 8] < 8, 1.0, -1.0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.bincount(rows * dim + bucket, weights=sign, minlength=len(sizes) * dim)
    return sums.reshape(len(sizes), dim) / np.maximum(sizes, 1)[:, None]


def _pooled_batch(batch: pa.Array, dim: int) -> pa.Array:
    """Vectors of a batch; rows of a bounded number of terms, and one row at least, are weighed at a time."""
    _, ends, text = batch.buffers()
    ends = np.frombuffer(ends, dtype=np.int32)[batch.offset:batch.offset + len(batch) + 1].astype(np.int64)
    text = np.frombuffer(text, dtype=np.uint8) if text else np.empty(0, dtype=np.uint8)
    means, at = np.empty((len(batch), dim), dtype=np.float32), 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + POOLED_TERMS * _DIGITS, side="right")) - 1)
        means[at:upto] = _pooled(text[ends[at]:ends[upto]], np.diff(ends[at:upto + 1]) // _DIGITS, dim)
        at = upto
    offsets = pa.array(np.arange(len(batch) + 1) * dim, type=pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(means.ravel(), type=pa.float32()))


def pool_digests(digests: Column, dim: int) -> Column:
    """Mean over the terms of the signed unit vectors their digests stand for; zeros for no terms.

    The first eight digits modulo ``dim`` give the bucket, the ninth the sign (positive below 8).
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def pool(batch: pa.Array) -> pa.Array:
        return _pooled_batch(batch, dim)

    return pool(digests)


def hashed_embedding(text: Column, dim: int = 64, max_terms: int | None = None) -> Column:
    """Feature-hashed embedding of a text, row-local. ``max_terms`` truncates, as queries are."""
    terms = tx.words(text)
    if max_terms is not None:
        terms = F.slice(terms, 1, max_terms)
    return pool_digests(term_digests(terms), dim)


Encoder = Callable[[list[str]], np.ndarray]


def embed_with_model(df: DataFrame, load: Callable[[], Encoder], text: str, into: str = "vector") -> DataFrame:
    """Add ``into`` with any model: ``load`` runs once per task and returns texts -> matrix."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            matrix = np.asarray(encoder(texts), dtype=np.float32).reshape(len(texts), -1)
            vectors = pa.array(list(matrix), type=pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, into])

    return df.mapInArrow(encode, schema)


def encoder_column(load: Callable[[], Encoder]) -> Callable[[Column], Column]:
    """A column function from texts to vectors by any encoder; ``load`` runs once per task, NULL is the empty text."""
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load()
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            matrix = np.asarray(encoder(texts), dtype=np.float32).reshape(len(texts), -1)
            ends = pa.array(np.arange(len(texts) + 1) * matrix.shape[1], type=pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(matrix.ravel(), type=pa.float32()))

    return encode
