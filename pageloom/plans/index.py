"""From a prepared dataset to chunks, vectors and a collection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.operators import chunking, embedding, summarize
from pageloom.operators.collections import Collection, flat_payload, metadata_struct


@dataclass(frozen=True)
class Model:
    """An embedding model by name: its dimension, and how documents and queries become vectors."""

    name: str
    dim: int
    embed: Callable[[Column], Column]
    embed_query: Callable[[Column], Column]


def hashed_model(name: str = "hashed-64", dim: int = 64, max_query_terms: int | None = None) -> Model:
    """The built-in model; texts are taken whole, and queries as well unless ``max_query_terms`` truncates them."""
    return Model(
        name, dim,
        lambda text: embedding.hashed_embedding(text, dim),
        lambda text: embedding.hashed_embedding(text, dim, max_query_terms),
    )


def loaded_model(name: str, dim: int, load: Callable[[], embedding.Encoder], load_query: Callable[[], embedding.Encoder] | None = None) -> Model:
    """Any model as code: ``load`` returns a function from texts to a matrix, once per task.

    ``load_query`` is for models that embed questions in another way, or truncate them.
    """
    return Model(name, dim, embedding.encoder_column(load), embedding.encoder_column(load_query or load))


def chunk_dataset(dataset: DataFrame, key: str, chunk_size: int, text: str = "Wiki_content", count: Callable[[Column], Column] = tx.token_count) -> DataFrame:
    """Chunks of every row's text with the row's metadata: (key, chunk_no, …, sentences, Metadata).

    ``key`` is a unique numeric column. No shuffle: metadata travels in the row it came from.
    """
    return chunking.chunk_documents(
        dataset.withColumn("Metadata", metadata_struct()), chunk_size, [key, "Metadata"], text, count
    )


def summarized_chunks(chunks: DataFrame, id: str = "id", summary: bool = True, keep: str = "Metadata") -> DataFrame:
    """Chunk records (id, Wiki_content, ``keep``); without ``summary`` the chunk text itself stays."""
    if not summary:
        return chunks.select(id, chunking.chunk_text().alias("Wiki_content"), keep)
    short = summarize.summarize_chunks(chunks, [id, keep])
    return short.select(id, F.col("summary").alias("Wiki_content"), keep)


def embedded_points(records: DataFrame, model: Model, id: str = "id") -> DataFrame:
    """Points (id, vector, payload) of chunk records."""
    return records.select(
        F.col(id).alias("id"), model.embed(F.col("Wiki_content")).alias("vector"), flat_payload().alias("payload")
    )


def build_points(dataset: DataFrame, key: str, chunk_size: int, model: Model, id_of: Callable[[Column, Column], Column], summary: bool = True, spread: bool = False) -> DataFrame:
    """Dataset to points: chunk, number, summarise, embed.

    With ``spread`` the chunks are shuffled by id before they are summarised and embedded: for texts of which one
    may be a large share of all, as that of a site, whose chunks would else be one task's.
    """
    chunks = chunk_dataset(dataset, key, chunk_size).withColumn("id", id_of(F.col(key), F.col("chunk_no")))
    if spread:
        chunks = chunks.select("id", "sentences", "Metadata").repartition("id")
    return embedded_points(summarized_chunks(chunks, summary=summary), model)


def store_points(collection: Collection, points: DataFrame, model: Model, mode: str = "production", latest_by: str | None = None) -> None:
    """``production`` keeps an existing collection and upserts; ``evaluation`` replaces it.

    Of several points with one id the one with the greatest ``latest_by`` counts.
    """
    if mode == "evaluation":
        collection.replace(points, model.dim, latest_by)
    elif mode == "production":
        if not collection.exists():
            collection.create(model.dim)
        collection.upsert(points, latest_by)
    else:
        raise ValueError(f"mode must be production or evaluation, not {mode}")
