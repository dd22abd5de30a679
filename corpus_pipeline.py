"""A training corpus from raw documents: five stages, each a call of one operator.

Every stage is (spark, docs, sf_dir) -> DataFrame. Between stages the rows are written as Parquet below the
shared folder and read again, so a stage survives lost executors and its plan starts from files.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.

* quality: documents that the additive model scores below one half go. It learns from ``labels``
  outside the held-out fold.
* near_duplicates: one document of each SimHash component stays, the one with the least id.
* decontamination: passages of ``benchmark`` items are cut out of the text.
* secrets: reported credential spans are masked in the text.
* tokens: each text becomes the ids of the vocabulary.

Cases: NULL and empty texts are documents like any other (the quality model judges the empty text); of
repeated rows one stays; empty tables give no rows. Columns besides doc_id and text pass through with their values, whatever
their names: a stage sees them under names of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, credentials, decontamination, gam, simhash
from pageloom.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def _apart(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on rows whose columns besides doc_id and text have names that no operator adds; names and order are restored."""
    own = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*own)).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~gam.held_out(F.col("doc_id")))
    model = gam.train(docs, labels)
    return _apart(docs, lambda rows: gam.with_scores(rows, model).filter(F.col("score") >= 0.5))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of 3 words, at most 3 differing bits."""
    return simhash.one_per_component(docs, width=3, distance=3)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of any benchmark passage of 10 words."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(_apart(docs, lambda rows: decontamination.remove_spans(decontamination.find_contamination(rows, items))))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every reported credential span masked."""
    def masked(rows: DataFrame) -> DataFrame:
        return credentials.scan_credentials(rows).withColumn("text", credentials.redacted(F.col("text"), F.col("findings")))

    return _measured(_apart(docs, masked))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids)."""
    encoded = bpe.with_ids(docs, bpe.read_ranks(VOCABULARY), PATTERN, keep=["doc_id", "lang", "source", "n_chars"])
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_copy),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

# The stages' methods (a boosted model, XXH64 fingerprints, ranked merges) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
