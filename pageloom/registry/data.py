"""Inputs of the registered queries: the given tables, and tables that Spark derives from all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.operators import chunking, embedding
from pageloom.operators.collections import packed_id
from pageloom.schemas import METADATA_FIELDS
from pageloom.sources.tables import spread

DIM = 64
CHUNK_SIZE = 200
# children of a page in the derived site
FAN = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # the tables with long texts
    return spread(rows) if name in ("documents", "pages") else rows


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label) of all embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def marked_text() -> Column:
    """Document text with a tail that reaches every cleaning rule."""
    tail = F.format_string(
        " Read http://host%1$d.example.org/a?b=%1$d now ,or mail user%1$d@example.org [1] [2-4, 7]. "
        "We took %1$d.25mg and %1$d.5e-4 of it [J]. Smith J. Doe 2019 pages %1$d.\nEnd é  by J. D. Roe !",
        F.col("doc_id"),
    )
    return F.concat("text", tail)


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, text) of all documents, cleaned."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", tx.clean_text(F.col("text")).alias("text"))


def document_chunks(spark: SparkSession, sf_dir: str, chunk_size: int = CHUNK_SIZE, keep: list[str] | None = None) -> DataFrame:
    """Chunks of the distinct sentences of every cleaned document, with their point id."""
    chunks = chunking.chunk_documents(
        clean_documents(spark, sf_dir), chunk_size, ["doc_id", *(keep or [])],
        count=tx.cleaned_token_count, sentences=tx.distinct_sentences,
    )
    return chunks.withColumn("id", packed_id(F.col("doc_id"), F.col("chunk_no")))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = document_chunks(spark, sf_dir, keep=["lang"]).withColumn("content", chunking.chunk_text())
    return chunks.withColumn("vector", embedding.hashed_embedding(F.col("content"), DIM))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): every user turn of the conversations."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per document: its metadata columns, in payload order, preceded by doc_id."""
    doc = F.col("doc_id")
    columns = {
        "Year": (2017 + doc % 4).cast("int"),
        "Team_Name": F.concat(F.lit("Team "), doc.cast("string")),
        "Wiki": page_tree_url(doc),
        "Region": F.col("lang"),
        "Location": F.col("source"),
        "Institution": F.concat(F.lit("Institute of "), "source"),
        "Section": F.when(doc % 2 == 0, "Undergrad").otherwise("Overgrad"),
        "Project_Title": F.substring("text", 1, 20),
        "Track": F.upper("lang"),
        "Abstract": F.col("text"),
        "Parts": F.col("n_chars").cast("string"),
        "Medal": F.when(doc % 3 == 0, "Gold").when(doc % 3 == 1, "Silver"),
        "Nominations": F.lit("none"),
        "Awards": F.concat(F.lit("Award "), (doc % 7).cast("string")),
    }
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", *[columns[name].alias(name) for name in METADATA_FIELDS])


def _tree_path(page: Column) -> Column:
    """/Model0/…/Model<page>: the page below its parent (page - 1) div FAN, up to page 0."""
    start = F.struct(page.cast("long").alias("at"), F.lit("").alias("path"))
    parent = lambda at: F.floor((at - 1) / FAN).cast("long")
    step = lambda acc, _: F.when(
        acc["at"] >= 0,
        F.struct(
            F.when(acc["at"] == 0, F.lit(-1).cast("long")).otherwise(parent(acc["at"])).alias("at"),
            F.concat(F.lit("/Model"), acc["at"].cast("string"), acc["path"]).alias("path"),
        ),
    ).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(41)), start, step)["path"]


def page_tree_url(page: Column) -> Column:
    return F.concat(F.lit("http://www.site.example.org"), _tree_path(page), F.lit("/?from=feed"))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as one site: every page keeps its HTML and gains links into a tree over the page ids.

    They are, in order: a grandchild, three children (by path, relative, and by full URL), the
    parent, and links that fail the keyword, the host and the prefix test. Targets beyond the last
    page are missing pages.
    """
    page = F.col("page_id")
    path = _tree_path(page)
    child = lambda n: (page * FAN + n).cast("string")
    below = lambda n: F.concat(path, F.lit("/Model"), child(n))
    grandchild = F.concat(below(1), F.lit("/Model"), ((page * FAN + 1) * FAN + 1).cast("string"))
    hrefs = [
        grandchild,
        F.concat(below(1), F.lit("/")),
        F.concat(F.lit("Model"), page.cast("string"), F.lit("/./Model"), child(2), F.lit("?x=1#top")),
        F.concat(F.lit("HTTP://www.site.example.org"), below(3)),
        F.regexp_replace(path, F.lit("/[^/]*$"), F.lit("")),
        F.concat(path, F.lit("/Other")),
        F.concat(F.lit("//elsewhere.example.org"), below(1)),
        F.concat(F.lit("/Elsewhere"), below(1)),
    ]
    anchors = F.concat(*[F.concat(F.lit('<a href="'), h, F.lit('">next</a> ')) for h in hrefs])
    return table(spark, sf_dir, "pages").select(
        "page_id", page_tree_url(page).alias("url"), F.concat("html", anchors).alias("html")
    )


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded answers: the type names the model, the user the chunk size, the value the score."""
    sizes = F.array(*[F.lit(n) for n in (200, 300, 500, 800)])
    size = F.get(sizes, F.col("user_id") % 4)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("question "), F.col("event_id").cast("string")).alias("question"),
        "props",
        size.alias("chunk_size"),
        F.concat(F.lit("hub/"), "event_type").alias("embedding_model"),
        (F.floor("value") % 6).cast("int").alias("eval_score"),
    )
