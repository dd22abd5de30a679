"""Project tables, stored pages and stage tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import urls
from pageloom.schemas import PROJECTS


def read_projects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Project CSV with a header; columns are taken by name, in any order.

    ``multi_line`` admits line breaks inside quotes at the price of one task per file; switch it
    off for large files without such breaks, which Spark can then split.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    present = set(raw.columns)
    columns = [
        (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in PROJECTS.fields
    ]
    return raw.select(*columns)


def write_projects(projects: DataFrame, path: str) -> None:
    """Project CSV sink; values keep their outer blanks."""
    projects.write.csv(
        path, mode="overwrite", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def of_year(projects: DataFrame, year: int = 2019) -> DataFrame:
    """Projects of one year; the filter reaches the scan."""
    return projects.filter(F.col("Year") == year)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Stage-table sink."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Stage-table scan."""
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that fits into fewer partitions than there are cores.

    For costly row-local work on a small file. A table with at least as many partitions as cores, as
    any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A completed write is there: a stage that died half-way has left no success marker."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is missing."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*")
    found = location.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(location)
    return [f.getPath().getName() for f in found or [] if f.isDirectory()]


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or no rows of ``schema`` when there is none yet."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def materialize_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write the stage table unless an earlier run has; then scan it."""
    if not table_exists(spark, path):
        write_table(build(), path)
    return read_table(spark, path)


def has_rows(df: DataFrame) -> bool:
    """The table holds at least one row; reads no more than it must."""
    return not df.isEmpty()


def fetch_pages(wanted: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Stored pages for the wanted URLs; a URL with no stored page contributes no row.

    Adds ``page_url`` (the key both sides meet on), ``page_id`` and ``html``.
    """
    stored = keyed_pages(pages).select("page_url", "page_id", "html")
    return wanted.withColumn("page_url", urls.page_key(F.col(url))).join(stored, "page_url")


def keyed_pages(pages: DataFrame) -> DataFrame:
    """Pages under their canonical URL, one row each: the lowest page_id, and of equal ids one by a hash of the page.

    Only URLs with several rows have their page bodies grouped.
    """
    keyed = pages.withColumn("page_url", urls.page_key(F.col("url")))
    several = keyed.groupBy("page_url").agg(F.count("*").alias("copies")).filter("copies > 1").select("page_url")
    least = F.min_by(F.struct(*keyed.columns), F.struct("page_id", F.xxhash64("html"))).alias("p")
    chosen = keyed.join(several, "page_url", "left_semi").groupBy("page_url").agg(least).select("p.*")
    # a NULL key matches nothing and stays, as its pages are no copies of each other
    return keyed.join(several, "page_url", "left_anti").unionByName(chosen)
