r"""Substring deduplication by hashing normalised units.

A text is cut into units: lines, paragraphs or, by default, sentences within lines, which also finds a
passage that was pasted into a longer line. A unit is normalised (lower case, letters and digits alone,
single blanks) and named by a 128-bit digest. Digests are grouped over all documents, and the earliest
occurrence, by document id and then offset, is the one to keep; any other occurrence repeats it.
Consecutive repeating units of a document form a run, and a run of at least ``min_words`` words is
removed. Offsets are code points of the original text, end exclusive.

Grouping is a minimum taken in the tasks before the shuffle, so a line that a third of all documents hold
costs one row per task there. Only digests that occur more than once are joined back, and that join has one
row per digest on its other side, so Spark can split a hot digest's partition.

Cases: a NULL or empty text has no units; a unit without letters or digits is none, and does not break a
run; a repeat inside one document is a repeat; rows with the same id and text are the same document
and keep their copy together, rows with the same id and another text are ranked by offset alone, and
of equal ranks all are kept; a NULL id ranks first; an empty table gives no rows. Columns other than id
and text are carried by :func:`without_repeats`; names it adds replace theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.arrays import match_spans
from pageloom.session import checkpointed

UNITS = {
    "sentence": r"[^.!?\n]+[.!?]*",
    "line": r"[^\n]+",
    "paragraph": r"(?:[^\n]|\n(?![ \t\r]*\n))+",
}
_SPAN = 1 << 31


def normalised(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))


def units_of(docs: DataFrame, unit: str = "sentence", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, ord, start, end, words, h1, h2): the units of each text, numbered from 0.

    ``row`` tells texts under one id apart; h1 and h2 are the digest.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    spans = F.transform(
        match_spans(said, UNITS[unit]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), normalised(s["hit"]).alias("norm")),
    )
    real = F.filter(spans, lambda s: s["norm"] != "")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(said).alias("row"), F.posexplode_outer(real).alias("ord", "u")
    ).filter("ord IS NOT NULL")
    norm = F.col("u.norm")
    words = F.char_length(norm) - F.char_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1
    return rows.select(
        "doc_id", "row", "ord", "u.start", "u.end", words.alias("words"),
        F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(1), norm).alias("h2"),
    )


def _rank() -> Column:
    """Document id, then offset, in one number that aggregates without sorting."""
    wide = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).cast("decimal(20,0)")
    return (wide * F.lit(_SPAN).cast("decimal(11,0)") + F.col("start")).cast("decimal(38,0)")


def repeated_spans(
    docs: DataFrame, unit: str = "sentence", min_words: int = 10, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, row, start, end, n_units, n_words, kept_doc_id): the runs to remove.

    ``kept_doc_id`` is the document that keeps the run's first unit.
    """
    units = units_of(docs, unit, text, doc_id)
    first = units.groupBy("h1", "h2").agg(F.min(_rank()).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # written, so that both sides of the join are plain exchanges, which Spark can split at a hot digest
    first = checkpointed(first.drop("copies"))
    known = units.join(first, ["h1", "h2"]).filter(_rank() > F.col("first"))
    # equal rows of one document repeat each other's units at the same place
    once = known.groupBy("doc_id", "row", "ord").agg(
        F.min("start").alias("start"), F.min("end").alias("end"), F.min("words").alias("words"), F.min("first").alias("first")
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("ord"))
    runs = once.withColumn("run", F.col("ord") - place).groupBy("doc_id", "row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"),
        F.sum("words").cast("long").alias("n_words"), F.min_by("first", "ord").alias("first"),
    )
    kept = F.floor(F.col("first") / F.lit(_SPAN).cast("decimal(11,0)")).cast("long")
    return runs.filter(F.col("n_words") >= min_words).select(
        "doc_id", "row", "start", "end", "n_units", "n_words", F.nullif(kept, F.lit(-(1 << 63))).alias("kept_doc_id")
    )


def without_repeats(
    docs: DataFrame, unit: str = "sentence", min_words: int = 10, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` with the repeats cut out of the text, and ``removed``: array<struct<start,end>> in the original."""
    spans = repeated_spans(docs, unit, min_words, text, doc_id)
    cuts = spans.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")
    )
    rows = docs.drop("removed")
    met = rows.join(
        cuts, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_row")), "left"
    )
    removed = F.coalesce("_cuts", F.array().cast("array<struct<start:int,end:int>>"))
    before = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s["end"]))
    stops = F.concat(F.transform(removed, lambda s: s["start"]), F.array(F.char_length(text)))
    rest = F.array_join(F.zip_with(before, stops, lambda a, b: F.substring(F.col(text), a + 1, b - a)), "")
    fresh = F.when(F.size(removed) > 0, rest).otherwise(F.col(text))
    return met.select(*[fresh.alias(c) if c == text else F.col(c) for c in rows.columns], removed.alias("removed"))
