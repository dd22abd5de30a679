r"""The text functions for SQL users: ``register(spark)`` makes them temporary functions of the session.

* ``clean_text(text)``, ``split_sentences(text)``, ``sentence_tokens(text)`` (tokens of each sentence) and ``token_count(text)``
  are SQL functions, which the optimizer unfolds into the same expressions as :mod:`pageloom.functions.text`.
* ``packed_chunks(counts, chunk_size)`` is a table function: ``(pos, n, chunk_no)`` of an array of sentence tokens.
  Beside a table it is a lateral join: nothing is shuffled, and no document meets another. Spark wants
  calls of SQL functions in a query of their own below it::

      SELECT doc_id, p.* FROM (SELECT doc_id, sentence_tokens(text) AS counts FROM documents), LATERAL packed_chunks(counts, 200) p

NULL and empty texts stay as they are, have no sentences and give no rows. A chunk size out of bounds or an
argument of another type is an error of the analysis, before any row is read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pageloom.functions import text as tx
from pageloom.operators import chunking


def _raw(pattern: str) -> str:
    """A pattern as a literal whose backslashes stay."""
    assert "'" not in pattern
    return f"r'{pattern}'"


def _escaped(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in chars) + "'"


def _rule(pattern: str, replacement: str, literal: str | None) -> str:
    changed = f"regexp_replace(t, {_raw(pattern)}, '{replacement}')"
    return changed if literal is None else f"CASE WHEN contains(t, '{literal}') THEN {changed} ELSE t END"


def definitions() -> dict[str, str]:
    """Signature and body of every SQL function, in the order they build on each other."""
    found, cleaned = {}, "t"
    for step, rule in enumerate(tx.CLEANING_RULES):
        found[f"cleaning_step_{step}(t STRING) RETURNS STRING"] = _rule(*rule)
        cleaned = f"cleaning_step_{step}({cleaned})"
    found["clean_text(t STRING) RETURNS STRING"] = f"trim({cleaned})"
    blanks = _escaped(tx.BLANKS)
    sentences = f"filter(transform(split(t, {_raw(tx.SENTENCE_END)}), s -> btrim(s, {blanks})), s -> s != '')"
    found["split_sentences(t STRING) RETURNS ARRAY<STRING>"] = sentences
    found["token_count(t STRING) RETURNS INT"] = r"regexp_count(t, r'\S+')"
    found["sentence_tokens(t STRING) RETURNS ARRAY<INT>"] = rf"transform({sentences}, s -> regexp_count(s, r'\S+'))"
    return found


class PackedChunks:
    """Place, tokens and chunk number of each sentence, by the greedy rule of :mod:`pageloom.operators.chunking`."""

    @staticmethod
    def analyze(counts: AnalyzeArgument, chunk_size: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(counts.dataType, T.ArrayType) or not isinstance(counts.dataType.elementType, T.IntegralType):
            raise ValueError("packed_chunks takes an array of whole numbers")
        if not chunk_size.isConstantExpression or not isinstance(chunk_size.value, int):
            raise ValueError("the chunk size must be a constant whole number")
        chunking.check_chunk_size(chunk_size.value)
        return AnalyzeResult(T.StructType([
            T.StructField("pos", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("chunk_no", T.LongType())
        ]))

    def eval(self, counts, chunk_size):
        import numpy as np

        if counts:
            numbers, _, _ = chunking.pack(np.array(counts, np.int64), chunk_size)
            yield from zip(range(len(counts)), counts, numbers.tolist())


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL; calling it again changes nothing."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udtf.register("packed_chunks", udtf(PackedChunks))
