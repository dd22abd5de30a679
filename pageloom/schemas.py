"""Table layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The project columns that travel with every chunk, in payload order.
METADATA_FIELDS = [
    "Year", "Team_Name", "Wiki", "Region", "Location", "Institution", "Section",
    "Project_Title", "Track", "Abstract", "Parts", "Medal", "Nominations", "Awards",
]


def _field(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType() if name == "Year" else T.StringType())


METADATA = T.StructType([_field(n) for n in METADATA_FIELDS])
PROJECTS = METADATA
PAYLOAD = T.StructType([T.StructField("Wiki_content", T.StringType()), *METADATA.fields])

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

# The field names of stored result files. The hits come in under the store's name.
STORED_HITS = "qdrant_context"
RUN_RESULTS = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("reference_answer", T.StringType()),
    T.StructField("qa_context", T.StringType()),
    T.StructField("qa_meta", METADATA),
    T.StructField("answer", T.StringType()),
    T.StructField(STORED_HITS, T.ArrayType(PAYLOAD)),
    T.StructField("test_settings", T.StringType()),
    T.StructField("eval_score", T.IntegerType()),
])
