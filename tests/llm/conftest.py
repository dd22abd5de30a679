import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("needs the test tables")
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a documents table with its other columns and one of a clashing name."""

    def build(rows, *names):
        full = [(i, t, "en", "s", None if t is None else len(t), *["clash"] * len(names)) for i, t in rows]
        more = "".join(f", `{n}` string" for n in names)
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{more}")

    return build
