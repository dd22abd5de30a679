"""The queries that SQL can express, against DuckDB."""

import pytest

from pageloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query(spark, sf, name):
    import check

    assert check.compare(spark, check.connect(sf), sf, name).startswith("ok")
