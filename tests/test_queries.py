"""Every registered query of the library against its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as spark_entry
from pageloom.registry import oracle
from pageloom.registry.queries import QUERIES

SF = "/root/testdata/sf0.001"
WITHOUT_SQL: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    import check

    return check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) - set(oracle.sql()) == WITHOUT_SQL
    assert set(oracle.sql()) <= set(QUERIES) <= set(spark_entry.queries())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    import check

    assert check.compare(spark, db, SF, name).startswith(("ok", "ROWS"))


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_production_run_reads_whole_texts(spark, monkeypatch):
    from pageloom.registry import data, queries

    class Read(Exception):
        pass

    def stop(spark, path, *args):
        raise Read(path)

    monkeypatch.setattr(queries.dataset, "prepared_dataset", stop)
    with pytest.raises(Read) as met:
        queries.production_run(spark, SF)
    wanted = {int(r["doc_id"]): r["Abstract"] for r in data.projects(spark, SF).collect()}
    found = {int(r["Location"]): r["Abstract"] for r in queries.tables.read_projects(spark, met.value.args[0]).collect()}
    assert max(len(t or "") for t in found.values()) > 200
    assert {i: len(t or "") for i, t in found.items()} == {i: len(t or "") for i, t in wanted.items()}
