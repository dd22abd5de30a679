"""The functions for SQL against the column expressions."""

import pytest
from pyspark.sql import functions as F

from pageloom.functions import sql
from pageloom.functions import text as tx
from pageloom.operators import chunking

TEXTS = [
    "See http://x.org/a ,or mail a@b.org [1] [2-4, 7]. We took 2.25mg of it [J]. Dr. Roe said so? Yes.  x.y. z",
    "é only\t\ttabs\x85 and 　 blanks \x1c. End", "it's 'quoted' \\ back", "", " ", None, "word " * 700,
]


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(spark)
    sql.register(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").createOrReplaceTempView("sql_texts")
    return spark.table("sql_texts")


def test_functions_equal_the_expressions(spark, texts):
    got = spark.sql("SELECT id, clean_text(t) a, split_sentences(t) b, token_count(t) c, sentence_tokens(t) d FROM sql_texts")
    t = F.col("t")
    tokens = F.transform(tx.split_sentences(t), tx.token_count)
    wanted = texts.select("id", tx.clean_text(t).alias("a"), tx.split_sentences(t).alias("b"), tx.token_count(t).alias("c"), tokens.alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_table_function(spark, texts):
    got = spark.sql("SELECT id, p.* FROM (SELECT id, sentence_tokens(t) AS counts FROM sql_texts), LATERAL packed_chunks(counts, 9) p").collect()
    for i, counts in texts.select("id", F.transform(tx.split_sentences(F.col("t")), tx.token_count)).collect():
        own = sorted((r["pos"], r["n"], r["chunk_no"]) for r in got if r["id"] == i)
        numbers = chunking.pack(__import__("numpy").array(counts or [], int), 9)[0].tolist()
        assert own == list(zip(range(len(counts or [])), counts or [], numbers))


@pytest.mark.parametrize("call,message", [
    ("counts, 2", "chunk_size must lie"), ("id, 9", "array of whole numbers"), ("counts, id", "constant"),
])
def test_wrong_arguments_fail_early(spark, texts, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM (SELECT id, sentence_tokens(t) AS counts FROM sql_texts), LATERAL packed_chunks({call}) p").schema


def test_no_shuffle_and_no_python_for_cleaning(spark, texts):
    plan = spark.sql("SELECT clean_text(t) FROM sql_texts")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "regexp_replace" in plan
