"""The additive model: its fit, its scores and its held-out accuracy."""

import zlib

import numpy as np
import pyspark.sql.functions as F

from pageloom.llm import gam, queries


def test_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.95


def test_score_is_a_sum_of_tables():
    rng = np.random.default_rng(1)
    x = np.round(rng.random((500, 2)), 1)
    y = (x.sum(axis=1) > 1).astype(float)
    model = gam.fit(x, y)
    for row in x[:20]:
        total = model.intercept + sum(t[(e <= v).sum()] for t, e, v in zip(model.tables, model.edges, row))
        total += sum(t[(a <= row[i]).sum(), (b <= row[j]).sum()] for (i, j), (a, b, t) in model.pairs.items())
        assert np.isclose(model.log_odds(row[None])[0], total)


def test_degenerate_fits():
    for y in ([], [1.0, 1.0], [0.0]):
        model = gam.fit(np.zeros((len(y), 2)), np.array(y))
        assert 0 < model.score(np.ones((1, 2)))[0] < 1
    assert len(gam.fit(np.zeros((4, 2)), np.array([0.0, 1, 1, 1])).score(np.zeros((1, 2)))) == 1


def test_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, "A good text."), (3, "A good text."), (None, "BAD!! TEXT!!"), (5, "x" * 200000)]
    docs = documents(rows, "score", "y")
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, None), (None, 1), (7, 1), (5, 0)], "doc_id long, quality int")
    scored = gam.with_scores(docs, gam.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 and r["y"] == "clash" for r in scored)
    empty = gam.train(documents([]), labels.limit(0))
    assert gam.with_scores(documents([]), empty).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_quality_gam(spark, sf).collect()
    truth = dict(queries.table(spark, sf, "labels").select("doc_id", "quality").collect())
    assert len(rows) == queries.table(spark, sf, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_labels_of_the_held_out_fold_are_unread(spark, sf):
    docs = queries.table(spark, sf, "documents")
    labels = queries.table(spark, sf, "labels")
    kept = labels.filter(~gam.held_out(F.col("doc_id")))
    flipped = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = gam.train(docs, kept), gam.train(docs, flipped.filter(~gam.held_out(F.col("doc_id"))))
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables))


def test_rows_first_by_hash(spark):
    from pageloom.llm.batches import first_by_hash

    rows = spark.range(50_000).select("id", (F.col("id") * 2).alias("v"))
    place = F.xxhash64("id", F.lit("sample"))
    for n in (100, 20_000, 50_000, 70_000):
        expected = sorted(r["id"] for r in rows.orderBy(place, "id").limit(n).collect())
        assert sorted(r["id"] for r in first_by_hash(rows, ["id"], n, 50_000).collect()) == expected
