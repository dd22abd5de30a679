"""Centroid clustering against plain Python; the query's SQL is in test_sql."""

import hashlib
import math

import pytest

from pageloom.llm import centroids


def plain_clusters(rows, k, rounds, dims):
    """rows: (key, vector). [(key, cluster, distance)], centroids."""
    kept = [(key, [math.floor(256 * x) for x in v]) for key, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda row: (hashlib.sha256(f"2:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1])
    at = [v for _, v in sorted(kept, key=place)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in kept:
            own[near(v)[1]].append(v)
        at = [[sum(x) // len(vs) for x in zip(*vs)] if vs else c for c, vs in zip(at, own)]
    return [(key, near(v)[1], near(v)[0]) for key, v in kept], at


def _rows(n, dims):
    spot = lambda i, j: ((i * 2654435761 + j * 40503 + i * i * j) % 997) / 400 - 1.2
    return [(i, [spot(i, j) for j in range(dims)]) for i in range(n)]


NAN, INF = float("nan"), float("inf")
ODD = [
    (None, [0.1, 0.2, 0.3]), (None, [0.3, 0.2, 0.1]), (500, None), (501, []), (502, [1.0, 2.0]), (503, [1.0, None, 2.0]), (504, [1.0, NAN, 2.0]),
    (505, [INF, 1.0, 2.0]), (506, [1.0, 2.0, -INF]), (507, [1.0, 2.0, 3.0, 4.0]), (7, [-0.0, -0.001, 0.999]), (7, [-0.0, -0.001, 0.999]), (7, [9.0, 9.0, 9.0]),
]
SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("rows, k", [(_rows(120, 3) + ODD, 7), (_rows(5, 3), 9), (ODD, 4), ([(i, [1.0, 1.0, 1.0]) for i in range(30)], 5)])
def test_equals_plain_version(spark, rows, k):
    made = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", k=k, rounds=3, dims=3)
    wanted, at = plain_clusters(rows, k, 3, 3)
    assert made.centroids == at
    got = [(r["vec_id"], r["cluster"], r["distance"]) for r in made.assigned.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(wanted, key=order)
    for r in made.with_figures().collect():
        assert r["cluster_inertia"] == sum(d for _, c, d in wanted if c == r["cluster"]) and r["inertia"] == sum(d for _, _, d in wanted)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()


def test_floats_are_taken_as_doubles(spark):
    rows = [(i, [x, x / 3]) for i, x in enumerate([0.1, 0.2, 0.3, -0.7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    as_read = [(r[0], r[1]) for r in frame.collect()]
    made = centroids.cluster(frame, "vec_id", "embedding", k=2, rounds=2, dims=2)
    assert sorted(tuple(r) for r in made.assigned.collect()) == sorted(plain_clusters(as_read, 2, 2, 2)[0])


def test_empty_and_unusable(spark):
    for rows in ([], [(1, None), (2, [NAN, 1.0])]):
        made = centroids.cluster(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", k=3, rounds=2, dims=2)
        assert made.centroids == [] and made.with_figures().collect() == []
        assert made.with_figures().columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clashing_columns_pass_through(spark):
    names = ["kept", "place", "vector", "best", "at", "cluster", "distance"]
    frame = spark.createDataFrame([(i, v, *["clash"] * len(names)) for i, v in _rows(20, 3)], f"{SCHEMA}, " + ", ".join(f"{n} string" for n in names))
    made = centroids.cluster(frame, "vec_id", "embedding", k=3, rounds=1, dims=3, keep=frame.columns).with_figures()
    rows = made.collect()
    assert len(rows) == 20 and all(r[n] == "clash" for r in rows for n in names[:5])
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in rows} == set(plain_clusters(_rows(20, 3), 3, 1, 3)[0])


def test_no_vector_is_shuffled_and_no_python_runs(spark):
    vectors = spark.createDataFrame([(1, [1, 2])], "kept int, vector array<bigint>")
    near = vectors.select(centroids.nearest(vectors["vector"], [[0, 0], [1, 2]]).alias("best"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert near.first()["best"] == (0, 1)
