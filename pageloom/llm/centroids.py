"""Centroid clustering in whole numbers, with column expressions only.

A vector becomes an array of integers, floor(scale * x). Its squared distance to a centroid is a ``zip_with`` of the
array with the literal centroid and an ``aggregate`` of the squares; ``array_min`` over structs
(distance, cluster number) picks the nearest, the smaller number among equals. Centroids move by one sum per
component in one aggregation: a task sends a row per cluster and no vector is shuffled, so a cluster that holds
most vectors costs no more than another. A round returns ``k`` rows of sums to the driver, which
divides them exactly; the next round's plan holds the new centroids as literals.

Integer vectors are written once to the shared folder, and every round scans that table. All arithmetic is exact
and independent of the order of rows, so results do not depend on partitions, retries or lost executors.

Cases: vectors that are NULL, have another length, or hold a NULL, NaN or infinite component are left out. The first
centroids are the ``k`` vectors whose keys come first in a hash order, or all of them if there are
fewer; rows with one key order by their components, and a NULL key hashes as an empty one. Repeated rows are
vectors each, and equal first centroids are clusters each: the smaller number gets the vectors, the
other stays where it is. An empty table gives no rows. Squares and sums are BIGINT: components beyond about 2 ** 28
after scaling stop with Spark's overflow error rather than wrap. Columns named in ``keep`` pass
through, whatever their names but those this module adds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import scratch_path

ADDED = ["cluster", "distance"]


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x taken as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def is_usable(vector: Column, dims: int) -> Column:
    """The vector has ``dims`` components, none NULL or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def _literal(centroids: list[list[int]]) -> Column:
    """array<struct<cluster, at>>, folded into one literal."""
    one = lambda c: f"array({', '.join(f'{x}L' for x in c)})"
    return F.expr(f"array({', '.join(f'struct({i} AS cluster, {one(c)} AS at)' for i, c in enumerate(centroids))})")


def squared_distance(vector: Column, centroid: Column) -> Column:
    squares = F.zip_with(vector, centroid, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, x: total + x)


def nearest(vector: Column, centroids: list[list[int]]) -> Column:
    """struct<distance, cluster> of the nearest centroid; the smaller number among equals."""
    each = F.transform(_literal(centroids), lambda c: F.struct(squared_distance(vector, c["at"]).alias("distance"), c["cluster"].alias("cluster")))
    return F.array_min(each)


def moved(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Every centroid at the componentwise floor of the mean of its vectors; one without vectors stays."""
    near = vectors.select("vector", nearest(F.col("vector"), centroids)["cluster"].alias("cluster"))
    sums = [F.sum(F.get("vector", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    out = list(centroids)
    for r in near.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


@dataclass
class Clustering:
    """``assigned`` has the kept columns, cluster and distance; ``inertia`` is the sum of distances by cluster."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: dict[int, int]

    def with_figures(self) -> DataFrame:
        """``assigned`` with cluster_inertia, inertia and the digest of the cluster's centroid."""
        figures = [(self.inertia.get(i, 0), centroid_digest(c)) for i, c in enumerate(self.centroids)]
        total = sum(self.inertia.values())
        if not figures:
            added = [F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))]
            return self.assigned.select("*", *added)
        sums = F.expr(f"array({', '.join(f'CAST({n} AS BIGINT)' for n, _ in figures)})")
        digests = F.expr(f"array({', '.join(repr(d) for _, d in figures)})")
        at = F.col("cluster")
        return self.assigned.select(
            "*", F.get(sums, at).alias("cluster_inertia"), F.lit(total).cast("bigint").alias("inertia"), F.get(digests, at).alias("centroid_sha256")
        )


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    rows: DataFrame, key: str, vector: str, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:",
    keep: list[str] | None = None,
) -> Clustering:
    """``rounds`` times assign and move, then assign once more."""
    spark = rows.sparkSession
    kept = [c for c in (keep if keep is not None else [key]) if c not in ADDED]
    usable = rows.filter(is_usable(F.col(vector), dims)).select(
        F.struct(*[F.col(c) for c in kept]).alias("kept"),
        F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256).alias("place"),
        integer_vector(F.col(vector), scale).alias("vector"),
    )
    path = scratch_path(spark, "integer-vectors")
    usable.write.parquet(path)
    vectors = spark.read.schema(usable.schema).parquet(path)
    first = vectors.orderBy("place", "vector").select("vector").limit(k).collect()
    centroids = [list(r["vector"]) for r in first]
    if not centroids:
        return Clustering(vectors.select("kept.*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance")), [], {})
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dims)
    best = nearest(F.col("vector"), centroids)
    path = scratch_path(spark, "assigned-vectors")
    near = vectors.select("kept", best.alias("best")).select("kept.*", "best.cluster", "best.distance")
    near.write.parquet(path)
    assigned = spark.read.schema(near.schema).parquet(path)
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # a row per centroid
    return Clustering(assigned, centroids, {r["cluster"]: r["inertia"] for r in sums})
