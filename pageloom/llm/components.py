"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every end of an edge; ``edges`` has two BIGINT columns a and b.

    Each round every vertex steps to the least of itself and its neighbours, in an order that a
    random mask shuffles anew, and the edges follow. Two neighbours step to the same or to
    neighbouring vertices, so a component stays whole while its vertices shrink by about a half, on
    long chains as well. All rounds are checkpointed; minima are taken before the shuffle, so a vertex
    with very many neighbours costs one row per task.
    """
    rng = random.Random(0)
    left = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    ends = left.select(F.col("a").alias("vertex")).union(left.select("b")).distinct()
    roots = checkpointed(ends.select("vertex", F.col("vertex").alias("root")))
    while not left.isEmpty():
        mask = F.lit(rng.getrandbits(64) - (1 << 63))
        both = left.union(left.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("least"))
        steps = checkpointed(near.select(
            F.col("a").alias("was"), F.least("least", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("now")
        ))
        roots = checkpointed(
            roots.join(steps, roots["root"] == steps["was"], "left").select("vertex", F.coalesce("now", "root").alias("root"))
        )
        moved = left.join(steps.withColumnsRenamed({"was": "a", "now": "na"}), "a")
        moved = moved.join(steps.withColumnsRenamed({"was": "b", "now": "nb"}), "b")
        left = checkpointed(
            moved.filter("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
        )
    return roots
