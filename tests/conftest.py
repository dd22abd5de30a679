import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="session")
def spark():
    from pageloom.session import local_session

    return local_session(4, "pageloom-tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def column(spark):
    """Apply a column function to Python values, in one job."""
    from pyspark.sql import functions as F

    def apply(fn, *values):
        rows = [(i, *v) for i, v in enumerate(zip(*values))]
        names = [f"c{n}" for n in range(len(values))]
        types = ", ".join(f"{n} string" for n in names)
        frame = spark.createDataFrame(rows, f"i int, {types}")
        done = frame.select("i", fn(*[F.col(n) for n in names]).alias("r")).orderBy("i").collect()
        return [r["r"] for r in done]

    return apply
