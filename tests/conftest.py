import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weir.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate Column builders over one row of values: one(lambda a: f(a), 'text')."""
    from pyspark.sql import functions as F

    def run(build, *values):
        names = [f"v{i}" for i in range(len(values))]
        df = spark.range(1).select(*[F.lit(v).alias(n) for v, n in zip(values, names)])
        return df.select(build(*[F.col(n) for n in names]).alias("r")).first()["r"]

    return run
