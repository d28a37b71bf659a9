import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sitelore.session import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def ev(spark):
    """Evaluate an SQL expression per row of one or more columns."""
    from pyspark.sql import functions as F

    def run(expression, rows, columns=("x",)):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        schema = "_i int, " + ", ".join(f"{c} string" for c in columns)
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        return [r[0] for r in df.orderBy("_i").select(F.expr(expression)).collect()]

    return run
