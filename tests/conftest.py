import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent))

from lexframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture
def column(spark):
    """Values of a column expression over given inputs."""

    def evaluate(fn, values, ddl="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {ddl}")
        from pyspark.sql import functions as F

        return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]

    return evaluate
