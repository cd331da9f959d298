import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkshelf.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", app="tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def evaluate(spark):
    """Value of a column expression over literal inputs."""
    from pyspark.sql import functions as F

    def run(make, *values, schema=None):
        names = [f"c{i}" for i in range(len(values))]
        df = spark.createDataFrame([values], schema or ", ".join(f"{n} {_ddl(v)}" for n, v in zip(names, values)))
        return df.select(make(*[F.col(n) for n in df.columns]).alias("out")).first()["out"]

    return run


def _ddl(value):
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    if isinstance(value, list):
        return "array<string>"
    return "string"
