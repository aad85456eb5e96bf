import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from factloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write(tmp_path):
    def to_file(text, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode("utf-8"))
        return str(path)

    return to_file


@pytest.fixture(scope="session")
def hand(spark):
    """Five rows with known answers."""
    from pyspark.sql import functions as F

    rows = [
        (0, "2025-01-06", "EU", 100, True),
        (1, "2025-01-07", "EU", 50, False),
        (2, "2025-01-14", "US", 200, True),
        (3, "2025-02-03", "APAC", 30, True),
        (4, "2025-02-04", None, None, None),
    ]
    df = spark.createDataFrame(rows, "n int, day string, region string, revenue long, ok boolean")
    return df.withColumn("day", F.col("day").cast("date"))
