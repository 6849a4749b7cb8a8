import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("prevuelo-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def text_frame(spark):
    """Frame from rows of text cells, in the given order."""
    from pyspark.sql import functions as F

    from prevuelo.sources.frames import from_table

    def make(headers, rows, dataset="t"):
        schema = ", ".join(["at long", *[f"`{h}` string" for h in headers]])
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
        return from_table(df, dataset, F.col("at"), list(headers))

    return make
