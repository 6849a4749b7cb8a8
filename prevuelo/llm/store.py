"""Tables between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from prevuelo.sources.shared import shared_path, written

__all__ = ["documents", "free", "prepare", "shared_path", "written"]


#: Rows of an Arrow batch. Spark's own 10 000 suit narrow rows; so many whole texts are tens of megabytes per worker.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Once per session: bound the Arrow batches, unless they are smaller already, and give the package to the workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_prevuelo", None) is None:
        root = Path(__file__).resolve().parents[2]
        # Spark sends the file from the driver to every executor
        context._prevuelo = Path(tempfile.mkdtemp()) / "prevuelo.zip"
        with zipfile.ZipFile(context._prevuelo, "w") as out:
            for path in sorted((root / "prevuelo").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(context._prevuelo))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
