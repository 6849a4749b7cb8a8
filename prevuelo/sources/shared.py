"""Where intermediate tables go: the folder the cluster shares, never a machine's own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def run_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; local sessions without one get a temporary folder."""
    root = spark.conf.get(_DIR, None) or getattr(spark.sparkContext, "_prevuelo_dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError(f"set {_DIR} to a folder that all executors can reach")
        root = spark.sparkContext._prevuelo_dir = tempfile.mkdtemp(prefix="prevuelo-")
    return f"{root.rstrip('/')}/prevuelo-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the run's folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_stored(spark: SparkSession) -> bool:
    """Delete all that this application has stored between jobs; results that are still to be read are then lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Run ``df`` once, store it as a table and go on from the stored table."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
