"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevuelo.llm.store import prepare


def crc(column: str = "doc_id") -> F.Column:
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most ``per_class`` training rows of each class, in hash order, and all rows by class.

    Rows of the held-out fold, without an id or with a label other than 0 and 1 are not used; of repeated ids one is.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc() % folds != held_out))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    taken = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return reduce(DataFrame.unionByName, taken), {c: counts.get(c, 0) for c in (0, 1)}


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids' rows with their texts; ``ids`` is bounded by the sample, so it goes to every task."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.join(F.broadcast(ids), "doc_id")
