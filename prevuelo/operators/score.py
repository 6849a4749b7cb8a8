"""Risk score of a dataset: the capped sum of the weights of its findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevuelo.functions import figures


def breakdown(found: DataFrame) -> DataFrame:
    """The points every finding contributes, in listing order columns."""
    return found.select(
        "dataset_id",
        "rule_pos",
        "column_pos",
        "finding_id",
        "severity",
        figures.weight_of(F.col("severity")).alias("contribution"),
    )


def scores(datasets: DataFrame, found: DataFrame) -> DataFrame:
    """One line per dataset of ``datasets`` (dataset_id), 0 points when nothing was found."""
    sums = (
        breakdown(found)
        .groupBy("dataset_id")
        .agg(F.sum("contribution").alias("points"), F.count(F.lit(1)).alias("hits"))
    )
    raw = F.coalesce(F.col("points"), F.lit(0).cast("bigint"))
    total = figures.capped_score(raw)
    return datasets.join(sums, "dataset_id", "left").select(
        "dataset_id",
        total.alias("total"),
        raw.alias("raw_total"),
        F.coalesce(F.col("hits"), F.lit(0).cast("bigint")).alias("finding_count"),
        figures.risk_level(total).alias("risk_level"),
    )


def ranking(scored: DataFrame) -> DataFrame:
    """Datasets from the riskiest down; equal totals share a rank.

    Ranks come from the at most 101 different totals, so datasets are never sorted in one task.
    """
    per_total = scored.groupBy("total").agg(F.count(F.lit(1)).alias("datasets"))
    above = Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_total.select(
        "total", (F.coalesce(F.sum("datasets").over(above), F.lit(0)) + 1).cast("bigint").alias("risk_rank")
    )
    return scored.join(F.broadcast(ranks), "total").select("risk_rank", *scored.columns)
