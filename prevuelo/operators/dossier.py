"""All results of a dataset in one nested line, for payloads, prompts and reports.

Every array is bounded by the width of the header: a column has one profile, at most three
findings and at most one candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevuelo.functions import figures
from prevuelo.operators.candidates import CONFIDENCE_ORDER
from prevuelo.operators.measure import column_facts, row_facts


def _in_order(order: list[Column], value: Column) -> Column:
    keyed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), value.alias("value"))))
    return F.transform(keyed, lambda e: e["value"])


def _or_empty(array: str) -> Column:
    return F.coalesce(F.col(array), F.array())


def dossiers(facts: DataFrame, found: DataFrame, suggested: DataFrame) -> DataFrame:
    """(dataset_id, row_count, column_count, columns, findings, candidates, raw_total, total, risk_level)."""
    columns = (
        column_facts(facts)
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("column_count"),
            _in_order([F.col("column_pos")], F.struct("column_name", "inferred_type")).alias("columns"),
        )
    )
    problems = found.groupBy("dataset_id").agg(
        _in_order(
            [F.col("rule_pos"), F.col("column_pos")],
            F.struct("finding_id", "category", "severity", "description", "count", "percentage"),
        ).alias("findings"),
        F.sum(figures.weight_of(F.col("severity"))).alias("points"),
    )
    rank = figures.lookup(F.col("confidence"), CONFIDENCE_ORDER)
    keys = suggested.groupBy("dataset_id").agg(
        _in_order(
            [rank, F.collate(F.col("column_name"), "UNICODE"), F.col("column_pos")],
            F.struct("column_name", "candidate_type", "confidence", "reasoning", "confirmed"),
        ).alias("candidates")
    )
    raw = F.coalesce(F.col("points"), F.lit(0).cast("bigint"))
    total = figures.capped_score(raw)
    return (
        row_facts(facts)
        .select("dataset_id", "row_count")
        .join(columns, "dataset_id")
        .join(problems, "dataset_id", "left")
        .join(keys, "dataset_id", "left")
        .select(
            "dataset_id",
            "row_count",
            "column_count",
            "columns",
            _or_empty("findings").alias("findings"),
            _or_empty("candidates").alias("candidates"),
            raw.alias("raw_total"),
            total.alias("total"),
            figures.risk_level(total).alias("risk_level"),
        )
    )
