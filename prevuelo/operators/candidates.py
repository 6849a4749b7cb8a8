"""Key and incremental-load candidates, and the decisions users take on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prevuelo.functions import figures, headers, wording
from prevuelo.operators.measure import column_facts, row_facts

# Listing order of the confidence levels.
CONFIDENCE_ORDER = {"alta": 0, "media": 1, "baja": 2}


def uniqueness(f=F.col) -> Column:
    """Distinct values as a percentage of the usable cells."""
    return figures.percent_of(f("unique_count"), f("row_count") - f("null_count") - f("empty_count"))


def missing(f=F.col) -> Column:
    """Missing and empty cells as a percentage of the rows."""
    return figures.percent_of(f("null_count") + f("empty_count"), f("row_count"))


def candidates(facts: DataFrame) -> DataFrame:
    """At most one suggestion per column; the first kind that fits in the order
    incremental marker, primary key, business key claims the column."""
    f = F.col
    name, unique, absent = f("column_name"), f("unique_percent"), f("missing_percent")
    strong, secondary = headers.names_strong_marker(name), headers.names_secondary_marker(name)
    plain_type = f("inferred_type").isin("string", "number")
    kind = (
        F.when((strong | secondary) & (absent <= 20), F.when(strong, "strong").otherwise("secondary"))
        .when(
            headers.names_primary_key(name) & plain_type & (f("null_count") + f("empty_count") == 0) & (unique >= 98),
            "primary_key",
        )
        .when(headers.names_business_key(name) & plain_type & (unique >= 90) & (absent <= 5), "business_key")
    )
    confidence = (
        F.when(f("kind") == "strong", F.when(absent == 0, "alta").otherwise("media"))
        .when(f("kind") == "secondary", F.when(absent == 0, "media").otherwise("baja"))
        .when((unique == 100) & (absent == 0), "alta")
        .when((f("kind") == "primary_key") | (unique >= 98), "media")
        .otherwise("baja")
    )
    texts = {
        "column": name,
        "type": f("inferred_type"),
        "unique": figures.one_decimal(unique),
        "missing": figures.one_decimal(absent),
    }
    return (
        column_facts(facts)
        .withColumn("unique_percent", uniqueness())
        .withColumn("missing_percent", missing())
        .withColumn("kind", kind)
        .filter(f("kind").isNotNull())
        .select(
            "dataset_id",
            "column_pos",
            "column_name",
            F.when(f("kind").isin("strong", "secondary"), "incremental_marker")
            .otherwise(f("kind"))
            .alias("candidate_type"),
            confidence.alias("confidence"),
            wording.fill_by(f("kind"), wording.REASONING, **texts).alias("reasoning"),
            F.lit(False).alias("confirmed"),
        )
    )


def possible_keys(spark: SparkSession, names: Iterable[str]) -> set[str]:
    """The column names that can be suggested at all; no other column needs its distinct values counted."""
    name = F.col("name")
    fits = headers.names_strong_marker(name) | headers.names_secondary_marker(name)
    fits = fits | headers.names_primary_key(name) | headers.names_business_key(name)
    listed = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    return {r.name for r in listed.filter(fits).collect()}


def listing_order() -> list[Column]:
    """Sort keys of the candidates of a dataset: confidence, then name as a reader would sort it."""
    rank = figures.lookup(F.col("confidence"), CONFIDENCE_ORDER)
    return [rank, F.collate(F.col("column_name"), "UNICODE"), F.col("column_pos")]


def evidence(facts: DataFrame) -> DataFrame:
    """One line per dataset: how many candidates, and the message when there are none."""
    per_dataset = candidates(facts).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    found = F.coalesce(F.col("candidate_count"), F.lit(0))
    return (
        row_facts(facts)
        .select("dataset_id")
        .join(per_dataset, "dataset_id", "left")
        .select(
            "dataset_id",
            found.alias("candidate_count"),
            (found == 0).alias("insufficient_evidence"),
            F.when(found == 0, wording.NO_CANDIDATES).alias("message"),
        )
    )


def decide(suggested: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply ``(dataset_id, column_name, decision)`` lines: ``confirm`` marks, ``reject`` removes.

    A column that was both confirmed and rejected is gone.
    """
    verdicts = decisions.groupBy("dataset_id", "column_name").agg(
        F.bool_or(F.col("decision") == "confirm").alias("confirmed_now"),
        F.bool_or(F.col("decision") == "reject").alias("rejected_now"),
    )
    confirmed = F.col("confirmed") | F.coalesce(F.col("confirmed_now"), F.lit(False))
    return (
        suggested.join(verdicts, ["dataset_id", "column_name"], "left")
        .filter(~F.coalesce(F.col("rejected_now"), F.lit(False)))
        .withColumn("confirmed", confirmed)
        .select(*suggested.columns)
    )
