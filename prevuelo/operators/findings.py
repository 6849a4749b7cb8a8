"""Quality rules: facts in, findings out.  No rule looks at the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevuelo.functions import figures, wording
from prevuelo.functions.headers import is_temporal

# Rule families in the order their findings are listed.  The last one
# needs two temporal columns and, being reserved, never yields a finding.
RULES = ["nulls", "empties", "duplicates", "invalid_dates", "late_arriving"]


def findings(facts: DataFrame) -> DataFrame:
    """One line per problem found; ``rule_pos, column_pos`` is the listing order of a dataset."""
    f = F.col
    on_rows = f("column_pos") < 0
    temporal = is_temporal(f("column_name"), f("inferred_type"))
    counts = {
        "nulls": F.when(~on_rows, f("null_count")),
        "empties": F.when(~on_rows, f("empty_count")),
        "duplicates": F.when(on_rows, f("row_count") - f("unique_count")),
        "invalid_dates": F.when(~on_rows & temporal, f("invalid_date_count")),
    }
    per_rule = F.array(
        *[
            F.struct(F.lit(RULES.index(rule)).alias("rule_pos"), F.lit(rule).alias("category"), n.alias("count"))
            for rule, n in counts.items()
        ]
    )
    hits = facts.select(
        "dataset_id", "column_pos", "column_name", "row_count", F.inline(F.filter(per_rule, lambda r: r["count"] > 0))
    ).withColumn("share", figures.percent_of(f("count"), f("row_count")))
    parts = {"column": f("column_name"), "count": f("count"), "percent": figures.one_decimal(f("share"))}
    return hits.select(
        "dataset_id",
        "rule_pos",
        "column_pos",
        F.when(f("category") == "duplicates", "duplicates-exact")
        .otherwise(F.concat_ws("-", "category", "column_name"))
        .alias("finding_id"),
        "category",
        figures.severity_of(f("share")).alias("severity"),
        wording.fill_by(f("category"), wording.DESCRIPTION, **parts).alias("description"),
        F.when(f("column_name").isNotNull(), F.array("column_name")).alias("affected_columns"),
        "count",
        figures.rounded_percent(f("share")).alias("percentage"),
        wording.fill_by(f("category"), wording.EXPLANATION, **parts).alias("rule_based_explanation"),
        wording.fill_by(f("category"), wording.ACTION, **parts).alias("recommended_action"),
    )


def rule_status(facts: DataFrame) -> DataFrame:
    """What each rule family did on each dataset; every family counts as executed."""
    f = F.col
    column = f("column_pos") >= 0
    temporal = column & is_temporal(f("column_name"), f("inferred_type"))

    per_dataset = facts.groupBy("dataset_id").agg(
        F.count_if(temporal).alias("temporal_columns"),
        F.count_if(column & (f("null_count") > 0)).alias("nulls"),
        F.count_if(column & (f("empty_count") > 0)).alias("empties"),
        F.count_if(~column & (f("row_count") > f("unique_count"))).alias("duplicates"),
        F.count_if(temporal & (f("invalid_date_count") > 0)).alias("invalid_dates"),
    )
    reported = [F.struct(F.lit(i).alias("rule_pos"), F.lit(r).alias("rule"), f(r).alias("findings"))
                for i, r in enumerate(RULES[:-1])]
    reserved = F.struct(F.lit(len(RULES) - 1).alias("rule_pos"), F.lit(RULES[-1]).alias("rule"),
                        F.lit(0).cast("bigint").alias("findings"))
    lines = per_dataset.select("dataset_id", "temporal_columns", F.inline(F.array(*reported, reserved)))
    late = F.when(f("temporal_columns") >= 2, "evaluated_no_finding").otherwise("not_evaluable")
    return lines.select(
        "dataset_id",
        "rule_pos",
        "rule",
        F.when(f("rule") == RULES[-1], late)
        .when(f("findings") > 0, "findings")
        .otherwise("no_finding")
        .alias("status"),
        "findings",
        "temporal_columns",
        F.lit(len(RULES)).cast("bigint").alias("rules_executed"),
    )
