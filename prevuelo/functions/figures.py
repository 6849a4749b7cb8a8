"""Percentages, severities, weights and their text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of a finding by severity.
SEVERITY_WEIGHTS = {"alto": 20, "medio": 10, "bajo": 5}


def lookup(code: Column, table: dict, strict: bool = False) -> Column:
    """A small fixed table as one CASE; an unknown code is NULL, or an error when strict."""
    out = None
    for key, value in table.items():
        out = F.when(code == key, value) if out is None else out.when(code == key, value)
    if strict:
        out = out.when(code.isNotNull(), F.raise_error(F.concat(F.lit("Valor no soportado: "), code)))
    return out


def percent_of(part: Column, whole: Column) -> Column:
    """Unrounded percentage; 0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * 100.0).otherwise(F.lit(0.0))


def rounded_percent(percent: Column) -> Column:
    """One decimal, half up on the binary value."""
    return F.floor(percent * 10.0 + 0.5) / 10.0


def one_decimal(percent: Column) -> Column:
    """Text with one decimal; only an exact quarter can tie, and a tie goes up."""
    tie = (percent * 4.0) % 2.0 == 1.0
    return F.format_number(F.when(tie, percent + 0.01).otherwise(percent), 1)


def plain_number(number: Column) -> Column:
    """Shortest text of a number: whole numbers without a fraction."""
    whole = number == F.floor(number)
    return F.when(whole, F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))


def severity_of(percent: Column) -> Column:
    return F.when(percent >= 20, "alto").when(percent >= 5, "medio").otherwise("bajo")


def weight_of(severity: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHTS).cast("bigint")


def capped_score(raw: Column) -> Column:
    return F.least(F.lit(100).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), raw))


def risk_level(total: Column) -> Column:
    return F.when(total >= 60, "alto").when(total >= 30, "medio").otherwise("bajo")
