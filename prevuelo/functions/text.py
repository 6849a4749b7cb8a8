"""Escapes, sanitisers and the name of a report file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prevuelo.functions.cells import SPACE

MAX_NAME_CHARS = 128
REPORT_SUFFIX = "pipeline-risk-report.md"


def table_cell(text: Column) -> Column:
    """Safe inside a Markdown table cell."""
    one_line = F.translate(text, "\n\r", " ")
    return F.when(text == "", "—").otherwise(F.regexp_replace(one_line, r"\|", r"\\|"))


def markdown_text(text: Column) -> Column:
    """Safe in Markdown headings, lists and paragraphs; line breaks stay."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    marked = F.regexp_replace(lines, r"([\\`*_\[\]])", r"\\$1")
    return F.when(text == "", "—").otherwise(F.regexp_replace(marked, r"(?m)^(#+)", r"\\$1"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def safe_name(name: Column) -> Column:
    """Column name as it may leave the company: first 128 characters, then letters, digits and hyphens only."""
    return F.regexp_replace(F.substring(name, 1, MAX_NAME_CHARS), r"[^a-zA-Z0-9-]", "")


def report_file_name(dataset: Column) -> Column:
    stem = F.regexp_replace(trimmed(dataset), r"(?i)\.csv\z", "")
    clean = F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*]', "-"), r"-{2,}", "-")
    clean = F.regexp_replace(clean, rf"[.{SPACE}]+\z", "")
    return F.when(clean == "", REPORT_SUFFIX).otherwise(F.concat(clean, F.lit("-" + REPORT_SUFFIX)))


def parse_error_text(row: Column, message: Column) -> Column:
    return F.concat(F.lit("Fila "), F.coalesce(row.cast("string"), F.lit("?")), F.lit(": "), message)
