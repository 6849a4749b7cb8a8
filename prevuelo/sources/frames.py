"""The shape in which every dataset enters the audit.

A ``Frame`` holds text columns ``c0 .. cN-1`` (one per header, in header order), the
``dataset`` a row belongs to and its ``pos``, a long that orders the rows of a dataset.
Rows without any usable cell are gone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevuelo.functions.cells import is_usable
from prevuelo.functions.wording import NO_HEADERS_ERROR


@dataclass(frozen=True)
class Frame:
    rows: DataFrame
    headers: tuple[str, ...]
    name: str | None  # the dataset when there is only one, else None

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.headers))]

    def with_headers(self) -> DataFrame:
        """The rows under their own names, behind ``dataset_id`` and ``row_pos``."""
        return self.rows.select("dataset", "pos", *self.columns).toDF("dataset_id", "row_pos", *self.headers)


@dataclass(frozen=True)
class Records:
    """Rows of any number of headers in one plan: ``rows`` (dataset, pos, cells) with as many cells as the dataset has
    headers, missing ones NULL; ``headers`` (dataset_id, column_pos, column_name), a stored table."""

    rows: DataFrame
    headers: DataFrame

    def frame_of(self, names: Sequence[str], datasets: Column | None = None) -> Frame:
        """The datasets of one header (those that satisfy the condition on ``dataset``) under its columns."""
        rows = self.rows if datasets is None else self.rows.filter(datasets)
        cells = [f"get(cells, {i}) AS c{i}" for i in range(len(names))]
        return Frame(rows.selectExpr("dataset", "pos", *cells), tuple(names), None)

    def names_of(self, dataset: str) -> list[str]:
        lines = self.headers.filter(F.col("dataset_id") == dataset).orderBy("column_pos")
        return [line.column_name for line in lines.collect()]

    def frames(self) -> tuple[Frame, ...]:
        """One frame for each different header; its names come to the driver."""
        named = F.array_sort(F.collect_list(F.struct("column_pos", "column_name")))
        by_dataset = self.headers.groupBy("dataset_id").agg(F.transform(named, lambda n: n["column_name"]).alias("names"))
        found = by_dataset.select("names").distinct().collect()
        out = []
        for line in sorted(found, key=lambda r: r.names):
            mine = by_dataset.filter(F.col("names") == F.array(*map(F.lit, line.names))).select(F.col("dataset_id").alias("dataset"))
            rows = Records(self.rows.join(mine, "dataset", "left_semi"), self.headers)
            out.append(rows.frame_of(line.names))
        return tuple(out)


def make_frame(rows: DataFrame, dataset: str | Column, pos: Column, cells: Sequence[str], headers: Sequence[str]) -> Frame:
    """Project ``rows`` to the frame layout and drop blank rows; ``cells`` are SQL expressions."""
    if not headers:
        raise ValueError(NO_HEADERS_ERROR)
    one = isinstance(dataset, str)
    laid_out = rows.select(
        (F.lit(dataset) if one else dataset).alias("dataset"),
        pos.cast("long").alias("pos"),
        *[F.expr(f"CAST({cell} AS STRING) AS c{i}") for i, cell in enumerate(cells)],
    )
    # the first cell mostly settles it; the others are worked out only for rows where it is blank
    others = ", ".join(f"c{i}" for i in range(1, len(headers)))
    kept = is_usable("c0") + (f" OR exists(array({others}), v -> {is_usable('v')})" if others else "")
    return Frame(laid_out.filter(kept), tuple(headers), dataset if one else None)


def _scanned_in_order(df: DataFrame) -> bool:
    """Nothing but projections and filters stands over the source."""
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = {line.lstrip(" :+-").split(" ", 1)[0].split("[", 1)[0].split("(", 1)[0] for line in plan.splitlines() if line.strip()}
    return nodes <= {"Project", "Filter", "SubqueryAlias", "View", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "Range"}


def from_table(
    df: DataFrame,
    dataset: str | Column,
    pos: Column | None = None,
    columns: Sequence[str] | None = None,
) -> Frame:
    """Any DataFrame, every column cast to text.

    ``dataset`` names the table, or is a column expression that tells many datasets of one
    layout apart.  ``pos`` orders the rows; without it the scan order counts, which is
    repeatable for a plain scan of files or of local rows only, so other plans must give it.
    """
    names = list(columns or df.columns)
    if pos is None and not _scanned_in_order(df):
        raise ValueError("rows that come out of a join, an aggregation or a shuffle need ``pos``")
    where = F.monotonically_increasing_id() if pos is None else pos
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    return make_frame(df, dataset, where, quoted, names)
