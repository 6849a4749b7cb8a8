"""The first ten distinct usable values of every column, whole and in row order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevuelo.functions.cells import is_usable
from prevuelo.operators.measure import SAMPLES, column_facts
from prevuelo.sources.frames import Frame, Records


def _known_bounds(frames: list[Frame], bounds: DataFrame) -> dict[str, dict[int, int | None]]:
    """Bounds of the datasets known by name: one number per header of the job, fetched at once."""
    names = [f.name for f in frames if f.name is not None]
    known: dict[str, dict[int, int | None]] = {name: {} for name in names}
    if names:
        named = bounds.filter(F.col("dataset_id").isin(names)).select("dataset_id", "column_pos", "sample_bound")
        for line in named.collect():
            known[line.dataset_id][line.column_pos] = line.sample_bound
    return known


def _early_cells(frame: Frame, bounds: DataFrame, known_by_name: dict[str, dict[int, int | None]]) -> DataFrame:
    """(dataset, pos, column_pos, value) of the usable cells up to the bound of their column."""
    slots = range(len(frame.columns))
    if frame.name is None:
        return _within(frame.rows, bounds, lambda rows: _spread(rows, [f"{c} AS `{i}`" for i, c in zip(slots, frame.columns)]).filter(is_usable("value")))
    known = known_by_name[frame.name]
    # a column without a bound has no usable cell
    limits = [str(known[i]) if known.get(i) is not None else "NULL" for i in slots]
    last = max((b for b in known.values() if b is not None), default=-1)
    early = [
        f"CASE WHEN pos <= {limit} AND {is_usable(c)} THEN {c} END AS `{i}`"
        for i, c, limit in zip(slots, frame.columns, limits)
    ]
    # drops nearly all rows at the scan
    return _spread(frame.rows.filter(F.col("pos") <= last), early).filter("value IS NOT NULL")


def _spread(rows: DataFrame, cells: list[str]) -> DataFrame:
    long = rows.selectExpr("dataset", "pos", *cells).unpivot(["dataset", "pos"], [str(i) for i in range(len(cells))], "slot", "value")
    return long.selectExpr("dataset", "pos", "CAST(slot AS INT) AS column_pos", "value")


def _within(rows: DataFrame, bounds: DataFrame, cells_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cells of many datasets up to the bound of their column.

    Rows behind the last bound of all are dropped at the scan, those behind the last one of their dataset before their
    cells are spread. The bounds are a stored table, a line for each dataset and column: small ones are sent to all tasks,
    and where they are not, a hot dataset's rows and cells can be split.
    """
    last = bounds.agg(F.max("sample_bound")).first()[0]
    own = bounds.groupBy(F.col("dataset_id").alias("dataset")).agg(F.max("sample_bound").alias("last_bound"))
    early = rows.filter(F.col("pos") <= (-1 if last is None else last))
    cells = cells_of(early.join(own, "dataset").filter("pos <= last_bound").drop("last_bound"))
    known = bounds.select(F.col("dataset_id").alias("dataset"), "column_pos", "sample_bound")
    return cells.join(known, ["dataset", "column_pos"]).filter("pos <= sample_bound").select("dataset", "pos", "column_pos", "value")


def _early_record_cells(records: Records, bounds: DataFrame) -> DataFrame:
    """The same of records."""
    return _within(
        records.rows, bounds, lambda rows: rows.select("dataset", "pos", F.posexplode("cells").alias("column_pos", "value")).filter(is_usable("value"))
    )


def first_values(frames: list[Frame | Records], facts: DataFrame) -> DataFrame:
    """(dataset_id, column_pos, nth, value) with ``nth`` 1..10.

    ``facts`` must be stored: this is a second, pruned scan of the rows that lets through
    the few cells the bounds allow, instead of carrying whole texts through the big shuffle.
    """
    bounds = column_facts(facts)
    known = _known_bounds([f for f in frames if isinstance(f, Frame)], bounds)
    early = [_early_record_cells(f, bounds) if isinstance(f, Records) else _early_cells(f, bounds, known) for f in frames]
    early = reduce(DataFrame.unionByName, early)
    firsts = early.groupBy("dataset", "column_pos", "value").agg(F.min("pos").alias("first_pos"))
    in_order = Window.partitionBy("dataset", "column_pos").orderBy("first_pos", "value")
    return (
        firsts.withColumn("nth", F.row_number().over(in_order))
        .filter(F.col("nth") <= SAMPLES)
        .select(F.col("dataset").alias("dataset_id"), "column_pos", "nth", "value")
    )


def sample_values(frames: list[Frame | Records], facts: DataFrame) -> DataFrame:
    """(dataset_id, column_pos, sample_values), the ten values as an array in order."""
    ordered = F.array_sort(F.collect_list(F.struct("nth", "value")))
    return (
        first_values(frames, facts)
        .groupBy("dataset_id", "column_pos")
        .agg(F.transform(ordered, lambda s: s["value"]).alias("sample_values"))
    )
