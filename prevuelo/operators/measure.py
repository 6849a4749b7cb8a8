"""One scan and one shuffle that measure every column of every dataset in the job.

Each row is spread into one (column, key) pair per cell plus one pair for the row itself.
Counting equal pairs is partially aggregated before the shuffle, so a value that fills a
third of a table travels once per task, and all later work sees distinct values only:
the type and date tests run once per distinct value, not once per cell.  Long values and
whole rows travel as SHA-256 keys, so the width of a text does not reach the shuffle.

Where a frame holds many datasets, counting before the shuffle saves little: most pairs are the
only ones of their dataset and task. There the rows are counted first; a dataset whose cells fit
into one value is dealt whole, a row travelling once, and all its columns are measured where it
arrives. Larger datasets go as pairs.
"""

from __future__ import annotations

import json
from collections.abc import Collection
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevuelo.functions import cells as C
from prevuelo.sources.frames import Frame, Records

# Distinct values are dealt into this many buckets; see ``sample_bound`` below.
_BUCKETS = 16
SAMPLES = 10

# Cells of a dataset that is dealt whole, its rows counting as one more column; and of a task's share of such datasets:
# up to 200 tasks Spark writes their rows as they come, for more it holds them in memory first, so shares grow before there are more.
DEALT_CELLS = 2_000_000
_TASK_CELLS, _MOST_TASK_CELLS, _DIRECT_TASKS = 1_000_000, 8_000_000, 200

ROW_POS = -1  # ``column_pos`` of the line that measures whole rows

# Columns of records are known by their headers table only: slot -1 is the row, and -2, -3 and so on are its cells.
_RECORD_ROW = -1


def _file(frame: Frame) -> str:
    return "CAST(NULL AS STRING)" if frame.name is not None else "dataset"


def _record_pairs(records: Records, columns: Collection[str] | None, whole_rows: bool) -> DataFrame:
    """(file, pos, slot, key) of rows that hold their cells in an array, whatever their headers."""
    parts = [f"array(struct({_RECORD_ROW} AS slot, {C.array_key('cells')} AS value))"] if whole_rows else []
    if columns is None or columns:
        parts.append(f"transform(cells, (v, i) -> struct({_RECORD_ROW - 1} - i AS slot, v AS value))")
    spread = records.rows.selectExpr("dataset AS file", "pos", f"inline(concat({', '.join(parts) or 'array()'}))")
    if columns is not None:
        wanted = records.headers.filter(F.col("column_name").isin(list(columns)))
        wanted = wanted.select(F.col("dataset_id").alias("file"), (_RECORD_ROW - 1 - F.col("column_pos")).alias("slot"))
        rows = wanted.select("file", F.lit(_RECORD_ROW).alias("slot")).distinct()
        spread = spread.join(wanted.unionByName(rows), ["file", "slot"], "left_semi")
    key = f"IF(slot = {_RECORD_ROW}, value, {C.cell_key('value')}) AS key"
    return spread.selectExpr("file", "pos", "slot", key)


def _named(lines: DataFrame, frames: tuple[Frame | Records, ...]) -> DataFrame:
    """The lines of records with the names of their columns."""
    headers = [f.headers for f in frames if isinstance(f, Records)]
    if not headers:
        return lines
    known = reduce(DataFrame.unionByName, headers).withColumnRenamed("column_name", "known_name")
    named = lines.join(known, ["dataset_id", "column_pos"], "left")
    return named.withColumn("column_name", F.coalesce("column_name", "known_name")).select(*lines.columns)


def _pairs(frame: Frame, base: int, wanted: list[int], whole_rows: bool) -> DataFrame:
    """(file, pos, slot, key): one pair per cell of the wanted columns, and slot ``base`` for the row.

    ``file`` tells datasets of one frame apart; where every frame is one dataset, the slot alone does, and it is dropped.
    """
    keys = {str(base + 1 + i): C.cell_key(f"c{i}") for i in wanted}
    if whole_rows:
        keys = {str(base): C.row_key(frame.columns), **keys}
    # a row's keys are worked out at once, before it is spread
    laid_out = frame.rows.selectExpr(f"{_file(frame)} AS file", "pos", *[f"{key} AS `{slot}`" for slot, key in keys.items()])
    return laid_out.unpivot(["file", "pos"], list(keys), "slot", "key").selectExpr("file", "pos", "CAST(slot AS INT) AS slot", "key")


def _literal_at(values: list, sql_type: str) -> Column:
    """A per-column constant by slot number, folded into the plan (no join)."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{sql_type}>"), F.col("slot"))


def _inferred_type(kinds: Column) -> Column:
    one_kind = reduce(
        lambda case, kind: case.when(kinds == 1 << kind[0], kind[1]), enumerate(C.KINDS), F.when(kinds == 0, "string")
    )
    return one_kind.otherwise("mixed")


def _position(positions: list) -> Column:
    """Position of a slot's column; those of records stand in the slot itself."""
    return F.when(F.col("slot") < 0, _RECORD_ROW + ROW_POS - F.col("slot")).otherwise(_literal_at(positions, "int"))


def _slots(frames: tuple[Frame, ...]) -> tuple[list[int], list, list, list]:
    """First slot of each frame; column name, dataset and column position by slot."""
    named = [frame.name for frame in frames if frame.name is not None]
    if len(set(named)) < len(named):
        raise ValueError(f"datasets need names of their own: {sorted(named)}")
    bases, names, datasets, positions = [], [], [], []
    for frame in frames:
        bases.append(len(names))
        names += [None, *frame.headers]
        datasets += [frame.name] * (len(frame.headers) + 1)
        positions += range(ROW_POS, len(frame.headers))
    return bases, names, datasets, positions


def measure_counts(*frames: Frame | Records) -> DataFrame:
    """The lines of ``measure`` without what needs distinct values: those are NULL.

    Missing and empty cells, types and invalid dates are sums over each row's cells, so every task sends one line per
    dataset, and no value and no row digest travels.
    """
    columnar = tuple(f for f in frames if isinstance(f, Frame))
    bases, names, datasets, positions = _slots(columnar)
    parts = [_record_counts(f) for f in frames if isinstance(f, Records)]
    for frame, base in zip(columnar, bases):
        codes = [f"CASE WHEN {c} IS NOT NULL THEN {C.cell_code(c)} END AS k{i}" for i, c in enumerate(frame.columns)]
        sums, lines = [], [f"struct({base} AS slot, 0L AS nulls, 0L AS empties, 0 AS kinds, 0L AS undated)"]
        for i in range(len(frame.columns)):
            bits = " ".join(
                f"WHEN k{i} IN ({', '.join(map(repr, own))}) THEN {1 << bit}" for bit, own in enumerate(C.KINDS.values())
            )
            sums += [
                F.expr(f"count_if(k{i} IS NULL) AS n{i}"),
                F.expr(f"count_if(k{i} = '{C.EMPTY}') AS e{i}"),
                F.expr(f"bit_or(CASE {bits} ELSE 0 END) AS b{i}"),
                F.expr(f"count_if(k{i} IN ({', '.join(map(repr, C.NOT_A_VALID_DATE))})) AS d{i}"),
            ]
            own = f"n{i} AS nulls, e{i} AS empties, b{i} AS kinds, d{i} AS undated"
            lines.append(f"struct({base + 1 + i} AS slot, {own})")
        counted = frame.rows.selectExpr(f"{_file(frame)} AS file", *codes).groupBy("file")
        counted = counted.agg(F.count(F.lit(1)).alias("row_count"), *sums)
        parts.append(counted.selectExpr("file", "row_count", f"inline(array({', '.join(lines)}))"))
    rows = F.col("slot").isin([*bases, _RECORD_ROW])
    counts = reduce(DataFrame.unionByName, parts).select(
        F.coalesce(F.col("file"), _literal_at(datasets, "string")).alias("dataset_id"),
        _position(positions).alias("column_pos"),
        _literal_at(names, "string").alias("column_name"),
        "row_count",
        F.col("nulls").alias("null_count"),
        F.col("empties").alias("empty_count"),
        F.lit(None).cast("bigint").alias("unique_count"),
        F.when(rows, "mixed").otherwise(_inferred_type(F.col("kinds"))).alias("inferred_type"),
        F.col("undated").alias("invalid_date_count"),
        F.lit(None).cast("bigint").alias("sample_bound"),
    )
    return _named(counts, frames)


def _record_counts(records: Records) -> DataFrame:
    """(file, row_count, slot, nulls, empties, kinds, undated): a line per task, dataset and column travels."""
    code, row = F.col("code"), F.col("slot") == _RECORD_ROW
    spread = f"inline(concat(array(struct({_RECORD_ROW} AS slot, CAST(NULL AS STRING) AS value)), transform(cells, (v, i) -> struct({_RECORD_ROW - 1} - i AS slot, v AS value))))"
    cells = records.rows.selectExpr("dataset AS file", spread)
    cells = cells.selectExpr("file", "slot", f"CASE WHEN value IS NOT NULL THEN {C.cell_code('value')} END AS code")
    bits = F.coalesce(*[F.when(code.isin(own), F.lit(1 << bit)) for bit, own in enumerate(C.KINDS.values())], F.lit(0))
    return cells.groupBy("file", "slot").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(code.isNull() & ~row).alias("nulls"),
        F.count_if(code == C.EMPTY).alias("empties"),
        F.bit_or(bits).alias("kinds"),
        F.count_if(code.isin(C.NOT_A_VALID_DATE)).alias("undated"),
    )


def _tasks(dealt_cells: int) -> int:
    """Number of tasks that datasets of so many cells are dealt to."""
    of_most = max(_DIRECT_TASKS, -(-dealt_cells // _MOST_TASK_CELLS))
    return max(1, min(-(-dealt_cells // _TASK_CELLS), of_most))


def _by_size(frame: Frame) -> tuple[Frame | None, DataFrame | None, int]:
    """The frame with its large datasets only, the rows of those that are dealt whole, and the number of tasks for them.

    The names of large datasets come to the driver: one at most for every ``DEALT_CELLS`` cells.
    """
    width, dataset = len(frame.headers) + 1, F.col("dataset")
    is_large = F.col("n") * width > DEALT_CELLS
    sizes = frame.rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    seen = sizes.agg(
        F.coalesce(F.sum(F.when(~is_large, F.col("n"))), F.lit(0)).alias("dealt"),
        F.collect_list(F.when(is_large, dataset)).alias("large"),
        F.coalesce(F.bool_or(is_large & dataset.isNull()), F.lit(False)).alias("large_null"),
    ).first()
    tasks = _tasks(seen.dealt * width)
    if not seen.large and not seen.large_null:
        return None, frame.rows, tasks
    large = F.when(dataset.isNull(), F.lit(seen.large_null)).otherwise(dataset.isin(seen.large))
    return replace(frame, rows=frame.rows.filter(large)), frame.rows.filter(~large) if seen.dealt else None, tasks


def _dealt(rows: DataFrame, tasks: int, base: int, width: int, wanted: list[int], whole_rows: bool) -> DataFrame:
    """(dataset, slot, row_count, null_count, empty_count, unique_count, kinds, invalid_date_count, sample_bound) of
    datasets that fit into one value each: every row travels once, and nothing else does."""
    keyed = range(width) if whole_rows else wanted
    # a number sorts faster than names that begin alike
    laid_out = rows.selectExpr("xxhash64(dataset) AS dealt", "dataset", "pos", *[f"{C.coded_key(f'c{i}')} AS k{i}" for i in keyed])
    # by position; rows without one come last
    row = f"struct(pos IS NULL AS unplaced, pos, {', '.join(f'k{i}' for i in keyed)})"
    whole = laid_out.repartition(tasks, "dataset").groupBy("dealt", "dataset")
    whole = whole.agg(F.expr(f"sort_array(collect_list({row})) AS rows"), F.count(F.lit(1)).alias("row_count"))
    whole = whole.selectExpr("*", "rows.pos AS places", *[f"rows.k{i} AS v{i}" for i in keyed])
    whole = whole.selectExpr("*", *[f"array_distinct(v{i}) AS d{i}" for i in keyed])
    code = C.coded_key_code("v")
    whole = whole.selectExpr("*", *[f"array_distinct(transform(d{i}, v -> {code})) AS t{i}" for i in wanted])

    lines, blank, dates = [], f"{code} = '{C.EMPTY}'", f"'{C.DATE_OK}', '{C.TEXT_DATE_OK}'"
    for i in wanted:
        # cells are counted only where one of their code is there
        has_blank, has_date = f"array_contains(t{i}, '{C.EMPTY}')", f"arrays_overlap(t{i}, array({dates}))"
        missing = f"IF(exists(t{i}, c -> c IS NULL), size(filter(v{i}, v -> v IS NULL)), 0)"
        empty = f"IF({has_blank}, size(filter(v{i}, v -> {blank})), 0)"
        dated = f"IF({has_date}, size(filter(v{i}, v -> {code} IN ({dates}))), 0)"
        blanks = f"IF({has_blank}, size(filter(d{i}, v -> {blank})), 0)"
        kinds = " + ".join(
            f"IF(arrays_overlap(t{i}, array({', '.join(map(repr, own))})), {1 << bit}, 0)" for bit, own in enumerate(C.KINDS.values())
        )
        first = f"slice(filter(slice(d{i}, 1, {SAMPLES + 1} + {blanks}), v -> NOT {blank}), 1, {SAMPLES})"
        bound = f"array_max(transform({first}, v -> get(places, CAST(array_position(v{i}, v) AS INT) - 1)))"
        lines.append(
            f"struct({base + 1 + i} AS slot, CAST({missing} AS BIGINT) AS null_count, CAST({empty} AS BIGINT) AS empty_count,"
            f" CAST(size(filter(d{i}, v -> v IS NOT NULL)) - {blanks} AS BIGINT) AS unique_count, {kinds} AS kinds,"
            f" CAST({dated} AS BIGINT) AS dates, {bound} AS sample_bound)"
        )
    if whole_rows:
        # no two rows are equal where a column never repeats
        all_differ = " OR ".join(f"size(d{i}) = size(rows)" for i in keyed)
        identity = f"transform(rows, r -> concat({C.cells_joined(f'r.k{i}' for i in keyed)}))"
        unique = f"CAST(IF({all_differ}, size(rows), size(array_distinct({identity}))) AS BIGINT)"
        lines.append(
            f"struct({base} AS slot, 0L AS null_count, 0L AS empty_count, {unique} AS unique_count, 0 AS kinds, row_count AS dates,"
            " CAST(NULL AS BIGINT) AS sample_bound)"
        )
    measured = whole.selectExpr("dataset", "row_count", f"inline(array({', '.join(lines)}))")
    return measured.selectExpr("* EXCEPT (dates)", "row_count - null_count - empty_count - dates AS invalid_date_count")


def measure(*frames: Frame | Records, columns: Collection[str] | None = None, whole_rows: bool = True) -> DataFrame:
    """One line per dataset and column, and one per dataset with ``column_pos`` -1 for its rows.

    ``columns`` restricts the measured columns to those names; without ``whole_rows`` the rows
    themselves are not measured.

    ``unique_count`` of the -1 line is the number of distinct rows.  ``sample_bound`` is a
    position up to which a column surely shows its first ten distinct values: the tenth
    smallest of the first positions of its hash buckets of values (where the dataset is dealt
    whole, of its values) or, when there are fewer, the first position of the value that shows
    up last.
    """
    columnar = tuple(f for f in frames if isinstance(f, Frame))
    bases, names, datasets, positions = _slots(columnar)
    pairs = [_record_pairs(f, columns, whole_rows) for f in frames if isinstance(f, Records) and (whole_rows or columns is None or columns)]
    dealt = []
    for frame, base in zip(columnar, bases):
        wanted = [i for i, name in enumerate(frame.headers) if columns is None or name in columns]
        if not wanted and not whole_rows:
            continue
        large, rows, tasks = _by_size(frame) if frame.name is None else (frame, None, 0)
        if rows is not None:
            dealt.append(_dealt(rows, tasks, base, len(frame.headers), wanted, whole_rows))
        if large is not None:
            pairs.append(_pairs(large, base, wanted, whole_rows))

    def lines(per_column: DataFrame, dataset: Column) -> DataFrame:
        return per_column.select(
            dataset.alias("dataset_id"),
            _position(positions).alias("column_pos"),
            _literal_at(names, "string").alias("column_name"),
            "row_count",
            "null_count",
            "empty_count",
            "unique_count",
            _inferred_type(F.col("kinds")).alias("inferred_type"),
            "invalid_date_count",
            "sample_bound",
        )

    measured = [lines(d, F.col("dataset")) for d in dealt]
    if not pairs and measured:
        return reduce(DataFrame.unionByName, measured)
    if not pairs:  # nothing is asked for: no lines
        first = frames[0]
        pairs = [(_pairs(first, 0, [0], False) if isinstance(first, Frame) else _record_pairs(first, None, True)).limit(0)]

    code = F.col("code")
    # eight bytes less in every pair that travels
    files = ["file"] if any(f.name is None for f in columnar) or len(columnar) < len(frames) else []
    tallies = (
        reduce(DataFrame.unionByName, pairs)
        .select(*files, "slot", "key", "pos")
        .groupBy(*files, "slot", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
        .select(
            *files,
            "slot",
            F.expr(C.key_code("key")).alias("code"),
            F.pmod(F.xxhash64("key"), F.lit(_BUCKETS)).cast("int").alias("bucket"),
            "n",
            "first_pos",
        )
        .groupBy(*files, "slot", "code", "bucket")
        .agg(
            F.sum("n").alias("cells"),
            F.count(F.lit(1)).alias("distinct"),
            F.min("first_pos").alias("first_pos"),
            F.max("first_pos").alias("last_first_pos"),
        )
        .withColumn("usable", F.coalesce(code != C.EMPTY, F.lit(False)))
    )

    def cells_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("cells"))), F.lit(0))

    kind_bit = F.coalesce(
        *[F.when(code.isin(codes), F.lit(1 << i)) for i, codes in enumerate(C.KINDS.values())], F.lit(0)
    )
    per_column = tallies.groupBy(*files, "slot").agg(
        F.sum("cells").alias("row_count"),
        cells_where(code.isNull()).alias("null_count"),
        cells_where(code == C.EMPTY).alias("empty_count"),
        F.coalesce(F.sum(F.when(F.col("usable"), F.col("distinct"))), F.lit(0)).alias("unique_count"),
        F.bit_or(kind_bit).alias("kinds"),
        cells_where(code.isin(C.NOT_A_VALID_DATE)).alias("invalid_date_count"),
        # one position per bucket and code
        F.array_sort(F.collect_list(F.when(F.col("usable"), F.col("first_pos")))).alias("seen"),
        F.max(F.when(F.col("usable"), F.col("last_first_pos"))).alias("last_first_pos"),
    )
    per_column = per_column.withColumn("sample_bound", F.coalesce(F.get("seen", F.lit(SAMPLES - 1)), F.col("last_first_pos")))
    measured.append(_named(lines(per_column, F.coalesce(*[F.col(x) for x in files], _literal_at(datasets, "string"))), frames))
    return reduce(DataFrame.unionByName, measured)


def column_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("column_pos") >= 0)


def row_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("column_pos") == ROW_POS)
