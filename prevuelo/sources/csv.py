"""CSV files as rows of cells: text, missing told from empty, malformed lines on record.

One listing and one pass over the raw lines tell what each file is: whether it can be read, its separator, its header,
and whether a quoted cell runs over a line end in it. These facts are a table, a line per file, and every scan of lines is
joined with it; so one plan reads any number of files and headers. A file is always read split by split: lines of files
whose quoted cells run over line ends are put together by ``quoting``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prevuelo.functions import wording
from prevuelo.functions.cells import is_usable
from prevuelo.sources.files import QUOTED, admit, inspect_text, list_files, position_in_file, raw_lines, scanned_file
from prevuelo.sources.frames import Frame, Records
from prevuelo.sources.quoting import assemble
from prevuelo.sources.shared import written

# Separators that are tried, in order of preference.
SEPARATORS = [",", "\t", "|", ";", "\x1e", "\x1f"]

# Messages about lines that do not fit the header, and about the separator.
TOO_FEW = "Too few fields: expected {width} fields but parsed {tokens}"
TOO_MANY = "Too many fields: expected {width} fields but parsed {tokens}"
BAD_QUOTES = "Malformed quotes"
NO_SEPARATOR = "Unable to auto-detect delimiting character; defaulted to ','"

# Fixed value: fields a line that a detected comma gives on average, over all lines.
_LEAST_MEAN = 1.99

_GLOB = "*.[cC][sS][vV]"
_ACCEPTED = "accepted"


@dataclass(frozen=True)
class CsvScan:
    """``frame`` over the accepted files, their ``parse_errors`` (dataset_id, row, message) and
    ``files`` (path, dataset_id, status, error): accepted, or why not."""

    frame: Frame | None
    parse_errors: DataFrame
    files: DataFrame


def detect_separator(lines: list[str]) -> str | None:
    """The separator of lines at hand, by the rule that ``survey`` applies to all lines of a file: of those that cut the
    first line into two or more fields, the one by which most lines have as many fields as the first."""
    bare = [re.sub(QUOTED, "q", line) for line in lines if line]
    scored = []
    for rank, sep in enumerate(SEPARATORS):
        widths = [line.count(sep) + 1 for line in bare]
        if widths and widths[0] > 1:
            scored.append((widths.count(widths[0]), widths[0], -rank, sep))
    return max(scored)[3] if scored else None


def _literal(sep: str) -> str:
    return f"\\x{ord(sep):02x}"


def _field(sep: str) -> str:
    """Pattern of a field whose quotes, if it begins with one, are closed; what stands behind them belongs to it."""
    return rf'(?:{QUOTED}[^{_literal(sep)}]*+|[^"{_literal(sep)}][^{_literal(sep)}]*+|)'


def _complete_line(sep: str) -> str:
    """Pattern of a line that, begun outside quotes, also ends outside quotes."""
    return rf"^(?:{_field(sep)}{_literal(sep)})*+{_field(sep)}\z"


def _closing_line(sep: str) -> str:
    """Pattern of a line that, begun inside quotes, ends outside of them."""
    s = _literal(sep)
    return rf'^[^"]*+(?:""[^"]*+)*+"[^{s}]*+(?:{s}{_field(sep)})*+\z'


def _by_separator(expr: Callable[[str], str], seps: list[str]) -> str:
    """SQL text of ``expr`` for the separator of the row's file."""
    return "CASE " + " ".join(f"WHEN sep = '{_literal_sql(s)}' THEN {expr(s)}" for s in seps) + " END"


def _literal_sql(sep: str) -> str:
    return f"\\u{ord(sep):04x}"


def _fields(sep: str) -> str:
    """Fields of ``text`` as written. Lines without quotes are cut plainly."""
    s = _literal(sep)
    every = rf'{s}(?:"[^"]*+(?:""[^"]*+)*+(?:"[^{s}]*+|\z)|[^{s}]*+)'
    quoted = f"transform(regexp_extract_all(concat('{_literal_sql(sep)}', text), r'{every}', 0), f -> substring(f, 2))"
    return f"CASE WHEN contains(text, '\"') THEN {quoted} ELSE split(text, r'{s}', -1) END"


# the text of a quoted field (blanks behind the quotes do not count), or of one that its file's end leaves open
_INNER = r'^"([^"]*+(?:""[^"]*+)*+)(?:" *)?\z'
_CLOSED = r'^(?:[^"]|\z|"[^"]*+(?:""[^"]*+)*+" *\z)'


def _cell(field: str) -> str:
    inner = f"""replace(regexp_extract({field}, r'{_INNER}', 1), '""', '"')"""
    return f"CASE WHEN startswith({field}, '\"') AND {field} RLIKE r'{_INNER}' THEN {inner} ELSE {field} END"


def _without_return(text: str) -> str:
    return f"CASE WHEN endswith({text}, '\\r') THEN left({text}, length({text}) - 1) ELSE {text} END"


def _separators(seen: DataFrame, sep: str | None) -> DataFrame:
    """``seen`` files with ``sep``, their separator, and ``detected``: whether there was one to find."""
    if sep is not None:
        return seen.select("*", F.lit(sep).alias("sep"), F.lit(True).alias("detected"))
    bare = F.regexp_replace(F.regexp_replace("first_line", QUOTED, "q"), r"\r(?s:.*)\z", "")

    def choice(i: int, s: str) -> Column:
        width = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(s), F.lit(""))) + 1
        alike = F.filter(F.get("widths", F.lit(i)), lambda b: F.abs(b["x"] - width) < 0.5)
        votes = F.aggregate(alike, F.lit(0.0), lambda n, b: n + b["y"].cast("double"))
        lines = F.aggregate(F.get("widths", F.lit(i)), F.lit(0.0), lambda n, b: n + b["y"].cast("double"))
        fields = F.aggregate(F.get("widths", F.lit(i)), F.lit(0.0), lambda n, b: n + b["y"].cast("double") * b["x"])
        told = [votes.alias("votes"), width.alias("width"), F.lit(-i).alias("rank"), F.lit(s).alias("sep"), (fields / lines).alias("mean")]
        return F.when(width > 1, F.struct(*told))

    choices = [choice(i, s) for i, s in enumerate(SEPARATORS)]
    best = F.array_max(F.array_compact(F.array(*choices)))
    seen = seen.withColumn("best", best).withColumn("sep", F.coalesce("best.sep", F.lit(SEPARATORS[0])))
    # a comma that most lines do without is the default, not a find; lines within cells tell nothing
    sure = (F.col("sep") != SEPARATORS[0]) | F.element_at("whole_file", F.col("sep")) | (F.col("best.mean") > _LEAST_MEAN)
    return seen.withColumn("detected", F.coalesce(F.col("best").isNotNull() & sure, F.lit(False))).drop("best")


def _stored_lines(lines: DataFrame, torn: DataFrame, seps: list[str]) -> DataFrame:
    """(file, block, row, value, opens, stays) of the files whose lines must be put together."""
    found = lines.join(torn.select("file", "sep", "returns"), "file")
    # files that end their lines with carriage returns alone come as one text
    cut = F.posexplode(F.when(F.col("returns"), F.split("value", "\r")).otherwise(F.array("value")))
    found = found.select("file", "block", "row", "sep", "returns", cut.alias("nth", "value"))
    found = found.withColumn("row", F.when(F.col("returns"), F.col("nth").cast("bigint")).otherwise(F.col("row")))
    quoted = F.contains("value", F.lit('"'))
    opens = F.when(quoted, ~F.expr(_by_separator(lambda s: f"value RLIKE r'{_complete_line(s)}'", seps)))
    stays = F.when(quoted, ~F.expr(_by_separator(lambda s: f"value RLIKE r'{_closing_line(s)}'", seps)))
    return written(found.select("file", "block", "row", "value", opens.alias("opens"), stays.alias("stays")), "lines")


@dataclass(frozen=True)
class Survey:
    """What the files below ``path`` are.

    ``files``, a stored line for each: path, file, dataset_id, status, error, sep, detected, torn, width. ``headers``
    (dataset_id, column_pos, column_name), stored. ``records`` (file, pos, text, header) of the files whose lines had to
    be put together, stored, or None.
    """

    spark: SparkSession
    path: str | list[str]
    seps: list[str]
    files: DataFrame
    headers: DataFrame
    records: DataFrame | None

    @property
    def accepted(self) -> DataFrame:
        return self.files.where(F.col("status") == _ACCEPTED).select("file", "dataset_id", "sep", "width", "torn")

    @property
    def verdicts(self) -> DataFrame:
        return self.files.select("path", "dataset_id", "status", "error")


def survey(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    dataset_id: Callable[[Column], Column] | None = None,
    max_bytes: int | None = None,
    one_header: bool = False,
) -> Survey:
    """What each file below ``path`` is. The files of a dataset (with ``one_header``: all) must share the header of the
    first one by path; others are ``other_header``."""
    f, seps = F.col, [sep] if sep else SEPARATORS
    listed = admit(list_files(spark, path), max_bytes)
    seen = inspect_text(spark, path, {s: _complete_line(s) for s in seps}, "" if sep else "".join(SEPARATORS), _GLOB)
    seen = _separators(seen.drop("path"), sep)
    inner = f("first_line").rlike(r"\r(?!\z)")
    # a first line of blanks is a header that the line reader would pass over
    torn = F.element_at("whole_file", f("sep")) | ~f("first_line").rlike(r"[^\x00-\x20]") | inner
    seen = seen.withColumn("returns", inner & (f("n_lines") == 1)).withColumn("torn", F.coalesce(torn, F.lit(False)))
    told = listed.join(seen, "file", "left")
    verdicts = [
        (f("status") != "admitted", f("status"), f("error")),
        (~f("valid_utf8"), F.lit("encoding"), F.lit(wording.ENCODING_ERROR)),
        (f("first_line").isNull(), F.lit("no_data"), F.lit(wording.NO_DATA_ERROR)),
    ]
    told = told.withColumns(
        {
            "status": F.coalesce(*[F.when(bad, status) for bad, status, _ in verdicts], F.lit(_ACCEPTED)),
            "error": F.coalesce(*[F.when(bad, error) for bad, _, error in verdicts]),
            "dataset_id": (dataset_id or (lambda p: p))(f("path")),
        }
    )
    kept = ["path", "file", "dataset_id", "status", "error", "first_line", "sep", "detected", "returns", "torn"]
    told = written(told.select(*kept), "files")

    accepted = told.where(f("status") == _ACCEPTED)
    heads = accepted.where("NOT torn").select("file", "sep", F.expr(_without_return("first_line")).alias("text"))
    records = None
    if not accepted.where("torn").isEmpty():
        texts = assemble(_stored_lines(raw_lines(spark, path, _GLOB), accepted.where("torn"), seps))
        records = written(texts.withColumn("text", F.expr(_without_return("text"))), "records")
        first = records.groupBy("file").agg(F.min("pos").alias("first"))
        records = records.join(first, "file").select("file", "pos", "text", (f("pos") == f("first")).alias("header"))
        heads = heads.unionByName(records.where("header").join(accepted.select("file", "sep"), "file").select("file", "sep", "text"))
    heads = heads.select("file", F.explode(F.array(F.expr(_by_separator(_fields, seps)))).alias("fields"))
    heads = heads.select("file", F.expr(f"transform(fields, f -> {_cell('f')})").alias("names"))
    named = told.join(heads, "file", "left").withColumn("of", F.lit("") if one_header else f("dataset_id"))
    leads = named.where(f("status") == _ACCEPTED).groupBy("of").agg(F.min(F.struct("path", "names", "dataset_id")).alias("lead"))
    named = named.join(leads, "of", "left")
    named = named.withColumn("status", F.when((f("status") == _ACCEPTED) & (f("names") != f("lead.names")), "other_header").otherwise(f("status")))
    named = named.withColumn("width", F.size("names")).withColumn("torn", f("torn") & (f("status") == _ACCEPTED))
    files = written(named.select("path", "file", "dataset_id", "status", "error", "sep", "detected", "torn", "width", "names"), "files")
    of_dataset = files.where(f("status") == _ACCEPTED).groupBy("dataset_id").agg(F.min("names").alias("names"))
    headers = of_dataset.select("dataset_id", F.posexplode("names").alias("column_pos", "column_name"))
    return Survey(spark, path, seps, files.drop("names"), written(headers, "headers"), records)


def _data_lines(found: Survey) -> DataFrame:
    """(file, dataset_id, sep, width, pos, text) of all lines but headers; lines of blanks may be gone."""
    # the reader passes over each file's header, wherever the splits are; it is made to see no fields and no quotes
    options = {"sep": "\uffff", "quote": "", "lineSep": "\n", "header": "true", "encoding": "UTF-8", "maxCharsPerColumn": "-1"}
    read = found.spark.read.schema("value string, bad string").options(**options, columnNameOfCorruptRecord="bad", columnPruning="false")
    read = read.options(recursiveFileLookup="true", pathGlobFilter=_GLOB).csv(found.path)
    text = F.coalesce("bad", "value")
    block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    lines = read.select(scanned_file().alias("file"), position_in_file(block, row).alias("pos"), text.alias("text"))
    lines = lines.join(found.accepted.where("NOT torn").drop("torn"), "file").withColumn("text", F.expr(_without_return("text")))
    if found.records is not None:
        torn = found.records.where("NOT header").drop("header").join(found.accepted.where("torn").drop("torn"), "file")
        lines = lines.unionByName(torn)
    return lines


def _rows(found: Survey) -> Records:
    # a generator in between: the fields are worked out once, whatever reads them
    fields = _data_lines(found).select("dataset_id", "pos", "width", F.explode(F.array(F.expr(_by_separator(_fields, found.seps)))).alias("fields"))
    cells = f"transform(slice(fields, 1, width), f -> {_cell('f')})"
    cells = f"slice(concat({cells}, array_repeat(CAST(NULL AS STRING), width)), 1, width)"
    rows = fields.select(F.col("dataset_id").alias("dataset"), "pos", F.explode(F.array(F.expr(cells))).alias("cells"))
    return Records(rows.filter(f"exists(cells, v -> {is_usable('v')})"), found.headers)


def _parse_errors(found: Survey) -> DataFrame:
    """(dataset_id, row, message) per malformed record; ``row`` counts a file's records from 0, the header aside.

    Row numbers come from one small line per file split and from the few lines that are no records, not from a sort.
    """
    f, in_split = F.col, Window.partitionBy("file", "block").orderBy("row")
    lines = raw_lines(found.spark, found.path, _GLOB).join(found.accepted.where("NOT torn"), "file")
    lines = lines.withColumn("text", F.expr(_without_return("value"))).withColumn("record", f("text") != "")
    kept = ["dataset_id", "file", "block", "row", "sep", "width", "text"]
    counted = lines.groupBy("file", "block").agg(F.count_if("record").alias("records"), F.min("row").alias("first"))
    told = _messages(lines.where("record").select(*kept), found.seps)
    gaps = lines.where("NOT record").select("dataset_id", "file", "block", "row", F.lit(None).cast("string").alias("message"))
    gaps_before = F.count_if(f("message").isNull()).over(in_split)
    told = told.unionByName(gaps).withColumn("gaps", gaps_before).where("message IS NOT NULL")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("offset", F.coalesce(F.sum("records").over(before), F.lit(0))).drop("records")
    told = told.join(offsets, ["file", "block"]).select("dataset_id", (f("offset") + f("row") - f("first") - f("gaps") - 1).alias("row"), "message")
    if found.records is not None:
        # these are records already: number them within the split in which they begin
        torn = found.records.join(found.accepted.where("torn"), "file").withColumn("block", F.shiftright("pos", 33))
        counted = torn.groupBy("file", "block").agg(F.count(F.lit(1)).alias("records"))
        offsets = counted.withColumn("offset", F.coalesce(F.sum("records").over(before), F.lit(0))).drop("records")
        narrow = _messages(torn.withColumn("row", f("pos")), found.seps, all_lines=True)
        narrow = narrow.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("row"))).where("message IS NOT NULL")
        narrow = narrow.join(offsets, ["file", "block"]).select("dataset_id", (f("offset") + f("nth") - 2).alias("row"), "message")
        told = told.unionByName(narrow)
    lone = found.files.where((f("status") == _ACCEPTED) & ~f("detected"))
    lone = lone.select("dataset_id", F.lit(None).cast("bigint").alias("row"), F.lit(NO_SEPARATOR).alias("message"))
    return told.where("row >= 0").unionByName(lone)


def _messages(lines: DataFrame, seps: list[str], all_lines: bool = False) -> DataFrame:
    """(dataset_id, file, block, row, message) of malformed lines, or of all."""
    f = F.col
    fields = lines.select("dataset_id", "file", "block", "row", "width", F.explode(F.array(F.expr(_by_separator(_fields, seps)))).alias("fields"))
    tokens = F.size("fields")
    message = (
        F.when(tokens < f("width"), wording.fill(TOO_FEW, width=f("width"), tokens=tokens))
        .when(tokens > f("width"), wording.fill(TOO_MANY, width=f("width"), tokens=tokens))
        .when(F.expr(f"exists(fields, f -> NOT f RLIKE r'{_CLOSED}')"), BAD_QUOTES)
    )
    told = fields.select("dataset_id", "file", "block", "row", message.alias("message"))
    return told if all_lines else told.where("message IS NOT NULL")


@dataclass(frozen=True)
class CsvFiles:
    """``records`` of all accepted files, their ``parse_errors`` and the verdicts on all ``files``."""

    records: Records
    parse_errors: DataFrame
    files: DataFrame


def read_all(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    dataset_id: Callable[[Column], Column] | None = None,
    max_bytes: int | None = None,
) -> CsvFiles:
    """All CSV files below ``path`` in one plan, whatever their headers and separators.

    Every file is a dataset of its own, named by ``dataset_id`` from its path (the path itself by default).
    """
    found = survey(spark, path, sep, dataset_id, max_bytes)
    return CsvFiles(_rows(found), _parse_errors(found), found.verdicts)


def read_group(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    dataset_id: Callable[[Column], Column] | None = None,
    max_bytes: int | None = None,
) -> CsvScan:
    """The CSV files below ``path`` that share the header of the first readable one.

    Files with bad bytes or another header are not read; they are listed in ``files``.  ``frame`` is None when no file
    can be read.
    """
    found = survey(spark, path, sep, dataset_id, max_bytes, one_header=True)
    lead = found.headers.select("dataset_id").first()
    if lead is None:
        return CsvScan(None, spark.createDataFrame([], "dataset_id string, row bigint, message string"), found.verdicts)
    rows = _rows(found)
    return CsvScan(rows.frame_of(rows.names_of(lead.dataset_id)), _parse_errors(found), found.verdicts)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    dataset_id: Callable[[Column], Column] | None = None,
    max_bytes: int | None = None,
) -> CsvScan:
    """``read_group``, but an error when there is nothing to read."""
    scan = read_group(spark, path, sep, dataset_id, max_bytes)
    if scan.frame is None:
        raise ValueError(refusal(scan.files))
    return scan


def refusal(files: DataFrame) -> str:
    """The error of the first refused file."""
    refused = files.filter("error IS NOT NULL").orderBy("path").first()
    return refused.error if refused else wording.NO_DATA_ERROR
