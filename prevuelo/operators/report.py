"""The Markdown report, as numbered lines per dataset and as one text per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prevuelo.functions import figures, text, wording
from prevuelo.operators.candidates import listing_order
from prevuelo.sources.files import raw_lines
from prevuelo.sources.shared import written

# Headings and fixed lines of the report, in order.
TITLE = "Auditoría de riesgo de datos"
MODE_LINES = [
    "- **Modo de análisis:** `rules_only`",
    "- Este reporte fue generado mediante reglas determinísticas locales, sin depender de servicios de inteligencia "
    "artificial ni de AWS.",
]
PROFILE_HEAD = [
    "| Nombre | Tipo | Nulos | Vacíos | Únicos | Valores de muestra |",
    "|--------|------|-------|--------|--------|-------------------|",
]
BREAKDOWN_HEAD = ["| Hallazgo | Severidad | Aporte |", "|----------|-----------|--------|"]
NO_FINDINGS = "No se detectaron riesgos en los datos analizados."
NO_CONFIRMED = "No se confirmaron columnas candidatas."
CLOSING = (
    "> **Nota:** El archivo CSV completo no se incorporó a este reporte. El análisis fue ejecutado en modo local "
    "(`rules_only`) utilizando reglas determinísticas sin conexión a servicios externos."
)


def _in_order(order: list[Column], value: Column) -> Column:
    keyed = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
    return F.transform(keyed, lambda e: e["value"])


def _texts(*lines: str | Column) -> Column:
    return F.array(*[F.lit(line) if isinstance(line, str) else line for line in lines])


def _profile_line() -> Column:
    f = F.col
    shown = F.array_join(F.transform("sample_values", text.table_cell), ", ")
    return wording.fill(
        "| {name} | {type} | {nulls} | {empties} | {unique} | {samples} |",
        name=text.table_cell(f("column_name")),
        type=figures.lookup(f("inferred_type"), wording.TYPE_LABEL, strict=True),
        nulls=f("null_count"), empties=f("empty_count"), unique=f("unique_count"),
        samples=F.when(F.size("sample_values") > 0, shown).otherwise("—"),
    )


def _finding_lines() -> Column:
    """The line of a finding in the breakdown, and its own block of lines."""
    f, md = F.col, text.markdown_text
    severity = figures.lookup(f("severity"), wording.SEVERITY_LABEL, strict=True)
    points = wording.fill(
        "| {id} | {severity} | +{points} puntos |",
        id=text.table_cell(f("finding_id")), severity=severity, points=figures.weight_of(f("severity")),
    )
    block = _texts(
        wording.fill("### {text}", text=md(f("description"))), "",
        wording.fill("- **Severidad:** {label}", label=severity),
        wording.fill(
            "- **Categoría:** {label}", label=figures.lookup(f("category"), wording.CATEGORY_LABEL, strict=True)
        ),
        wording.fill("- **Cantidad:** {n}", n=f("count")),
        wording.fill("- **Porcentaje:** {p}%", p=figures.one_decimal(f("percentage"))),
        F.when(F.size("affected_columns") > 0, wording.fill(
            "- **Columnas afectadas:** {names}", names=F.array_join(F.transform("affected_columns", md), ", "),
        )), "",
        "**Explicación basada en reglas:**", "", md(f("rule_based_explanation")), "",
        "**Acción recomendada:**", "", md(f("recommended_action")), "",
    )
    return F.struct(points.alias("points"), block.alias("block"))


def _candidate_lines() -> Column:
    f, md = F.col, text.markdown_text
    return _texts(
        wording.fill("### {name}", name=md(f("column_name"))), "",
        wording.fill(
            "- **Tipo:** {label}", label=figures.lookup(f("candidate_type"), wording.CANDIDATE_LABEL, strict=True)
        ),
        wording.fill(
            "- **Confianza:** {label}", label=figures.lookup(f("confidence"), wording.CONFIDENCE_LABEL, strict=True)
        ),
        wording.fill("- **Razonamiento:** {text}", text=md(f("reasoning"))), "",
    )


def report_lines(
    summaries: DataFrame,
    profiles: DataFrame,
    found: DataFrame,
    scored: DataFrame,
    suggested: DataFrame,
    parse_errors: DataFrame | None = None,
    title: str = TITLE,
) -> DataFrame:
    """(dataset_id, place, line); sorted by ``place`` the lines of a dataset are its report.

    Everything about a dataset is one line of bounded arrays (a column has one profile, at most three findings and one
    candidate), which is spread once. ``parse_errors`` (dataset_id, row, message) may be of any length: its lines are
    rows here and are never gathered.
    """
    f, md = F.col, text.markdown_text
    columns = profiles.groupBy("dataset_id").agg(_in_order([f("column_pos")], _profile_line()).alias("columns"))
    problems = found.groupBy("dataset_id").agg(_in_order([f("rule_pos"), f("column_pos")], _finding_lines()).alias("found"))
    accepted = suggested.filter("confirmed").groupBy("dataset_id")
    accepted = accepted.agg(_in_order(listing_order(), _candidate_lines()).alias("accepted"))
    base = summaries.join(scored.drop("finding_count"), "dataset_id").join(columns, "dataset_id", "left")
    base = base.join(problems, "dataset_id", "left").join(accepted, "dataset_id", "left")

    hits = F.size(F.coalesce("found", F.array()))
    with_hits = lambda line: F.when(hits > 0, line)
    errors = F.when(f("parse_error_count") > 0, wording.fill("- **Errores de parseo:** {n}", n=f("parse_error_count")))
    none = F.array().cast("array<string>")
    head = _texts(
        f"# {title}", "",
        "## Información del análisis", "",
        wording.fill("- **Archivo analizado:** {name}", name=md(f("dataset_id"))), *MODE_LINES, "",
        "## Resumen de estructura", "",
        wording.fill("- **Filas:** {n}", n=f("row_count")),
        wording.fill("- **Columnas:** {n}", n=f("column_count")), errors,
    )
    rest = F.concat(
        _texts("", "## Perfil de columnas", "", *PROFILE_HEAD),
        F.coalesce("columns", none),
        _texts(
            "", "## Puntaje de riesgo", "",
            wording.fill("- **Puntaje total:** {n} / 100", n=f("total")),
            wording.fill("- **Puntaje bruto (sin límite):** {n}", n=f("raw_total")), "",
            *[with_hits(F.lit(line)) for line in ["### Desglose", "", *BREAKDOWN_HEAD]],
        ),
        F.coalesce(F.transform("found", lambda x: x["points"]), none),
        _texts(
            "", "## Hallazgos detectados", "",
            F.coalesce(with_hits(wording.fill("Se detectaron **{n}** hallazgos:", n=hits)), F.lit(NO_FINDINGS)),
            with_hits(F.lit("")),
        ),
        F.coalesce(F.flatten(F.transform("found", lambda x: x["block"])), none),
        _texts("", "## Columnas candidatas confirmadas", "", F.when(f("accepted").isNull(), NO_CONFIRMED)),
        F.coalesce(F.flatten("accepted"), none),
        _texts("", "---", "", CLOSING, ""),
    )
    parts = F.array(F.struct(F.lit(0).alias("part"), head.alias("lines")), F.struct(F.lit(2).alias("part"), rest.alias("lines")))
    spread = base.select("dataset_id", F.inline(parts)).select("dataset_id", "part", F.posexplode("lines").alias("nth", "line"))
    lines = spread.filter(f("line").isNotNull()).select("dataset_id", _place(f("part"), f("nth")), "line")
    if parse_errors is not None:
        message = wording.fill("  - {t}", t=md(text.parse_error_text(f("row"), f("message"))))
        row = F.coalesce(f("row"), F.lit(-1))
        lines = lines.unionByName(parse_errors.select("dataset_id", _place(F.lit(1), row), message.alias("line")))
    return lines


def _place(part: Column, nth: Column) -> Column:
    return F.struct(part.cast("int").alias("part"), nth.cast("bigint").alias("nth")).alias("place")


def report_documents(lines: DataFrame) -> DataFrame:
    """(dataset_id, file_name, document): the whole report as one text.

    A document is one value, so it is gathered whole, parse errors included; ``write_reports``
    streams the lines of reports of any length instead.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return (
        lines.groupBy("dataset_id")
        .agg(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("document"))
        .select("dataset_id", text.report_file_name(F.col("dataset_id")).alias("file_name"), "document")
    )


def write_reports(lines: DataFrame, path: str) -> None:
    """One folder per report below ``path``, ``report=<file name>/dataset=<key>``; its part files, in name order,
    are it. ``_manifest``, written last, names every report with the number of its lines: a report is whole or absent.

    The key keeps datasets apart whose names give the same file name. Lines are range-partitioned by dataset and place,
    so a report of any length is spread over as many tasks as it needs.
    """
    named = lines.withColumn("report", text.report_file_name(F.col("dataset_id")))
    named = written(named.withColumn("dataset", F.lower(F.hex(F.xxhash64("dataset_id")))), "report-lines")
    order = ["report", "dataset", "place"]
    (
        named.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("report", "dataset", "line")
        .write.partitionBy("report", "dataset")
        .text(path)
    )
    # a line may hold a line end of its own
    number = F.sum(F.size(F.split("line", "\n"))).alias("lines")
    named.groupBy("report", "dataset", "dataset_id").agg(number).write.json(f"{path}/_manifest")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, report, place, line) of the whole reports below ``path``."""
    manifest = spark.read.schema("report string, dataset string, dataset_id string, lines long").json(f"{path}/_manifest")
    read = raw_lines(spark, path).withColumn("dataset", F.regexp_extract("file", "dataset=([0-9a-f]+)/", 1))
    place = F.struct(F.element_at(F.split("file", "/"), -1).alias("file"), "block", "row").alias("place")
    read = read.select("dataset", place, F.col("value").alias("line"))
    whole = read.groupBy("dataset").agg(F.count(F.lit(1)).alias("lines")).join(manifest, ["dataset", "lines"])
    return read.join(whole, "dataset").select("dataset_id", "report", "place", "line")
