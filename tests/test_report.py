import pytest
from pyspark.sql import functions as F

from prevuelo.functions import figures, text
from prevuelo.operators.report import write_reports
from prevuelo.plans.audit import audit, audit_csv
from prevuelo.sources.files import file_name


def apply(spark, function, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").coalesce(1).orderBy("i")
    return [r.out for r in df.select(function(F.col("v")).alias("out")).collect()]


def test_escapes(spark):
    raw = ["", "a|b", "x\ny\r\nz", "# uno\n## dos\n a # b", "a_b*c`d[e]\\f", "a\rb"]
    assert apply(spark, text.table_cell, raw) == ["—", "a\\|b", "x y z", "# uno ## dos  a # b", "a_b*c`d[e]\\f", "ab"]
    assert apply(spark, text.markdown_text, raw) == [
        "—", "a|b", "x\ny\nz", "\\# uno\n\\## dos\n a # b", "a\\_b\\*c\\`d\\[e\\]\\\\f", "a\nb",
    ]


@pytest.mark.parametrize(
    "name, expected",
    [
        (" clientes.csv ", "clientes-pipeline-risk-report.md"),
        ("CLIENTES.CSV ", "CLIENTES-pipeline-risk-report.md"),
        (" .csv ", "pipeline-risk-report.md"),
        ("datos", "datos-pipeline-risk-report.md"),
        ("", "pipeline-risk-report.md"),
        ('a<b>:"c/d\\e|f?*.csv', "a-b-c-d-e-f--pipeline-risk-report.md"),
        ("fin. . .csv", "fin-pipeline-risk-report.md"),
    ],
)
def test_file_names(spark, name, expected):
    assert apply(spark, text.report_file_name, [name]) == [expected]


def test_numbers(spark):
    ties = [0.25, 0.75, 12.25, 99.75, 5.0, 100.0, 0.0, 33.333333333333336, 0.15, 0.45]
    assert apply(spark, figures.one_decimal, ties, "double") == [
        "0.3", "0.8", "12.3", "99.8", "5.0", "100.0", "0.0", "33.3", "0.1", "0.5",
    ]
    assert apply(spark, figures.plain_number, [40.0, 33.3, 0.0, 100.0], "double") == ["40", "33.3", "0", "100"]


def test_unknown_code_is_an_error(spark):
    with pytest.raises(Exception, match="Valor no soportado"):
        apply(spark, lambda c: figures.lookup(c, {"a": "A"}, strict=True), ["z"])


def test_whole_document(spark, text_frame):
    frame = text_frame(["id", "no_te"], [("1", "a|b"), ("2", ""), ("3", "x")], "datos.csv")
    verdicts = spark.createDataFrame([("datos.csv", "id", "confirm")], "dataset_id string, column_name string, decision string")
    report = audit(frame).reports(verdicts).first()
    assert report.file_name == "datos-pipeline-risk-report.md"
    lines = report.document.split("\n")
    assert lines[:5] == ["# Auditoría de riesgo de datos", "", "## Información del análisis", "", "- **Archivo analizado:** datos.csv"]
    at = lines.index("## Perfil de columnas")
    assert lines[at - 3 : at + 8] == [
        "- **Filas:** 3", "- **Columnas:** 2", "", "## Perfil de columnas", "",
        "| Nombre | Tipo | Nulos | Vacíos | Únicos | Valores de muestra |",
        "|--------|------|-------|--------|--------|-------------------|",
        "| id | Número | 0 | 0 | 3 | 1, 2, 3 |",
        "| no_te | Texto | 0 | 1 | 2 | a\\|b, x |",
        "", "## Puntaje de riesgo",
    ]
    at = lines.index("### Desglose")
    assert lines[at : at + 10] == [
        "### Desglose", "", "| Hallazgo | Severidad | Aporte |", "|----------|-----------|--------|",
        "| empties-no_te | Alto | +20 puntos |", "", "## Hallazgos detectados", "",
        "Se detectaron **1** hallazgos:", "",
    ]
    assert '### La columna "no\\_te" contiene 1 valores vacíos (33.3%).' in lines
    at = lines.index("## Columnas candidatas confirmadas")
    assert lines[at : at + 5] == ["## Columnas candidatas confirmadas", "", "### id", "", "- **Tipo:** Clave primaria"]
    assert lines[-1] == "" and lines[-2].startswith("> **Nota:**") and lines[-4] == "---"


def test_clean_dataset(spark, text_frame):
    document = audit(text_frame(["x"], [("1",), ("2",)])).reports().first().document
    assert "No se detectaron riesgos en los datos analizados.\n\n## Columnas" in document
    assert "No se confirmaron columnas candidatas.\n\n---" in document
    assert "- **Puntaje bruto (sin límite):** 0\n\n\n## Hallazgos detectados" in document


def test_reports_of_many_errors_are_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n" + "7\n" * 20_000)
    a = audit_csv(spark, str(tmp_path), sep=",", dataset_id=file_name)
    assert a.reports().first().document.count("  - Fila ") == 20_000


def test_reports_of_one_file_name_stay_apart(spark, text_frame, tmp_path):
    a = audit(text_frame(["x"], [("1",)], "a/b.csv"), text_frame(["y"], [("1",), ("2",)], "a-b.csv"))
    write_reports(a.report_lines(), str(tmp_path / "out"))
    found = sorted((tmp_path / "out").glob("report=*/dataset=*"))
    assert len(found) == 2 and len({p.parent for p in found}) == 1
    texts = ["".join(p.read_text(encoding="utf-8") for p in sorted(d.glob("part-*"))) for d in found]
    assert sorted(t.count("- **Filas:** 1") for t in texts) == [0, 1]


def test_written_reports_hold_parse_errors(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,x\n1,2\n" + "7\n" * 300)
    (folder / "b.csv").write_text("id,x\n1,2\n")
    a = audit_csv(spark, str(folder), dataset_id=file_name)
    write_reports(a.report_lines(), str(tmp_path / "out"))
    for name in ["a", "b"]:
        parts = sorted((tmp_path / "out" / f"report={name}-pipeline-risk-report.md").glob("dataset=*/part-*"))
        written = "".join(p.read_text(encoding="utf-8") for p in parts)
        whole = a.reports().filter(f"dataset_id = '{name}.csv'").first().document
        assert written == whole + "\n"
    assert whole.count("Fila ") == 0
    assert a.reports().filter("dataset_id = 'a.csv'").first().document.count("  - Fila ") == 301  # and the separator
