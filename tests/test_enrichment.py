import copy
import json

import pytest
from pyspark.sql import functions as F

from prevuelo.operators import enrichment as E

COLUMNS = [{"name": "id", "inferredType": "number"}, {"name": "nombre", "inferredType": "string"}]
FINDING = {"id": "nulls-nombre", "category": "nulls", "severity": "alto", "description": "d", "count": 25, "percentage": 25.0}
KEY = {"columnName": "id", "candidateType": "primary_key", "confidence": "alta"}


def payload(**changes):
    body = copy.deepcopy({
        "structureSummary": {"rowCount": 100, "columnCount": 2, "columns": COLUMNS},
        "findings": [FINDING],
        "candidates": [KEY],
        "riskScore": 20,
    })
    for path, value in changes.items():
        *parents, last = path.split("__")
        target = body
        for p in parents:
            target = target[int(p) if p.isdigit() else p]
        if value is ...:
            del target[last]
        else:
            target[last] = value
    return json.dumps(body)


def with_finding(**changes):
    return payload(findings=[FINDING, {k: v for k, v in {**FINDING, **changes}.items() if v is not ...}])


CONTRACT = [
    (payload(), None),
    (payload(riskScore=0), None),
    (payload(riskScore=100), None),
    (payload(structureSummary__rowCount=3.0), None),
    (with_finding(percentage=...), None),
    ("not json", "El cuerpo de la solicitud no es JSON válido."),
    ("", "El cuerpo de la solicitud no es JSON válido."),
    (None, "El cuerpo de la solicitud no es JSON válido."),
    ("null", "El payload debe ser un objeto JSON."),
    ('"text"', "El payload debe ser un objeto JSON."),
    ("[]", "El campo structureSummary es requerido y debe ser un objeto."),
    (payload(structureSummary=...), "El campo structureSummary es requerido y debe ser un objeto."),
    (payload(structureSummary__rowCount=1.5), "structureSummary.rowCount debe ser un entero finito no negativo."),
    (payload(structureSummary__columnCount=-1), "structureSummary.columnCount debe ser un entero finito no negativo."),
    (payload(structureSummary__columns="x"), "structureSummary.columns debe ser un arreglo."),
    (payload(structureSummary__columns=[COLUMNS[0], {"name": 5, "inferredType": "x"}]),
     "structureSummary.columns[1] debe tener name e inferredType como strings."),
    (payload(findings=...), "El campo findings es requerido y debe ser un arreglo."),
    (payload(findings=[None]), "findings[0] no puede ser nulo."),
    (payload(findings=[7]), "findings[0].id debe ser un string."),
    (with_finding(id=7), "findings[1].id debe ser un string."),
    (with_finding(category=None), "findings[1].category debe ser un string."),
    (with_finding(severity="critico"), "findings[1].severity debe ser alto, medio o bajo."),
    (with_finding(description=...), "findings[1].description debe ser un string."),
    (with_finding(count="1"), "findings[1].count debe ser un entero finito no negativo."),
    (with_finding(percentage=None), "findings[1].percentage debe ser un número finito entre 0 y 100."),
    (with_finding(percentage=100.5), "findings[1].percentage debe ser un número finito entre 0 y 100."),
    (payload(candidates={}), "El campo candidates es requerido y debe ser un arreglo."),
    (payload(candidates=[KEY, ""]), "candidates[1] no puede ser nulo."),
    (payload(candidates__0__columnName=1), "candidates[0].columnName debe ser un string."),
    (payload(candidates__0__candidateType="x"),
     "candidates[0].candidateType debe ser primary_key, business_key o incremental_marker."),
    (payload(candidates__0__confidence=...), "candidates[0].confidence debe ser un string."),
    (payload(riskScore=150), "El campo riskScore debe ser un número finito entre 0 y 100."),
    (payload(riskScore=-5), "El campo riskScore debe ser un número finito entre 0 y 100."),
    (payload(riskScore="20"), "El campo riskScore debe ser un número finito entre 0 y 100."),
    ("é" * 32769, "El payload excede el tamaño máximo de 64 KB."),
]


def test_payload_contract(spark):
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(CONTRACT)], "i int, payload string")
    got = {r.i: r.error for r in E.payload_errors(df).collect()}
    assert got == {i: error for i, (_, error) in enumerate(CONTRACT)}


def test_own_payloads_keep_the_contract(spark, text_frame):
    from prevuelo.plans.audit import audit

    rows = [(str(i), None if i % 3 else "x", 'a "quoted" \\ ñ') for i in range(30)]
    sent = audit(text_frame(["id", "updated_at", 'na"me_'], rows)).payloads
    assert E.payload_errors(sent).first().error is None
    body = json.loads(sent.first().payload)
    assert body["structureSummary"]["columns"][2] == {"name": 'na"me_', "inferredType": "string"}
    assert body["findings"][0]["percentage"] == 66.7 and body["riskScore"] == 20 + 20


def test_prompt(spark, text_frame):
    from prevuelo.plans.audit import audit

    rows = [("1", None, "x"), ("2", "a", "x")]
    prompt = audit(text_frame(["id", "col name!@#", "a" * 200], rows)).prompts.first().prompt
    assert f"- Nombres de columnas: id, colname, {'a' * 128}\n" in prompt
    assert 'inventar otros: ["nulls-col name!@#"]' in prompt
    assert "EXACTAMENTE 1 explicaciones" in prompt and "Puntaje de riesgo: 20/100\nClasificación de riesgo: bajo" in prompt
    assert "- [nulls-col name!@#] Severidad: alto, Categoría: nulls, Cantidad: 1, Porcentaje: 50%, " in prompt
    assert "Columnas candidatas (1):\n- id: primary_key (confianza: alta)\n<|USER_DATA_END|>" in prompt


@pytest.mark.parametrize("total, level", [(0, "bajo"), (29, "bajo"), (30, "medio"), (59, "medio"), (60, "alto"), (100, "alto")])
def test_risk_level(spark, total, level):
    from prevuelo.functions.figures import risk_level

    assert spark.range(1).select(risk_level(F.lit(total)).alias("l")).first().l == level


REPLIES = [
    ({"status": "completed", "output": [{"type": "message", "content": [{"type": "output_text", "text": "Hola"}]}]}, ("ok", "Hola")),
    ({"status": "completed", "output": [
        {"type": "reasoning", "content": [{"type": "output_text", "text": "no"}]},
        {"type": "message"},
        {"type": "message", "content": [{"type": "reasoning_text", "text": "no"}, {"type": "output_text", "text": "a"}]},
        {"type": "message", "content": [{"type": "output_text", "text": "b"}]},
    ]}, ("ok", "ab")),
    ({"status": "failed", "error": {"message": "x"}, "output": []}, ("not_completed", None)),
    ({"status": "completed", "output": []}, ("no_text", None)),
    ({"status": "completed", "output": [{"type": "message", "content": [{"type": "output_text", "text": ""}]}]}, ("no_text", None)),
]


def test_reply_texts(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(REPLIES)] + [(9, "{")], "i int, reply string")
    got = {r.i: (r.reply_status, r.answer) for r in E.reply_texts(df).collect()}
    assert got == {**{i: e for i, (_, e) in enumerate(REPLIES)}, 9: ("not_completed", None)}


@pytest.fixture
def found(spark):
    rows = [
        ("a", 0, 0, " nulls-x ", "nulls", "alto", "desc", 5, 25.0, "regla", "hacer"),
        ("a", 1, 0, "empties-x", "empties", "bajo", "desc", 1, 0.5, "regla", "hacer"),
        ("b", 0, 0, "nulls-y", "nulls", "medio", "otra", 7, 6.25, "propia", "revisar"),
    ]
    schema = (
        "dataset_id string, rule_pos int, column_pos int, finding_id string, category string, severity string,"
        " description string, count long, percentage double, rule_based_explanation string, recommended_action string"
    )
    return spark.createDataFrame(rows, schema)


def entry(id_, **texts):
    return {"findingId": id_, "technicalImpact": "I", "contextualExplanation": "C", "correctiveAction": "A", "priority": "high", **texts}


def merge(spark, found, body):
    text = body if isinstance(body, str) else "```json\n" + json.dumps(body) + "\n```"
    answers = spark.createDataFrame([("a", text)], "dataset_id string, answer string")
    return {(r.dataset_id, r.finding_id): tuple(r)[4:] for r in E.merge_explanations(found, answers).collect()}


FALL_X = ("Hallazgo {} requiere revisión.", "Categoría {} con {} ocurrencias.",
          "Revisar la fuente de datos y considerar validaciones adicionales.", "medium", "ai")


def test_merge_by_trimmed_id_first_wins(spark, found):
    got = merge(spark, found, {"explanations": [
        None, 5, "x", {"findingId": 3}, entry("desconocido"), entry("nulls-x", priority="critical"), entry("  nulls-x", technicalImpact="Z"),
    ]})
    assert got[("a", " nulls-x ")] == ("I", "C", "A", "critical", "ai")
    assert got[("a", "empties-x")][:2] == ("Hallazgo empties-x requiere revisión.", "Categoría empties con 1 ocurrencias.")
    assert got[("a", "empties-x")][2:] == FALL_X[2:]
    assert got[("b", "nulls-y")] == (None, "propia", "revisar", None, "rules")


def test_merge_field_fallbacks(spark, found):
    got = merge(spark, found, {"explanations": [
        {"findingId": "nulls-x", "technicalImpact": 1, "contextualExplanation": "", "correctiveAction": "  ", "priority": "urgent"},
    ]})
    impact, context, action, priority, source = got[("a", " nulls-x ")]
    assert impact == "Hallazgo  nulls-x  requiere revisión." and context == "Categoría nulls con 5 ocurrencias."
    assert (action, priority, source) == ("  ", "medium", "ai")


@pytest.mark.parametrize("answer", ["no hay nada", "{ roto", ""])
def test_unreadable_answers_fall_back_to_the_rules(spark, found, answer):
    got = merge(spark, found, answer)
    assert {v[-1] for v in got.values()} == {"rules"}
    assert got[("a", "empties-x")] == (None, "regla", "hacer", None, "rules")


def test_one_answer_counts(spark, found):
    good = json.dumps({"explanations": [entry("nulls-x")]})
    answers = spark.createDataFrame([("a", "nada"), ("a", good), ("a", "x" + good)], "dataset_id string, answer string")
    got = E.merge_explanations(found, answers).collect()
    assert len(got) == 3 and {r.finding_id: r.technical_impact for r in got}[" nulls-x "] == "I"
    assert E.ignored_answers(found, answers).count() == 0


def test_last_of_repeated_keys_counts(spark, found):
    got = merge(spark, found, '{"explanations":1,"explanations":[{"findingId":"nulls-x","technicalImpact":"a","technicalImpact":"b"}]}')
    assert got[("a", " nulls-x ")][0] == "b"
    df = spark.createDataFrame([(payload()[:-1] + ', "riskScore": 30}',), (payload()[:-1] + ', "riskScore": 300}',)], "payload string")
    assert [r.error for r in E.payload_errors(df).collect()] == [None, "El campo riskScore debe ser un número finito entre 0 y 100."]


def test_answers_without_explanations_still_count(spark, found):
    got = merge(spark, found, {"explanations": "x"})
    assert got[("a", "empties-x")][-1] == "ai"


def test_ignored_answers(spark, found):
    text = json.dumps({"explanations": [entry("nulls-x"), entry("otro"), entry("otro")]})
    answers = spark.createDataFrame([("a", text)], "dataset_id string, answer string")
    assert [r.answer_key for r in E.ignored_answers(found, answers).collect()] == ["otro"]


def test_executive_summaries(spark):
    scored = spark.createDataFrame(
        [(d, 70, 70, 4, "alto") for d in "abcd"], "dataset_id string, total long, raw_total long, finding_count long, risk_level string"
    )
    answers = spark.createDataFrame(
        [("a", '{"executiveSummary":"","overallRiskAssessment":"ok"}'), ("b", '{"executiveSummary":5}'), ("c", "nada")],
        "dataset_id string, answer string",
    )
    got = {r.dataset_id: tuple(r)[1:] for r in E.merge_summaries(scored, answers).collect()}
    assert got["a"] == ("", "ok", "ai")
    assert got["b"] == (
        "Análisis completado. Se detectaron 4 hallazgos.",
        "Se recomienda revisar los hallazgos antes de la ingesta.",
        "ai",
    )
    assert got["c"] == got["d"] == (None, None, "rules")


def test_usable_responses(spark):
    cases = [('{"explanations":[],"source":"ai"}', True), ('{"explanations":{},"source":"ai"}', False),
             ('{"explanations":[],"source":"x"}', False), ("null", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string")
    got = {r.i: r.ok for r in df.select("i", E.response_is_usable(F.col("r")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, ok) in enumerate(cases)}


def test_decisions(spark):
    from prevuelo.operators.candidates import decide

    suggested = spark.createDataFrame(
        [("a", c, False) for c in "xyz"] + [("b", "x", False)], "dataset_id string, column_name string, confirmed boolean"
    )
    verdicts = spark.createDataFrame(
        [("a", "x", "confirm"), ("a", "x", "confirm"), ("a", "y", "reject"), ("a", "y", "confirm"), ("a", "q", "reject")],
        "dataset_id string, column_name string, decision string",
    )
    got = sorted(map(tuple, decide(suggested, verdicts).collect()))
    assert got == [("a", "x", True), ("a", "z", False), ("b", "x", False)]
