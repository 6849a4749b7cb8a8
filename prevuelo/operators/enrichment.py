"""What goes out to an external language model, and how its answers come back.

The call itself is outside: payloads and prompts are columns to be sent, answers come back
as a table ``(dataset_id, answer)``.  No row of the audited data is ever part of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevuelo.functions import figures, text, wording
from prevuelo.functions.text import trimmed

MAX_PAYLOAD_BYTES = 64 * 1024

# The priorities an explanation may have.
PRIORITIES = ["critical", "high", "medium", "low"]

# The parts of a model service's reply that carry the answer text.
REPLY_SCHEMA = (
    "status string, error struct<message string>,"
    " output array<struct<type string, content array<struct<type string, text string>>>>"
)


# --- outgoing ---------------------------------------------------------------------------


def payloads(dossiers: DataFrame) -> DataFrame:
    """(dataset_id, payload): structure, findings, candidates and score as one JSON text."""
    request = F.struct(
        F.struct(
            F.col("row_count").alias("rowCount"),
            F.col("column_count").alias("columnCount"),
            F.transform(
                "columns",
                lambda c: F.struct(c["column_name"].alias("name"), c["inferred_type"].alias("inferredType")),
            ).alias("columns"),
        ).alias("structureSummary"),
        F.transform(
            "findings",
            lambda f: F.struct(
                f["finding_id"].alias("id"),
                *[f[n].alias(n) for n in ["category", "severity", "description", "count", "percentage"]],
            ),
        ).alias("findings"),
        F.transform(
            "candidates",
            lambda c: F.struct(
                c["column_name"].alias("columnName"),
                c["candidate_type"].alias("candidateType"),
                c["confidence"].alias("confidence"),
            ),
        ).alias("candidates"),
        F.col("total").alias("riskScore"),
    )
    # whole percentages are written without a fraction; quotes inside texts are escaped, so this key is unique
    json = F.regexp_replace(F.to_json(request), r'("percentage":\d+)\.0([,}])', "$1$2")
    return dossiers.select("dataset_id", json.alias("payload"))


def prompts(dossiers: DataFrame) -> DataFrame:
    """(dataset_id, prompt): instructions, the exact finding ids and the fenced summary, names sanitised."""
    finding_line = lambda f: F.concat(
        F.lit("- ["), f["finding_id"], F.lit("] Severidad: "), f["severity"], F.lit(", Categoría: "), f["category"],
        F.lit(", Cantidad: "), f["count"].cast("string"),
        F.coalesce(F.concat(F.lit(", Porcentaje: "), figures.plain_number(f["percentage"]), F.lit("%")), F.lit("")),
        F.lit(", Descripción: "), f["description"],
    )
    candidate_line = lambda c: F.concat(
        F.lit("- "), text.safe_name(c["column_name"]), F.lit(": "), c["candidate_type"],
        F.lit(" (confianza: "), c["confidence"], F.lit(")"),
    )
    prompt = wording.fill(
        wording.PROMPT,
        finding_count=F.size("findings"),
        finding_ids=F.to_json(F.transform("findings", lambda f: f["finding_id"])),
        risk_level=F.col("risk_level"),
        row_count=F.col("row_count"),
        column_count=F.col("column_count"),
        column_names=F.array_join(F.transform("columns", lambda c: text.safe_name(c["column_name"])), ", "),
        score=F.col("total"),
        finding_lines=F.array_join(F.transform("findings", finding_line), "\n"),
        candidate_count=F.size("candidates"),
        candidate_lines=F.array_join(F.transform("candidates", candidate_line), "\n"),
    )
    return dossiers.select("dataset_id", prompt.alias("prompt"))


# --- contract of a payload ----------------------------------------------------------------


def _field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


# JSON kinds as they show in the schema text of a variant.
_KINDS = {"OBJECT": "OBJECT.*", "ARRAY": "ARRAY.*", "STRING": "STRING", "BOOLEAN": "BOOLEAN", "NULL": "VOID",
          "NUMBER": "BIGINT|DOUBLE|DECIMAL.*"}


def _is(value: Column, *kinds: str) -> Column:
    """The value is there and of one of the kinds (never NULL)."""
    pattern = rf"(?s)^(?:{'|'.join(_KINDS[k] for k in kinds)})\z"
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def _number(value: Column) -> Column:
    """A finite JSON number, else NULL."""
    number = F.try_variant_get(value, "$", "double")
    return F.when(_is(value, "NUMBER") & (F.abs(number) < float("inf")), number)


def _is_count(value: Column) -> Column:
    number = _number(value)
    return F.coalesce((number >= 0) & (number == F.floor(number)), F.lit(False))


def _in_percent_range(value: Column) -> Column:
    return F.coalesce(_number(value).between(0, 100), F.lit(False))


def _one_of(value: Column, allowed: list[str]) -> Column:
    return _is(value, "STRING") & F.coalesce(F.try_variant_get(value, "$", "string").isin(allowed), F.lit(False))


def _is_nothing(value: Column) -> Column:
    """null, false, 0 or an empty text."""
    as_text = F.try_variant_get(value, "$", "string")
    return (
        _is(value, "NULL")
        | (_is(value, "BOOLEAN") & (as_text == "false"))
        | (_is(value, "STRING") & (as_text == ""))
        | (F.coalesce(_number(value), F.lit(1.0)) == 0)
    )


def _first_error(checks: list[tuple[Column, Column]]) -> Column:
    """The message of the first check that does not hold."""
    return F.coalesce(*[F.when(~holds, message) for holds, message in checks])


def _error(name: str) -> Column:
    return F.lit(wording.PAYLOAD_ERRORS[name])


def _first_element_error(array: Column, checks) -> Column:
    elements = F.try_variant_get(array, "$", "array<variant>")

    def element_error(element: Column, i: Column) -> Column:
        return _first_error(
            [(holds, wording.fill(wording.PAYLOAD_ERRORS[name], i=i)) for holds, name in checks(element)]
        )

    errors = F.transform(elements, element_error)
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _column_checks(e: Column):
    return [(_is(_field(e, "name"), "STRING") & _is(_field(e, "inferredType"), "STRING"), "column")]


def _finding_checks(e: Column):
    percentage = _field(e, "percentage")
    return [
        (~_is_nothing(e), "finding"),
        (_is(_field(e, "id"), "STRING"), "finding.id"),
        (_is(_field(e, "category"), "STRING"), "finding.category"),
        (_one_of(_field(e, "severity"), list(figures.SEVERITY_WEIGHTS)), "finding.severity"),
        (_is(_field(e, "description"), "STRING"), "finding.description"),
        (_is_count(_field(e, "count")), "finding.count"),
        (percentage.isNull() | _in_percent_range(percentage), "finding.percentage"),
    ]


def _candidate_checks(e: Column):
    return [
        (~_is_nothing(e), "candidate"),
        (_is(_field(e, "columnName"), "STRING"), "candidate.name"),
        (_one_of(_field(e, "candidateType"), list(wording.CANDIDATE_LABEL)), "candidate.type"),
        (_is(_field(e, "confidence"), "STRING"), "candidate.confidence"),
    ]


def payload_errors(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with ``error``: the first violation of the contract, NULL when there is none.

    Size comes before syntax, syntax before content; fields are checked in order.
    """
    f = F.col
    _last_key_counts(payloads)
    # each step is a projection of its own, so that a text is parsed once
    opened = payloads.withColumn("_body", F.try_parse_json(column)).withColumn(
        "_summary", _field(f("_body"), "structureSummary")
    )
    fields = opened.withColumns(
        {
            "_rows": _field(f("_summary"), "rowCount"),
            "_width": _field(f("_summary"), "columnCount"),
            "_columns": _field(f("_summary"), "columns"),
            "_findings": _field(f("_body"), "findings"),
            "_candidates": _field(f("_body"), "candidates"),
            "_score": _field(f("_body"), "riskScore"),
        }
    )
    content = F.coalesce(
        _first_error(
            [
                (_is(f("_body"), "OBJECT", "ARRAY"), _error("object")),
                (_is(f("_summary"), "OBJECT", "ARRAY"), _error("summary")),
                (_is_count(f("_rows")), _error("row_count")),
                (_is_count(f("_width")), _error("column_count")),
                (_is(f("_columns"), "ARRAY"), _error("columns")),
            ]
        ),
        _first_element_error(f("_columns"), _column_checks),
        _first_error([(_is(f("_findings"), "ARRAY"), _error("findings"))]),
        _first_element_error(f("_findings"), _finding_checks),
        _first_error([(_is(f("_candidates"), "ARRAY"), _error("candidates"))]),
        _first_element_error(f("_candidates"), _candidate_checks),
        _first_error([(_in_percent_range(f("_score")), _error("score"))]),
    )
    error = (
        F.when(F.octet_length(column) > MAX_PAYLOAD_BYTES, wording.PAYLOAD_SIZE_ERROR)
        .when(f("_body").isNull(), wording.PAYLOAD_JSON_ERROR)
        .otherwise(content)
    )
    return fields.select(*payloads.columns, error.alias("error"))


# --- incoming -----------------------------------------------------------------------------


def reply_texts(replies: DataFrame, column: str = "reply") -> DataFrame:
    """``replies`` with ``reply_status`` and ``answer``, read from a model service's raw JSON reply.

    The answer is every ``output_text`` block of every ``message`` item, in order; anything
    else (reasoning) is left out.
    """
    f = F.col
    messages = F.filter(f("_reply.output"), lambda item: item["type"] == "message")
    blocks = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.array())))
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "output_text"), lambda b: b["text"])
    status = (
        F.when(F.coalesce(f("_reply.status") != "completed", F.lit(True)), "not_completed")
        .when(F.coalesce(f("_answer"), F.lit("")) == "", "no_text")
        .otherwise("ok")
    )
    return (
        replies.withColumn("_reply", F.from_json(column, REPLY_SCHEMA))
        .withColumn("_answer", F.array_join(texts, ""))
        .withColumn("reply_status", status)
        .select(*replies.columns, "reply_status", F.when(f("reply_status") == "ok", f("_answer")).alias("answer"))
    )


def answer_body(answer: Column) -> Column:
    """The JSON object of an answer, from the first brace to the last, as a variant."""
    return F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0))


def _text_of(entry: Column, field: str) -> Column:
    """A field's text; NULL unless it is a JSON string (numbers do not count)."""
    value = _field(entry, field)
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def answer_entries(answers: DataFrame) -> DataFrame:
    """The first explanation per trimmed finding id of every answer."""
    entry = F.col("value")
    parsed = answers.select("dataset_id", _field(answer_body(F.col("answer")), "explanations").alias("explanations"))
    parsed = parsed.filter(_is(F.col("explanations"), "ARRAY"))
    entries = parsed.select(
        "dataset_id", F.posexplode(F.try_variant_get(F.col("explanations"), "$", "array<variant>")).alias("pos", "value")
    ).select(
        "dataset_id",
        "pos",
        trimmed(_text_of(entry, "findingId")).alias("answer_key"),
        *[_text_of(entry, f).alias(f) for f in ["technicalImpact", "contextualExplanation", "correctiveAction"]],
        _text_of(entry, "priority").alias("priority"),
    )
    first = Window.partitionBy("dataset_id", "answer_key").orderBy("pos")
    return (
        entries.filter(F.col("answer_key") != "")
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") == 1)
        .drop("nth", "pos")
    )


def one_answer(answers: DataFrame) -> DataFrame:
    """One answer per dataset: of several the first readable one, in the order of their texts."""
    _last_key_counts(answers)
    ranked = F.struct(answer_body(F.col("answer")).isNull().alias("unreadable"), F.col("answer"))
    return answers.groupBy("dataset_id").agg(F.min(ranked).alias("best")).select("dataset_id", "best.answer")


def _last_key_counts(df: DataFrame) -> None:
    """JSON readers take the last of repeated keys; Spark's refuses the text unless its session is told."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def offline_explanations(found: DataFrame) -> DataFrame:
    """What explains a finding without a model: its own rule texts."""
    return found.select(
        "dataset_id",
        "rule_pos",
        "column_pos",
        "finding_id",
        F.col("rule_based_explanation").alias("contextual_explanation"),
        F.col("recommended_action").alias("corrective_action"),
    )


def merge_explanations(found: DataFrame, answers: DataFrame) -> DataFrame:
    """One explanation per finding, in listing order columns.

    A dataset with a readable answer takes the model's texts, with a fallback per missing
    field; a dataset without one keeps its findings with their own rule texts.
    """
    f = F.col
    answers = one_answer(answers)
    readable = answers.select(
        "dataset_id", answer_body(f("answer")).isNotNull().alias("answered")
    ).filter("answered")
    by_key = found.withColumn("answer_key", trimmed(f("finding_id")))
    joined = by_key.join(readable, "dataset_id", "left").join(
        answer_entries(answers), ["dataset_id", "answer_key"], "left"
    )
    answered = f("answered").isNotNull()

    def pick(field: str, fallback: Column, own: Column | None = None) -> Column:
        given = F.when(f(field) != "", f(field))
        said = F.when(answered, F.coalesce(given, fallback))
        return said if own is None else said.otherwise(own)

    priority = F.coalesce(F.when(f("priority").isin(PRIORITIES), f("priority")), F.lit("medium"))
    return joined.select(
        "dataset_id",
        "rule_pos",
        "column_pos",
        "finding_id",
        pick(
            "technicalImpact",
            wording.fill(wording.FALLBACK_IMPACT, finding_id=f("finding_id")),
        ).alias("technical_impact"),
        pick(
            "contextualExplanation",
            wording.fill(wording.FALLBACK_CONTEXT, category=f("category"), count=f("count")),
            f("rule_based_explanation"),
        ).alias("contextual_explanation"),
        pick("correctiveAction", F.lit(wording.FALLBACK_ACTION), f("recommended_action")).alias(
            "corrective_action"
        ),
        F.when(answered, priority).alias("priority"),
        F.when(answered, "ai").otherwise("rules").alias("source"),
    )


def merge_summaries(scored: DataFrame, answers: DataFrame) -> DataFrame:
    """Executive summary and assessment per dataset, from the answer or its fallbacks; none without an answer.

    An empty summary is kept; only one that is no text is replaced.
    """
    f = F.col
    bodies = one_answer(answers).select("dataset_id", answer_body(f("answer")).alias("body")).filter("body is not null")
    said = bodies.select(
        "dataset_id",
        F.lit(True).alias("answered"),
        _text_of(f("body"), "executiveSummary").alias("summary"),
        _text_of(f("body"), "overallRiskAssessment").alias("assessment"),
    )
    answered = f("answered").isNotNull()
    return (
        scored.join(said, "dataset_id", "left")
        .select(
            "dataset_id",
            F.when(
                answered, F.coalesce(f("summary"), wording.fill(wording.FALLBACK_SUMMARY, count=f("finding_count")))
            ).alias("executive_summary"),
            F.when(answered, F.coalesce(f("assessment"), F.lit(wording.FALLBACK_ASSESSMENT))).alias(
                "overall_risk_assessment"
            ),
            F.when(answered, "ai").otherwise("rules").alias("source"),
        )
    )


def ignored_answers(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Explanations that name no finding of their dataset."""
    expected = found.select("dataset_id", trimmed(F.col("finding_id")).alias("answer_key"))
    return answer_entries(one_answer(answers)).join(expected, ["dataset_id", "answer_key"], "left_anti")


def response_is_usable(response: Column) -> Column:
    """An enrichment response counts when it lists explanations and says it comes from a model."""
    body = F.try_parse_json(response)
    source = _text_of(body, "source")
    return F.coalesce(_is(_field(body, "explanations"), "ARRAY") & (source == "ai"), F.lit(False))
