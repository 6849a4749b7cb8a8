"""DuckDB SQL that computes the registered queries in another way, over whole tables."""

from __future__ import annotations

import re

from workload import queries as Q
from workload import texts as T
from workload import views as V
from workload.views import View

_SPACE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def fill(template: str, **parts: str) -> str:
    """SQL concatenation of a template."""
    pieces = re.split(r"\{(\w+)\}", template)
    quoted = [f"({parts[p]})::VARCHAR" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces) if p]
    return "(" + " || ".join(quoted) + ")"


def choose(code: str, templates: dict[str, str], **parts: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN '{k}' THEN {fill(t, **parts)}" for k, t in templates.items()) + " END"


def usable(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '[^{_SPACE}]'), false)"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def one_decimal(p: str) -> str:
    return f"printf('%.1f', CASE WHEN fmod({p} * 4, 2) = 1 THEN {p} + 0.01 ELSE {p} END)"


def number(n: str) -> str:
    return f"CASE WHEN {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END"


def _kind(x: str) -> str:
    month_day = "try_cast(substr({x}, {m}, 2) AS INT) BETWEEN 1 AND 12 AND try_cast(substr({x}, {d}, 2) AS INT) BETWEEN 1 AND 31"
    tail = r"([ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z?)?\s*"
    iso = rf"regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{tail}') AND {month_day.format(x=x, m=6, d=9)}"
    us = rf"regexp_full_match({x}, '([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})\s*')"
    us += f" AND {month_day.format(x=x, m=1, d=4)}"
    return (
        f"CASE WHEN {x} IS NULL THEN 'missing' WHEN NOT {usable(x)} THEN 'empty' "
        f"WHEN lower({x}) IN ('true', 'false') THEN 'boolean' "
        rf"WHEN regexp_full_match({x}, '-?[0-9]+(\.[0-9]+)?') THEN 'number' "
        f"WHEN ({iso}) OR ({us}) THEN 'date' ELSE 'string' END"
    )


def _valid(x: str) -> str:
    shapes = [
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "%Y-%m-%d", "1, 4"),
        ("[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "%Y-%m-%d %H:%M:%S", "1, 4"),
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", "%Y-%m-%dT%H:%M:%S", "1, 4"),
        ("[0-9]{2}/[0-9]{2}/[0-9]{4}", "%d/%m/%Y", "7, 4"),
        ("[0-9]{2}-[0-9]{2}-[0-9]{4}", "%d-%m-%Y", "7, 4"),
    ]
    t = trim(x)
    cases = " ".join(
        f"WHEN regexp_full_match({t}, '{shape}') THEN try_strptime({t}, '{layout}') IS NOT NULL"
        f" AND substr({t}, {year}) >= '0100'"
        for shape, layout, year in shapes
    )
    return f"coalesce(CASE {cases} ELSE false END, false)"


def _rows(i: int, view: View) -> str:
    cells = ", ".join(f"{e} AS c{j}" for j, e in enumerate(view.cells.values()))
    some = " OR ".join(usable(f"c{j}") for j in range(len(view.cells)))
    return (
        f"r{i} AS (SELECT * FROM (SELECT {view.dataset_sql} AS ds, {view.pos} AS spot, {cells} FROM {view.source})"
        f" WHERE {some})"
    )


def facts(*views: View) -> str:
    """WITH clause: r0.. (rows), cells, facts (per column), totals (per dataset)."""
    cells = " UNION ALL ".join(
        f"SELECT ds, spot, {j} AS pos, '{h}' AS name, c{j} AS v FROM r{i}"
        for i, view in enumerate(views)
        for j, h in enumerate(view.cells)
    )
    totals = " UNION ALL ".join(
        f"SELECT ds AS dataset_id, count(*) AS row_count, {len(v.cells)} AS column_count, "
        f"count(DISTINCT row({', '.join(f'c{j}' for j in range(len(v.cells)))})) AS distinct_rows FROM r{i} GROUP BY ds"
        for i, v in enumerate(views)
    )
    rows = ",\n".join(_rows(i, v) for i, v in enumerate(views))
    return f"""WITH {rows},
cells AS ({cells}),
coded AS (SELECT *, {_kind('v')} AS kind, {_valid('v')} AS valid FROM cells),
facts AS (
  SELECT ds AS dataset_id, pos AS column_pos, name AS column_name, count(*) AS row_count,
    count(*) FILTER (kind = 'missing') AS null_count, count(*) FILTER (kind = 'empty') AS empty_count,
    count(DISTINCT v) FILTER (kind NOT IN ('missing', 'empty')) AS unique_count,
    CASE count(DISTINCT kind) FILTER (kind NOT IN ('missing', 'empty')) WHEN 0 THEN 'string'
      WHEN 1 THEN max(kind) FILTER (kind NOT IN ('missing', 'empty')) ELSE 'mixed' END AS inferred_type,
    count(*) FILTER (kind NOT IN ('missing', 'empty') AND NOT valid) AS invalid_date_count
  FROM coded GROUP BY ds, pos, name),
totals AS ({totals})"""


_TEMPORAL = (
    "(inferred_type = 'date' OR regexp_matches(lower(column_name),"
    " 'date|fecha|timestamp|time|created|updated|modified|event'))"
)


def findings(*views: View) -> str:
    parts = {"column": "column_name", "count": "n", "percent": one_decimal("p")}
    return f"""{facts(*views)},
hits AS (
  SELECT dataset_id, 0 AS rule_pos, column_pos, column_name, 'nulls' AS category, null_count AS n, row_count
    FROM facts WHERE null_count > 0
  UNION ALL SELECT dataset_id, 1, column_pos, column_name, 'empties', empty_count, row_count
    FROM facts WHERE empty_count > 0
  UNION ALL SELECT dataset_id, 2, -1, NULL, 'duplicates', row_count - distinct_rows, row_count
    FROM totals WHERE row_count > distinct_rows
  UNION ALL SELECT dataset_id, 3, column_pos, column_name, 'invalid_dates', invalid_date_count, row_count
    FROM facts WHERE invalid_date_count > 0 AND {_TEMPORAL}),
shares AS (SELECT *, n::DOUBLE / row_count::DOUBLE * 100.0 AS p FROM hits),
findings AS (
  SELECT dataset_id, rule_pos, column_pos,
    CASE category WHEN 'duplicates' THEN 'duplicates-exact' ELSE category || '-' || column_name END AS finding_id,
    category, CASE WHEN p >= 20 THEN 'alto' WHEN p >= 5 THEN 'medio' ELSE 'bajo' END AS severity,
    {choose('category', T.DESCRIPTION, **parts)} AS description, n AS count,
    floor(p * 10 + 0.5) / 10 AS percentage,
    {choose('category', T.EXPLANATION, **parts)} AS rule_based_explanation,
    {choose('category', T.ACTION, **parts)} AS recommended_action, column_name AS affected_columns
  FROM shares)"""


def _candidates_cte() -> str:
    strong = (
        "regexp_matches(lower(column_name), 'updated_at|modified_at|last_modified|last_update|update_date|"
        "modification_date|fecha_modificacion|fecha_actualizacion|timestamp')"
    )
    second = (
        "regexp_matches(lower(column_name),"
        " 'created_at|creation_date|fecha_creacion|event_date|ingestion_date|load_date')"
    )
    pk = "regexp_full_match(lower(column_name), 'id|.+_id|id_.+|uuid|guid|pk|key')"
    bk = "regexp_matches(lower(column_name), 'cod|código|number|numero|número|nro|ref')"
    texts = {"column": "column_name", "type": "inferred_type", "unique": one_decimal("u"), "missing": one_decimal("m")}
    return f"""
rated AS (
  SELECT *, CASE WHEN row_count > null_count + empty_count
      THEN unique_count::DOUBLE / (row_count - null_count - empty_count)::DOUBLE * 100.0 ELSE 0.0 END AS u,
    (null_count + empty_count)::DOUBLE / row_count::DOUBLE * 100.0 AS m FROM facts),
kinds AS (
  SELECT *, CASE WHEN {strong} AND m <= 20 THEN 'strong' WHEN {second} AND m <= 20 THEN 'secondary'
    WHEN {pk} AND inferred_type IN ('string', 'number') AND m = 0 AND u >= 98 THEN 'primary_key'
    WHEN {bk} AND inferred_type IN ('string', 'number') AND u >= 90 AND m <= 5 THEN 'business_key' END AS k
  FROM rated),
candidates AS (
  SELECT dataset_id, column_pos, column_name,
    CASE WHEN k IN ('strong', 'secondary') THEN 'incremental_marker' ELSE k END AS candidate_type,
    CASE WHEN k = 'strong' THEN CASE WHEN m = 0 THEN 'alta' ELSE 'media' END
      WHEN k = 'secondary' THEN CASE WHEN m = 0 THEN 'media' ELSE 'baja' END
      WHEN u = 100 AND m = 0 THEN 'alta' WHEN k = 'primary_key' OR u >= 98 THEN 'media' ELSE 'baja' END AS confidence,
    {choose('k', T.REASONING, **texts)} AS reasoning, false AS confirmed
  FROM kinds WHERE k IS NOT NULL)"""


def candidates(*views: View) -> str:
    return facts(*views) + "," + _candidates_cte()


_WEIGHT = "CASE severity WHEN 'alto' THEN 20 WHEN 'medio' THEN 10 WHEN 'bajo' THEN 5 END"
_LEVEL = "CASE WHEN {t} >= 60 THEN 'alto' WHEN {t} >= 30 THEN 'medio' ELSE 'bajo' END"


def scores(*views: View) -> str:
    return f"""{findings(*views)},
scores AS (
  SELECT *, {_LEVEL.format(t='total')} AS risk_level FROM (
    SELECT dataset_id, least(100, coalesce(sum({_WEIGHT}), 0))::BIGINT AS total,
      coalesce(sum({_WEIGHT}), 0)::BIGINT AS raw_total, count(finding_id) AS finding_count
    FROM totals LEFT JOIN findings USING (dataset_id) GROUP BY dataset_id))"""


_LISTING = (
    "CASE confidence WHEN 'alta' THEN 0 WHEN 'media' THEN 1 ELSE 2 END, replace(lower(column_name), '_', ' '), column_pos"
)
_RANKED = "rule_pos, column_pos"


def dossiers(*views: View) -> str:
    return f"""{scores(*views)},{_candidates_cte()},
columns_of AS (SELECT dataset_id, list(column_name ORDER BY column_pos) AS names,
  list(struct_pack(name := column_name, inferredType := inferred_type) ORDER BY column_pos) AS columns
  FROM facts GROUP BY dataset_id),
findings_of AS (SELECT dataset_id, list(finding_id ORDER BY {_RANKED}) AS ids,
  list(struct_pack(id := finding_id, category := category, severity := severity, description := description,
    count := count, percentage := percentage) ORDER BY {_RANKED}) AS problems,
  string_agg('- [' || finding_id || '] Severidad: ' || severity || ', Categoría: ' || category || ', Cantidad: '
    || count || ', Porcentaje: ' || {number('percentage')} || '%, Descripción: ' || description, chr(10)
    ORDER BY {_RANKED}) AS finding_lines
  FROM findings GROUP BY dataset_id),
candidates_of AS (SELECT dataset_id, count(*) AS candidate_count,
  list(struct_pack(columnName := column_name, candidateType := candidate_type, confidence := confidence)
    ORDER BY {_LISTING}) AS keys,
  string_agg('- ' || regexp_replace(column_name, '[^a-zA-Z0-9-]', '', 'g') || ': ' || candidate_type
    || ' (confianza: ' || confidence || ')', chr(10) ORDER BY {_LISTING}) AS candidate_lines
  FROM candidates GROUP BY dataset_id),
dossiers AS (SELECT * FROM totals JOIN scores USING (dataset_id) JOIN columns_of USING (dataset_id)
  LEFT JOIN findings_of USING (dataset_id) LEFT JOIN candidates_of USING (dataset_id))"""


def payloads(*views: View) -> str:
    request = """to_json(struct_pack(
    structureSummary := struct_pack(rowCount := row_count, columnCount := column_count, columns := columns),
    findings := coalesce(problems, []), candidates := coalesce(keys, []), riskScore := total))::VARCHAR"""
    return f"""{dossiers(*views)}
SELECT dataset_id, regexp_replace({request}, '("percentage":[0-9]+)\\.0([,}}])', '\\1\\2', 'g') AS payload FROM dossiers"""


def prompts(*views: View) -> str:
    names = "array_to_string(list_transform(names, lambda x: regexp_replace(x, '[^a-zA-Z0-9-]', '', 'g')), ', ')"
    prompt = fill(
        T.PROMPT,
        finding_count="finding_count",
        finding_ids="coalesce(to_json(ids)::VARCHAR, '[]')",
        risk_level="risk_level",
        row_count="row_count",
        column_count="column_count",
        column_names=names,
        score="total",
        finding_lines="coalesce(finding_lines, '')",
        candidate_count="coalesce(candidate_count, 0)",
        candidate_lines="coalesce(candidate_lines, '')",
    )
    return f"{dossiers(*views)} SELECT dataset_id, {prompt} AS prompt FROM dossiers"


def offline(*views: View) -> str:
    return f"""{findings(*views)}
SELECT dataset_id, rule_pos, column_pos, finding_id, rule_based_explanation AS contextual_explanation,
  recommended_action AS corrective_action FROM findings"""


def merged(view: View) -> str:
    impact = fill(T.FALLBACK_IMPACT, finding_id="finding_id")
    context = fill(T.FALLBACK_CONTEXT, category="category", count="count")
    return f"""{findings(view)},
numbered AS (SELECT *, substr(dataset_id, 10)::INT % 4 IN (2, 3) AS answered FROM findings)
SELECT dataset_id, rule_pos, column_pos, finding_id,
  CASE WHEN NOT answered THEN NULL
    WHEN category = 'nulls' THEN {impact} ELSE 'impacto ' || finding_id END AS technical_impact,
  CASE WHEN NOT answered THEN rule_based_explanation
    WHEN category = 'nulls' THEN {context} ELSE 'contexto ' || severity END AS contextual_explanation,
  CASE WHEN answered THEN 'acción' ELSE recommended_action END AS corrective_action,
  CASE WHEN NOT answered THEN NULL WHEN severity = 'alto' THEN 'critical' WHEN severity = 'medio' THEN 'medium'
    ELSE 'low' END AS priority,
  CASE WHEN answered THEN 'ai' ELSE 'rules' END AS source
FROM numbered"""


def summaries(view: View) -> str:
    return f"""{scores(view)},
numbered AS (SELECT *, substr(dataset_id, 10)::INT % 4 IN (2, 3) AS answered FROM scores)
SELECT dataset_id, CASE WHEN answered THEN 'resumen' END AS executive_summary,
  CASE WHEN answered THEN 'Se recomienda revisar los hallazgos antes de la ingesta.' END
    AS overall_risk_assessment,
  CASE WHEN answered THEN 'ai' ELSE 'rules' END AS source
FROM numbered"""


def samples(view: View) -> str:
    return f"""{facts(view)},
firsts AS (SELECT ds, pos, v, min(spot) AS first_pos FROM coded WHERE kind NOT IN ('missing', 'empty') GROUP BY ds, pos, v),
placed AS (SELECT *, row_number() OVER (PARTITION BY ds, pos ORDER BY first_pos, v) AS nth FROM firsts)
SELECT ds AS dataset_id, pos AS column_pos, nth, v AS value FROM placed WHERE nth <= 10"""


def preview(view: View) -> str:
    shown = ", ".join(f'coalesce(c{j}, \'\') AS "{h}"' for j, h in enumerate(view.cells))
    return f"""WITH {_rows(0, view)}
SELECT ds AS dataset_id, spot AS row_pos, {shown} FROM r0
QUALIFY row_number() OVER (PARTITION BY ds ORDER BY spot) <= 10"""


def markdown(x: str) -> str:
    lines = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    marked = lines
    for mark in ["\\", "`", "*", "_", "[", "]"]:
        marked = f"replace({marked}, '{mark}', '\\{mark}')"
    return f"CASE WHEN {x} = '' THEN '—' ELSE regexp_replace({marked}, '(?m)^(#+)', '\\\\\\1', 'g') END"


def cell(x: str) -> str:
    return (
        f"CASE WHEN {x} = '' THEN '—' ELSE"
        f" replace(replace(replace({x}, '|', '\\|'), chr(10), ' '), chr(13), '') END"
    )


_FILE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?i)\\.csv$', ''), '[<>:\"/\\\\|?*]', '-', 'g'), '-+', '-', 'g'), '[.\\s]+$', '')"


def file_name(x: str) -> str:
    stem = _FILE.format(x=trim(x))
    return f"CASE WHEN {stem} = '' THEN 'pipeline-risk-report.md' ELSE {stem} || '-pipeline-risk-report.md' END"


def documents(view: View, confirmed: bool = True) -> str:
    """Whole Markdown reports, every candidate confirmed or none."""
    nl = "chr(10)"
    label = lambda code, labels: f"CASE {code} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"
    severity = label("severity", T.SEVERITY_LABEL)

    def block(*lines: str) -> str:
        return f" || {nl} || ".join(f"({line})" for line in lines)

    profile = (
        f"'| ' || {cell('column_name')} || ' | ' || {label('inferred_type', T.TYPE_LABEL)} || ' | ' || null_count"
        " || ' | ' || empty_count || ' | ' || unique_count || ' | ' || coalesce(shown, '—') || ' |'"
    )
    finding = block(
        f"'### ' || {markdown('description')}", "''", f"'- **Severidad:** ' || {severity}",
        f"'- **Categoría:** ' || {label('category', T.CATEGORY_LABEL)}", "'- **Cantidad:** ' || count",
        f"'- **Porcentaje:** ' || {one_decimal('percentage')} || '%'"
        f" || coalesce({nl} || '- **Columnas afectadas:** ' || {markdown('affected_columns')}, '')",
        "''", "'**Explicación basada en reglas:**'", "''", markdown("rule_based_explanation"), "''",
        "'**Acción recomendada:**'", "''", markdown("recommended_action"), "''",
    )
    candidate = block(
        f"'### ' || {markdown('column_name')}", "''",
        f"'- **Tipo:** ' || {label('candidate_type', T.CANDIDATE_LABEL)}",
        f"'- **Confianza:** ' || {label('confidence', T.CONFIDENCE_LABEL)}",
        f"'- **Razonamiento:** ' || {markdown('reasoning')}", "''",
    )
    quoted = lambda lines: [f"'{line}'" for line in lines]
    document = block(
        f"'# {T.TITLE}'", "''", "'## Información del análisis'", "''",
        f"'- **Archivo analizado:** ' || {markdown('dataset_id')}", *quoted(T.MODE_LINES), "''",
        "'## Resumen de estructura'", "''", "'- **Filas:** ' || row_count", "'- **Columnas:** ' || column_count", "''",
        "'## Perfil de columnas'", "''", *quoted(T.PROFILE_HEAD), "profile_lines", "''",
        "'## Puntaje de riesgo'", "''", "'- **Puntaje total:** ' || total || ' / 100'",
        "'- **Puntaje bruto (sin límite):** ' || raw_total", "''",
        f"CASE WHEN hits IS NULL THEN '' ELSE {block(*quoted(['### Desglose', '', *T.BREAKDOWN_HEAD]), 'breakdown_lines', chr(39) * 2)} END",
        "'## Hallazgos detectados'", "''",
        f"CASE WHEN hits IS NULL THEN '{T.NO_FINDINGS}' ELSE "
        + block("'Se detectaron **' || hits || '** hallazgos:'", "''", "finding_blocks") + " END",
        "''", "'## Columnas candidatas confirmadas'", "''",
        f"coalesce(candidate_blocks, '{T.NO_CONFIRMED}')", "''", "'---'", "''", f"'{T.CLOSING}'", "''",
    )
    return f"""{scores(view)},{_candidates_cte()},
firsts AS (SELECT ds, pos, v, min(spot) AS first_pos FROM coded WHERE kind NOT IN ('missing', 'empty') GROUP BY ds, pos, v),
placed AS (SELECT *, row_number() OVER (PARTITION BY ds, pos ORDER BY first_pos, v) AS nth FROM firsts),
shown AS (SELECT ds AS dataset_id, pos AS column_pos, string_agg({cell('v')}, ', ' ORDER BY nth) AS shown
  FROM placed WHERE nth <= 10 GROUP BY ds, pos),
profiles AS (SELECT dataset_id, string_agg({profile}, {nl} ORDER BY column_pos) AS profile_lines
  FROM facts LEFT JOIN shown USING (dataset_id, column_pos) GROUP BY dataset_id),
problems AS (SELECT dataset_id, count(*) AS hits, string_agg({finding}, {nl} ORDER BY {_RANKED}) AS finding_blocks,
  string_agg('| ' || {cell('finding_id')} || ' | ' || {severity} || ' | +' || {_WEIGHT} || ' puntos |', {nl}
    ORDER BY {_RANKED}) AS breakdown_lines FROM findings GROUP BY dataset_id),
keys AS (SELECT dataset_id, string_agg({candidate}, {nl} ORDER BY {_LISTING}) AS candidate_blocks
  FROM candidates WHERE {str(confirmed).lower()} GROUP BY dataset_id)
SELECT dataset_id, {file_name('dataset_id')} AS file_name, {document} AS document
FROM totals JOIN scores USING (dataset_id) JOIN profiles USING (dataset_id) LEFT JOIN problems USING (dataset_id)
LEFT JOIN keys USING (dataset_id)"""


_FACTS = ", ".join(Q.FACT_COLUMNS)
_FINDINGS = ", ".join(Q.FINDING_COLUMNS)


def _profile(*views: View) -> str:
    return f"{facts(*views)} SELECT {_FACTS} FROM facts"


def _findings(category: str | None, *views: View) -> str:
    only = f" WHERE category = '{category}'" if category else ""
    return f"{findings(*views)} SELECT {_FINDINGS}, affected_columns FROM findings{only}"


def _rule_status(*views: View) -> str:
    counted = " UNION ALL ".join(
        f"SELECT {i} AS rule_pos, '{rule}' AS rule" for i, rule in
        enumerate(["nulls", "empties", "duplicates", "invalid_dates", "late_arriving"])
    )
    return f"""{findings(*views)},
rules AS ({counted}),
temporal AS (SELECT dataset_id, count(*) FILTER ({_TEMPORAL}) AS temporal_columns FROM facts GROUP BY dataset_id),
n AS (SELECT dataset_id, rule_pos, count(*) AS findings FROM findings GROUP BY ALL)
SELECT dataset_id, rule_pos, rule, CASE WHEN rule = 'late_arriving' THEN
    CASE WHEN temporal_columns >= 2 THEN 'evaluated_no_finding' ELSE 'not_evaluable' END
    WHEN findings > 0 THEN 'findings' ELSE 'no_finding' END AS status,
  coalesce(findings, 0) AS findings, temporal_columns, 5::BIGINT AS rules_executed
FROM temporal CROSS JOIN rules LEFT JOIN n USING (dataset_id, rule_pos)"""


def _value_kinds() -> str:
    return f"""{facts(V.DIRTY_ORDERS)}
SELECT name AS column_name, kind, valid AS valid_date, count(*) AS cells FROM coded
WHERE name IN ('updated_at', 'created_at', 'priority', 'status') GROUP BY ALL"""


_DUPLICATE_ROWS = """WITH firsts AS (SELECT event_id, user_id, event_type,
  min(event_id) OVER (PARTITION BY user_id, event_type) AS first_pos FROM events)
SELECT 'events' AS dataset_id, event_id AS row_pos, first_pos, CAST(user_id AS VARCHAR) AS user_id, event_type
FROM firsts WHERE event_id > first_pos"""


def _contract() -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + (f"'{error}'" if error else "NULL") for i, (_, error) in enumerate(Q.CONTRACT_CASES)
    )
    return f"SELECT o_orderkey, CASE o_orderkey % {len(Q.CONTRACT_CASES)} {cases} END AS error FROM orders"


def _csv_view(by_batch: bool = False, lines: list = Q.CSV_LINES, header: str = Q.CSV_HEADER, sep: str = ",") -> View:
    kept = []
    for j in range(3):
        branches = " ".join(f"WHEN {i} THEN {cells[j]}" for i, (_, cells) in enumerate(lines))
        kept.append(f"CASE o_orderkey % {len(lines)} {branches} END")
    headers = header.split(sep)
    cells = dict(zip(headers, ["CAST(o_orderkey AS STRING)", *kept]))
    if by_batch:
        return View("orders", f"'lote-' || {Q.CSV_BATCH}", cells, many=True)
    return View("orders", "orders", cells)


_CSV_ERRORS = """SELECT 'orders' AS dataset_id, message, count(*) AS errors FROM (
  SELECT CASE o_orderkey % 7 WHEN 1 THEN 'Too few fields: expected 4 fields but parsed 1'
    WHEN 2 THEN 'Too few fields: expected 4 fields but parsed 3'
    WHEN 4 THEN 'Too many fields: expected 4 fields but parsed 6'
    WHEN 5 THEN 'Too few fields: expected 4 fields but parsed 2' END AS message FROM orders)
WHERE message IS NOT NULL GROUP BY message"""

def _many_headers() -> list[View]:
    views = []
    for rest, (_, names, cells) in Q.MANY_HEADERS.items():
        source = f"(SELECT * FROM orders WHERE o_orderkey % {len(Q.MANY_HEADERS)} = {rest})"
        views.append(View(source, f"part{rest}", dict(zip(names, ["CAST(o_orderkey AS STRING)", *cells]))))
    return views


def _csv_previews() -> str:
    names = Q.CSV_HEADER.split(",")
    cells = []
    for j in range(len(names) - 1):
        branches = " ".join(f"WHEN {i} THEN {line_cells[j]}" for i, (_, line_cells) in enumerate(Q.CSV_LINES))
        cells.append(f"CASE o_orderkey % {len(Q.CSV_LINES)} {branches} END")
    values = ["CAST(o_orderkey AS VARCHAR)", *cells]
    structs = ", ".join(f"{{'pos': {i}, 'name': '{n}', 'value': coalesce({v}, '')}}" for i, (n, v) in enumerate(zip(names, values)))
    return f"""WITH first AS (SELECT *, o_orderkey % {Q.PREVIEW_FILES} AS batch,
  row_number() OVER (PARTITION BY o_orderkey % {Q.PREVIEW_FILES} ORDER BY o_orderkey) AS nth FROM orders QUALIFY nth <= 10),
cells AS (SELECT batch, nth, unnest([{structs}]) AS c FROM first)
SELECT 'lote-' || batch AS dataset_id, CAST(nth AS INT) AS nth, CAST(c.pos AS INT) AS column_pos, c.name AS column_name, c.value AS value FROM cells"""


_PAGE_NAME = "'  ' || url || CASE WHEN page_id % 3 = 0 THEN '.CSV ' ELSE '. ' END"

ORACLES: dict[str, str] = {
    "profile_orders": _profile(V.DIRTY_ORDERS),
    "profile_lineitem": _profile(V.plain("lineitem")),
    "profile_documents": _profile(V.plain("documents")),
    "profile_all_tables": _profile(*V.ALL_TABLES),
    "profile_suppliers": _profile(V.SUPPLIERS),
    "value_kinds_orders": _value_kinds(),
    "samples_part": samples(V.plain("part", pos="p_partkey")),
    "samples_documents": samples(V.plain("documents", pos="doc_id")),
    "preview_orders": preview(V.DIRTY_ORDERS),
    "preview_suppliers": preview(
        View("lineitem", V.SUPPLIERS.dataset, V.SUPPLIERS.cells, True, "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber")
    ),
    "audit_summary": facts(*V.ALL_TABLES, V.SUPPLIERS)
    + " SELECT dataset_id, row_count, column_count::BIGINT AS column_count, 0::BIGINT AS parse_error_count FROM totals",
    "findings_nulls": _findings("nulls", V.DIRTY_ORDERS, V.DIRTY_PART),
    "findings_nulls_outer_join": _findings("nulls", V.LABELLED),
    "findings_empties": _findings("empties", V.DIRTY_ORDERS, V.DIRTY_PART),
    "findings_duplicates": _findings("duplicates", V.DIRTY_PART, V.plain("documents", ["text"]), V.SUPPLIER_FLAGS),
    "findings_invalid_dates": _findings("invalid_dates", V.DIRTY_ORDERS),
    "findings_events_temporal": _findings(None, V.plain("events")),
    "findings_suppliers": _findings(None, V.SUPPLIERS),
    "duplicate_rows_ties": """SELECT 'events' AS dataset_id, event_id % 3 AS row_pos,
  min(event_id % 3) OVER (PARTITION BY user_id, event_type) AS first_pos, CAST(user_id AS VARCHAR) AS user_id, event_type
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3) > 1""",
    "preview_ties": preview(
        View("lineitem", V.SUPPLIERS.dataset, {"line": V.text("l_linenumber")}, many=True, pos="l_linenumber")
    ),
    "dataset_statuses": """SELECT 'supplier-' || k AS dataset_id, CASE WHEN k IN (SELECT l_suppkey FROM lineitem)
  THEN 'audited' ELSE 'no_data' END AS status
FROM (SELECT unnest([s_suppkey, s_suppkey + 1000000]) AS k FROM supplier)""",
    "duplicate_rows_events": _DUPLICATE_ROWS,
    "rule_status": _rule_status(V.DIRTY_ORDERS, V.DIRTY_PART, V.plain("lineitem"), V.plain("events")),
    "key_candidates": candidates(*V.ALL_TABLES, V.DIRTY_ORDERS, V.SUPPLIERS) + " SELECT * FROM candidates",
    "candidate_listing": f"""{candidates(*V.ALL_TABLES, V.DIRTY_ORDERS, V.SUPPLIERS)}
SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY {_LISTING}) AS nth, column_name, confidence
FROM candidates""",
    "candidate_evidence": f"""{candidates(*V.ALL_TABLES)}
SELECT dataset_id, count(column_name) AS candidate_count, count(column_name) = 0 AS insufficient_evidence,
  CASE WHEN count(column_name) = 0 THEN '{T.NO_CANDIDATES}' END AS message
FROM totals LEFT JOIN candidates USING (dataset_id) GROUP BY dataset_id""",
    "candidate_decisions": f"""{candidates(*V.ALL_TABLES)}
SELECT dataset_id, column_name, candidate_type, confidence, true AS confirmed FROM candidates
WHERE length(column_name) % 3 <> 0""",
    "risk_scores": scores(*V.ALL_TABLES) + " SELECT * FROM scores",
    "risk_scores_suppliers": scores(V.SUPPLIERS) + " SELECT * FROM scores",
    "risk_breakdown": f"""{findings(V.DIRTY_ORDERS, V.DIRTY_PART, V.SUPPLIERS)}
SELECT dataset_id, rule_pos, column_pos, finding_id, severity, ({_WEIGHT})::BIGINT AS contribution FROM findings""",
    "risk_ranking_suppliers": scores(V.SUPPLIERS) + " SELECT rank() OVER (ORDER BY total DESC) AS risk_rank, * FROM scores",
    "audit_payloads": payloads(V.DIRTY_ORDERS, V.SUPPLIERS),
    "model_prompts": prompts(V.DIRTY_ORDERS, V.SUPPLIERS),
    "payload_contract": _contract(),
    "reply_texts": """SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN 'not_completed' WHEN 3 THEN 'no_text'
    ELSE 'ok' END AS reply_status, CASE WHEN doc_id % 5 < 3 THEN text || lang END AS answer FROM documents""",
    "usable_responses": "SELECT conv_id, turn, role = 'assistant' AS usable FROM conversations",
    "offline_explanations": offline(V.SUPPLIERS),
    "merged_explanations": merged(V.SUPPLIERS),
    "executive_summaries": summaries(V.SUPPLIERS),
    "ignored_answers": f"""{findings(V.SUPPLIERS)}
SELECT 'supplier-' || (substr(dataset_id, 10)::BIGINT + 1) AS dataset_id, finding_id AS answer_key FROM findings
EXCEPT SELECT dataset_id, finding_id FROM findings""",
    "markdown_escapes": f"SELECT doc_id, {markdown('text')} AS paragraph, {cell('text')} AS cell FROM documents",
    "html_escapes": f"SELECT page_id, {markdown('html')} AS paragraph FROM pages",
    "report_names": f"""SELECT page_id, {file_name('(' + _PAGE_NAME + ')')} AS file_name,
  regexp_replace(substr(url, 1, 128), '[^a-zA-Z0-9-]', '', 'g') AS safe_name FROM pages""",
    "file_admission": f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'extension' WHEN page_id % 7 = 0 THEN 'empty'
    WHEN strlen(html) > 2048 THEN 'too_big' ELSE 'admitted' END AS status,
  CASE WHEN page_id % 4 = 0 THEN '{T.EXTENSION_ERROR}' WHEN page_id % 7 = 0 THEN '{T.EMPTY_FILE_ERROR}'
    WHEN strlen(html) > 2048 THEN '{T.SIZE_ERROR.format(limit='0.001953125')}' END AS error FROM pages""",
    "csv_profile": _profile(_csv_view()),
    "csv_separators": _profile(_csv_view(lines=Q.WIDE_LINES, header=Q.WIDE_HEADER, sep=";")),
    "csv_long_lines": """SELECT 'orders' AS dataset_id, CASE WHEN o_orderkey % 500 = 2
  THEN 'Too many fields: expected 4 fields but parsed 30001' ELSE 'Too few fields: expected 4 fields but parsed 3' END
  AS message, count(*) AS errors FROM orders WHERE o_orderkey % 3 = 2 GROUP BY ALL""",
    "csv_parse_errors": _CSV_ERRORS,
    "csv_quoted_line_ends": _profile(View("documents", "documents", {"doc_id": V.text("doc_id"), "lang": "lang", "text": "text"})),
    "csv_many_headers": _profile(*_many_headers()),
    "csv_mixed_separators": "SELECT * FROM (VALUES "
    + ", ".join(f"('part{i}', {'chr(9)' if s == chr(9) else repr(s)}, {len(n)}::INT)" for i, (s, n, _) in Q.MANY_HEADERS.items())
    + ") AS t(dataset_id, sep, width)",
    "csv_previews": _csv_previews(),
    "csv_statuses": f"""SELECT DISTINCT 'group-' || s_suppkey % {Q.STATUS_GROUPS} AS dataset_id,
  CASE s_suppkey % {Q.STATUS_GROUPS} % 5 WHEN 0 THEN 'audited' WHEN 1 THEN 'encoding' WHEN 2 THEN 'extension' ELSE 'no_data' END AS status
FROM supplier""",
    "csv_batch_scores": scores(_csv_view(by_batch=True)) + " SELECT * FROM scores",
    "encoding_verdicts": """SELECT source, regexp_extract(source, '([0-9]+)', 1)::INT % 3 <> 0 AS valid_utf8
  FROM documents GROUP BY source""",
    "report_documents": documents(V.SUPPLIERS),
    "report_files": f"""SELECT dataset_id, {file_name("dataset_id")} AS report, generate_subscripts(string_split(document, chr(10)), 1) AS line_no,
  unnest(string_split(document, chr(10))) AS line FROM ({documents(V.SUPPLIERS, confirmed=False)})""",
    "report_lines": f"""SELECT dataset_id, generate_subscripts(string_split(document, chr(10)), 1) AS line_no,
  unnest(string_split(document, chr(10))) AS line FROM ({documents(V.SUPPLIERS, confirmed=False)})""",
}
