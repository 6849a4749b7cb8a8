"""The registered queries: every operator of the library over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prevuelo.functions import cells, text
from prevuelo.operators import candidates as keys
from prevuelo.operators import enrichment, rows, score
from prevuelo.operators.findings import findings, rule_status
from prevuelo.operators.measure import column_facts, measure, measure_counts
from prevuelo.operators.report import read_reports, write_reports
from prevuelo.operators.samples import first_values
from prevuelo.plans.audit import audit, audit_csv
from prevuelo.sources.csv import read_csv, survey
from prevuelo.sources.files import admit, inspect_text, list_files
from prevuelo.sources.shared import shared_path, written
from workload import views as V

Query = Callable[[SparkSession, str], DataFrame]

FACT_COLUMNS = [
    "dataset_id", "column_pos", "column_name", "row_count", "null_count", "empty_count", "unique_count",
    "inferred_type", "invalid_date_count",
]
FINDING_COLUMNS = [
    "dataset_id", "rule_pos", "column_pos", "finding_id", "category", "severity", "description", "count",
    "percentage", "rule_based_explanation", "recommended_action",
]

# Rules that need no distinct values.
COUNTED = ["nulls", "empties", "invalid_dates"]


def _facts(*views: V.View) -> Query:
    return lambda spark, sf: measure(*[V.frame(spark, sf, v) for v in views])


def _profile(*views: V.View) -> Query:
    return lambda spark, sf: column_facts(_facts(*views)(spark, sf)).select(*FACT_COLUMNS)


def _findings(category: str | None, *views: V.View) -> Query:
    def query(spark, sf):
        frames = [V.frame(spark, sf, v) for v in views]
        found = findings((measure_counts if category in COUNTED else measure)(*frames))
        found = found if category is None else found.filter(F.col("category") == category)
        affected = F.array_join("affected_columns", ",").alias("affected_columns")
        return found.select(*FINDING_COLUMNS, affected)

    return query


def _samples(view: V.View) -> Query:
    def query(spark, sf):
        frame = V.frame(spark, sf, view)
        return first_values([frame], written(measure(frame), "facts"))

    return query


def value_kinds(spark, sf):
    """Type and date validity of every cell of the damaged orders, counted."""
    frame = V.frame(spark, sf, V.DIRTY_ORDERS)
    names = ["updated_at", "created_at", "priority", "status"]
    at = {n: f"c{frame.headers.index(n)}" for n in names}
    long = frame.rows.selectExpr(*[f"{c} AS {n}" for n, c in at.items()]).unpivot([], names, "column_name", "value")
    state = (
        f"CASE WHEN value IS NULL THEN 'missing' WHEN {cells.is_empty('value')} THEN 'empty'"
        f" ELSE {cells.value_kind('value')} END AS kind"
    )
    valid = f"coalesce({cells.valid_date('value')}, false) AS valid_date"
    return (
        long.selectExpr("column_name", state, valid)
        .groupBy("column_name", "kind", "valid_date")
        .agg(F.count(F.lit(1)).alias("cells"))
    )


def duplicate_rows(spark, sf):
    """Every event that repeats an earlier (user, type) pair."""
    view = V.plain("events", ["user_id", "event_type"], pos="event_id")
    return rows.extra_copies(V.frame(spark, sf, view))


def duplicate_rows_ties(spark, sf):
    """As before, but three positions are all there are."""
    view = V.plain("events", ["user_id", "event_type"], pos="event_id % 3")
    return rows.extra_copies(V.frame(spark, sf, view))


def preview_ties(spark, sf):
    """First rows of every supplier where many rows share a position, equal ones among them."""
    view = V.View("lineitem", V.SUPPLIERS.dataset, {"line": V.text("l_linenumber")}, many=True, pos="l_linenumber")
    return rows.preview(V.frame(spark, sf, view))


def preview_orders(spark, sf):
    return rows.preview(V.frame(spark, sf, V.DIRTY_ORDERS))


def preview_suppliers(spark, sf):
    """First rows of every supplier; positions are unique within a supplier."""
    view = V.View("lineitem", V.SUPPLIERS.dataset, dict(V.SUPPLIERS.cells), many=True,
                  pos="l_orderkey * 1000000 + l_partkey * 10 + l_linenumber")
    return rows.preview(V.frame(spark, sf, view))


def _rule_status(*views: V.View) -> Query:
    return lambda spark, sf: rule_status(_facts(*views)(spark, sf))


def _candidates(*views: V.View) -> Query:
    def query(spark, sf):
        frames = [V.frame(spark, sf, v) for v in views]
        wanted = keys.possible_keys(spark, [name for f in frames for name in f.headers])
        return keys.candidates(measure(*frames, columns=wanted, whole_rows=False))

    return query


def candidate_evidence(spark, sf):
    return keys.evidence(written(_facts(*V.ALL_TABLES)(spark, sf), "facts"))


def candidate_decisions(spark, sf):
    """Suggested keys of every table after a verdict on every third column name."""
    facts = written(_facts(*V.ALL_TABLES)(spark, sf), "facts")
    verdict = F.when(F.length("column_name") % 3 == 0, "reject").otherwise("confirm")
    verdicts = column_facts(facts).select("dataset_id", "column_name", verdict.alias("decision"))
    return keys.decide(keys.candidates(facts), verdicts).select(
        "dataset_id", "column_name", "candidate_type", "confidence", "confirmed"
    )


def _scores(*views: V.View) -> Query:
    return lambda spark, sf: audit(*[V.frame(spark, sf, v) for v in views]).scores


def _breakdown(*views: V.View) -> Query:
    return lambda spark, sf: score.breakdown(findings(_facts(*views)(spark, sf)))


def _ranking(*views: V.View) -> Query:
    return lambda spark, sf: audit(*[V.frame(spark, sf, v) for v in views]).ranking


def _payloads(*views: V.View) -> Query:
    return lambda spark, sf: audit(*[V.frame(spark, sf, v) for v in views]).payloads


def _prompts(*views: V.View) -> Query:
    return lambda spark, sf: audit(*[V.frame(spark, sf, v) for v in views]).prompts


def offline_explanations(spark, sf):
    return enrichment.offline_explanations(findings(_facts(V.SUPPLIERS)(spark, sf)))


def _answers(result) -> DataFrame:
    """Model answers made from the findings of every supplier: padded, repeated, unknown and
    unusable ids, missing texts, a repeated key; some suppliers get no readable answer, some two."""
    number = F.substring_index("dataset_id", "-", -1).cast("bigint")
    entry = lambda f: F.struct(
        F.concat(F.lit("  "), f["finding_id"], F.lit(" ")).alias("findingId"),
        F.when(f["category"] != "nulls", F.concat(F.lit("impacto "), f["finding_id"])).alias("technicalImpact"),
        F.when(f["category"] == "nulls", "").otherwise(F.concat(F.lit("contexto "), f["severity"])).alias(
            "contextualExplanation"
        ),
        F.lit("acción").alias("correctiveAction"),
        F.when(f["severity"] == "alto", "critical").when(f["severity"] == "medio", "urgent").otherwise("low").alias(
            "priority"
        ),
    )
    first = F.transform("findings", entry)
    again = F.transform(
        "findings", lambda f: entry(f).withField("technicalImpact", F.lit("segunda")).withField("priority", F.lit("low"))
    )
    body = F.to_json(F.struct(F.concat(first, again).alias("explanations"), F.lit("resumen").alias("executiveSummary")))
    answer = (
        F.when(number % 4 == 1, "no hay JSON")
        .when(number % 4 == 2, F.concat(F.lit('Respuesta: {"executiveSummary":"primero",'), F.substr(body, F.lit(2)), F.lit(" fin")))
        .otherwise(body)
    )
    answers = result.dossiers.filter(number % 4 != 0).select("dataset_id", answer.alias("answer"))
    return answers.unionByName(result.dossiers.filter(number % 4 == 3).select("dataset_id", F.lit("a").alias("answer")))


def merged_explanations(spark, sf):
    result = audit(V.frame(spark, sf, V.SUPPLIERS))
    return result.explanations(_answers(result))


def executive_summaries(spark, sf):
    result = audit(V.frame(spark, sf, V.SUPPLIERS))
    return result.executive_summaries(_answers(result))


def _request(columns: str = '[{"name":"a","inferredType":"string"}]', findings: str = "[]",
             candidates: str = "[]", score: str = "20", rows: str | None = None) -> str:
    """SQL text of a payload whose row count is the order key."""
    rows = rows or "' || CAST(o_orderkey AS STRING) || '"
    return (
        f"""'{{"structureSummary":{{"rowCount":{rows},"columnCount":1,"columns":{columns}}},"""
        f""""findings":{findings},"candidates":{candidates},"riskScore":{score}}}'"""
    )


_FINDING = '{"id":"x","category":"nulls","severity":"alto","description":"d","count":1,"percentage":2.5}'

# One payload per order, damaged in a different way for each remainder; and the error it must raise.
CONTRACT_CASES = [
    (_request(findings=f"[{_FINDING}]"), None),
    ("'{'", "El cuerpo de la solicitud no es JSON válido."),
    ("'[' || CAST(o_orderkey AS STRING) || ']'", "El campo structureSummary es requerido y debe ser un objeto."),
    ("CAST(o_orderkey AS STRING)", "El payload debe ser un objeto JSON."),
    (_request(rows="-1"), "structureSummary.rowCount debe ser un entero finito no negativo."),
    (_request(rows='"5"'), "structureSummary.rowCount debe ser un entero finito no negativo."),
    (_request(columns="null"), "structureSummary.columns debe ser un arreglo."),
    (_request(columns='[{"name":"a","inferredType":"b"},{"name":1,"inferredType":"b"}]'),
     "structureSummary.columns[1] debe tener name e inferredType como strings."),
    (_request(findings="{}"), "El campo findings es requerido y debe ser un arreglo."),
    (_request(findings=f"[{_FINDING},null]"), "findings[1] no puede ser nulo."),
    (_request(findings="[" + _FINDING.replace('"alto"', '"critico"') + "]"),
     "findings[0].severity debe ser alto, medio o bajo."),
    (_request(findings="[" + _FINDING.replace("2.5", "null") + "]"),
     "findings[0].percentage debe ser un número finito entre 0 y 100."),
    (_request(findings="[" + _FINDING.replace(',"percentage":2.5', "") + "]"), None),
    (_request(candidates='[{"columnName":"a","candidateType":"clave","confidence":"alta"}]'),
     "candidates[0].candidateType debe ser primary_key, business_key o incremental_marker."),
    (_request(score="150"), "El campo riskScore debe ser un número finito entre 0 y 100."),
    (_request(score="-5"), "El campo riskScore debe ser un número finito entre 0 y 100."),
    (_request(rows="10.0"), None),
    ("""'{"riskScore":150,' || substr(""" + _request() + ", 2)", None),
    ("repeat('x', 65537)", "El payload excede el tamaño máximo de 64 KB."),
]


def payload_contract(spark, sf):
    branches = " ".join(f"WHEN {i} THEN {expr}" for i, (expr, _) in enumerate(CONTRACT_CASES))
    V.load(spark, sf, "orders").createOrReplaceTempView("orders")
    made = spark.sql(f"SELECT o_orderkey, CASE o_orderkey % {len(CONTRACT_CASES)} {branches} END AS payload FROM orders")
    return enrichment.payload_errors(made).select("o_orderkey", "error")


def reply_texts(spark, sf):
    """One service reply per document: its text in two blocks between parts to be left out."""
    block = lambda kind, col: F.struct(F.lit(kind).alias("type"), col.alias("text"))
    item = lambda kind, *blocks: F.struct(F.lit(kind).alias("type"), F.array(*blocks).alias("content"))
    status = F.when(F.col("doc_id") % 5 == 4, "incomplete").otherwise("completed")
    body = F.when(F.col("doc_id") % 5 == 3, "").otherwise(F.col("text"))
    tail = F.when(F.col("doc_id") % 5 == 3, "").otherwise(F.col("lang"))
    reply = F.struct(
        status.alias("status"),
        F.array(
            item("reasoning", block("output_text", F.lit("no"))),
            item("message", block("output_text", body), block("reasoning_text", F.lit("no"))),
            item("message", block("output_text", tail)),
        ).alias("output"),
    )
    replies = V.load(spark, sf, "documents").select("doc_id", F.to_json(reply).alias("reply"))
    return enrichment.reply_texts(replies).select("doc_id", "reply_status", "answer")


def usable_responses(spark, sf):
    """Which of the stored responses, one per conversation turn, may be used."""
    response = F.to_json(
        F.struct(
            F.when(F.col("role") == "system", None).otherwise(F.array("text")).alias("explanations"),
            F.when(F.col("role") == "assistant", "ai").otherwise("rules").alias("source"),
        )
    )
    turns = V.load(spark, sf, "conversations").withColumn("response", response)
    return turns.select("conv_id", "turn", enrichment.response_is_usable(F.col("response")).alias("usable"))


def markdown_escapes(spark, sf):
    docs = V.load(spark, sf, "documents")
    return docs.select(
        "doc_id",
        text.markdown_text(F.col("text")).alias("paragraph"),
        text.table_cell(F.col("text")).alias("cell"),
    )


def html_escapes(spark, sf):
    pages = V.load(spark, sf, "pages")
    return pages.select("page_id", text.markdown_text(F.col("html")).alias("paragraph"))


def report_names(spark, sf):
    """Report file names and safe column names from every page address."""
    name = F.concat(F.lit("  "), F.col("url"), F.when(F.col("page_id") % 3 == 0, ".CSV ").otherwise(". "))
    return V.load(spark, sf, "pages").select(
        "page_id", text.report_file_name(name).alias("file_name"), text.safe_name(F.col("url")).alias("safe_name")
    )


def admissions(spark, sf):
    """Admission verdicts on a listing made of all pages: address as path, size of the text as length."""
    path = F.concat(F.col("url"), F.when(F.col("page_id") % 4 == 0, ".txt").otherwise(".Csv"))
    length = F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.octet_length("html"))
    listing = V.load(spark, sf, "pages").select("page_id", path.alias("path"), length.cast("bigint").alias("length"))
    return admit(listing, max_bytes=2 * 1024 * 1024 // 1024).select("page_id", "status", "error")


# Raw CSV lines of the orders, by remainder: short, long, quoted, empty and blank cells; and
# the cells a reader must find in them.
CSV_HEADER = "order_id,status,note,day"
_KEY, _DATE = "CAST(o_orderkey AS STRING)", "substr(CAST(o_orderdate AS STRING), 1, 10)"
CSV_LINES = [
    (f"{_KEY} || ',' || o_orderstatus || ',x,' || {_DATE}", ["o_orderstatus", "'x'", _DATE]),
    (_KEY, ["NULL", "NULL", "NULL"]),
    (f"{_KEY} || ',,'", ["''", "''", "NULL"]),
    (f"""{_KEY} || ',"","a ""q"", b",' || {_DATE}""", ["''", """'a "q", b'""", _DATE]),
    (f"{_KEY} || ',  ,z,' || {_DATE} || ',EXTRA,MORE'", ["'  '", "'z'", _DATE]),
    (f"""{_KEY} || ',"a,b"'""", ["'a,b'", "NULL", "NULL"]),
    (f"{_KEY} || ',' || o_orderstatus || ',' || o_orderpriority || ','", ["o_orderstatus", "o_orderpriority", "''"]),
]


CSV_BATCH = "substr(o_orderpriority, 1, 1)"


# Lines under names that differ in case only, with another separator; some have far more fields than the header.
WIDE_HEADER = "Id;id;status;note"
WIDE_LINES = [
    (f"{_KEY} || ';' || o_orderstatus || ';s;' || o_orderpriority", ["o_orderstatus", "'s'", "o_orderpriority"]),
    (f"{_KEY} || ';;\"a;b\";x,y'", ["''", "'a;b'", "'x,y'"]),
    (f"{_KEY} || CASE WHEN o_orderkey % 500 = 2 THEN repeat(';x', 30000) ELSE ';1,5;x' END",
     ["CASE WHEN o_orderkey % 500 = 2 THEN 'x' ELSE '1,5' END", "'x'", "CASE WHEN o_orderkey % 500 = 2 THEN 'x' END"]),
]


def _write_csv(spark: SparkSession, sf: str, header: str = CSV_HEADER, cases: list = CSV_LINES) -> str:
    """All orders as raw CSV lines under one header, in a folder per priority."""
    branches = " ".join(f"WHEN {i} THEN {line}" for i, (line, _) in enumerate(cases))
    V.load(spark, sf, "orders").createOrReplaceTempView("orders")
    lines = spark.sql(f"SELECT CASE o_orderkey % {len(cases)} {branches} END AS `{header}`, {CSV_BATCH} AS batch FROM orders")
    path = shared_path(spark, "orders-csv")
    _raw_csv(lines, path, "batch")
    return path


def csv_profile(spark, sf):
    scan = read_csv(spark, _write_csv(spark, sf), dataset_id=lambda p: F.lit("orders"))
    return column_facts(measure(scan.frame)).select(*FACT_COLUMNS)


def csv_parse_errors(spark, sf):
    scan = read_csv(spark, _write_csv(spark, sf), dataset_id=lambda p: F.lit("orders"))
    return scan.parse_errors.groupBy("dataset_id", "message").agg(F.count(F.lit(1)).alias("errors"))


def csv_separators(spark, sf):
    """Profile of lines with another separator, names that differ in case and lines of 30 000 fields."""
    scan = read_csv(spark, _write_csv(spark, sf, WIDE_HEADER, WIDE_LINES), dataset_id=lambda p: F.lit("orders"))
    return column_facts(measure(scan.frame)).select(*FACT_COLUMNS)


def csv_long_lines(spark, sf):
    scan = read_csv(spark, _write_csv(spark, sf, WIDE_HEADER, WIDE_LINES), dataset_id=lambda p: F.lit("orders"))
    return scan.parse_errors.groupBy("dataset_id", "message").agg(F.count(F.lit(1)).alias("errors"))


def dataset_statuses(spark, sf):
    """What became of every supplier and of the next free number."""
    result = audit(V.frame(spark, sf, V.SUPPLIERS))
    V.load(spark, sf, "supplier").createOrReplaceTempView("supplier")
    expected = spark.sql(
        "SELECT concat('supplier-', k) AS dataset_id FROM supplier LATERAL VIEW explode(array(s_suppkey, s_suppkey + 1000000)) AS k"
    )
    return result.statuses(expected)


# As the given files' texts run over many lines, with blank lines and quotes in them.
DOC_HEADER = "doc_id,lang,text"


def _raw_csv(lines: DataFrame, path: str, *by: str, encoding: str = "UTF-8") -> None:
    """Lines in one column named as the header, put down as they are."""
    raw = {"header": "true", "sep": "\x01", "quote": "", "emptyValue": "", "escapeQuotes": "false",
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": encoding}
    lines.write.options(**raw).partitionBy(*by).csv(path) if by else lines.write.options(**raw).csv(path)


def csv_quoted_line_ends(spark, sf):
    """Profile of all documents, written as CSV records whose quoted texts run over line ends."""
    V.load(spark, sf, "documents").createOrReplaceTempView("documents")
    record = """doc_id || ',' || lang || ',"' || replace(text, '"', '""') || '"'"""
    lines = spark.sql(f"SELECT doc_id, posexplode(split({record}, '\n')) AS (nth, line) FROM documents")
    lines = lines.repartition(8, "doc_id").sortWithinPartitions("doc_id", "nth")
    path = shared_path(spark, "documents-csv")
    _raw_csv(lines.select(F.col("line").alias(DOC_HEADER)), path)
    scan = read_csv(spark, path, dataset_id=lambda p: F.lit("documents"))
    return column_facts(measure(scan.frame)).select(*FACT_COLUMNS)


# Orders of each remainder under a header and with a separator of their own.
MANY_HEADERS = {
    0: (",", ["order_id", "status", "day"], ["o_orderstatus", _DATE]),
    1: (";", ["id", "status"], ["o_orderstatus"]),
    2: ("|", ["code", "day", "priority", "status"], [_DATE, "o_orderpriority", "o_orderstatus"]),
    3: ("\t", ["order_id", "priority"], ["o_orderpriority"]),
    4: (",", ["Id", "fecha", "note"], [_DATE, "'a;b'"]),
}


def _write_many(spark: SparkSession, sf: str) -> str:
    path = shared_path(spark, "many-csv")
    V.load(spark, sf, "orders").createOrReplaceTempView("orders")
    for rest, (sep, names, cells) in MANY_HEADERS.items():
        line = f" || '{sep}' || ".join([_KEY, *cells])
        lines = spark.sql(f"SELECT {line} AS `{sep.join(names)}` FROM orders WHERE o_orderkey % {len(MANY_HEADERS)} = {rest}")
        _raw_csv(lines, f"{path}/part{rest}")
    return path


def _of_part(path: F.Column) -> F.Column:
    return F.regexp_extract(path, "/(part[^/]+)/", 1)


def csv_many_headers(spark, sf):
    """Profile of files of five headers and four separators, in one plan."""
    result = audit_csv(spark, _write_many(spark, sf), dataset_id=_of_part)
    return column_facts(result.facts).select(*FACT_COLUMNS)


def csv_mixed_separators(spark, sf):
    """Separator found for each part of those files."""
    found = survey(spark, _write_many(spark, sf), dataset_id=_of_part).files
    return found.filter("status = 'accepted'").select("dataset_id", "sep", "width").distinct()


# Files of every sixteenth key, in the order of the keys.
PREVIEW_FILES = 16


def csv_previews(spark, sf):
    """First rows of every file of the damaged order lines, whatever the number of their cells."""
    branches = " ".join(f"WHEN {i} THEN {line}" for i, (line, _) in enumerate(CSV_LINES))
    V.load(spark, sf, "orders").createOrReplaceTempView("orders")
    lines = spark.sql(f"SELECT o_orderkey AS k, CASE o_orderkey % {len(CSV_LINES)} {branches} END AS `{CSV_HEADER}`, o_orderkey % {PREVIEW_FILES} AS batch FROM orders")
    path = shared_path(spark, "ordered-csv")
    _raw_csv(lines.repartition("batch").sortWithinPartitions("batch", "k").drop("k"), path, "batch")
    batch = lambda p: F.concat(F.lit("lote-"), F.regexp_extract(p, "batch=([^/]+)/", 1))
    return audit_csv(spark, path, dataset_id=batch).previews()


# Groups of suppliers, each a dataset of its own kind.
STATUS_GROUPS = 20


def csv_statuses(spark, sf):
    """What became of files of supplier groups: read, other bytes, another ending, no data, nothing at all."""
    V.load(spark, sf, "supplier").createOrReplaceTempView("supplier")
    path = shared_path(spark, "suppliers")
    lines = spark.sql(f"SELECT s_suppkey % {STATUS_GROUPS} AS part, s_name || 'é,' || s_nationkey AS `name,nation` FROM supplier")
    kind = F.col("part") % 5
    _raw_csv(lines.filter(kind == 0), f"{path}/read", "part")
    _raw_csv(lines.filter(kind == 1), f"{path}/bytes", "part", encoding="ISO-8859-1")
    lines.filter(kind == 2).write.partitionBy("part").text(f"{path}/text")
    _raw_csv(lines.filter(kind == 3).select("part", F.lit("").alias("a")), f"{path}/none", "part")
    of = lambda p: F.concat(F.lit("group-"), F.regexp_extract(p, "part=([0-9]+)/", 1))
    expected = lines.select(F.concat(F.lit("group-"), "part").alias("dataset_id")).distinct()
    return audit_csv(spark, path, dataset_id=of).statuses(expected)


def csv_batch_scores(spark, sf):
    """Risk of each folder of CSV files, audited in one job."""
    batch = lambda p: F.concat(F.lit("lote-"), F.regexp_extract(p, "batch=([^/]+)/", 1))
    return audit_csv(spark, _write_csv(spark, sf), dataset_id=batch).scores


def encoding_verdicts(spark, sf):
    """Documents written out by source, the text of every third source with a bad byte at its end."""
    docs = V.load(spark, sf, "documents")
    bad = F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3 == 0
    line = F.concat(F.col("text"), F.when(bad, F.unhex(F.lit("E9")).cast("string")).otherwise(""))
    path = shared_path(spark, "documents-text")
    docs.select("source", line.alias("line")).write.partitionBy("source").text(path)
    paths = [r.path for r in list_files(spark, path).select("path").collect()]
    verdicts = inspect_text(spark, paths, {})
    source = F.regexp_extract("path", r"source=([^/]+)/", 1)
    return verdicts.groupBy(source.alias("source")).agg(F.bool_and("valid_utf8").alias("valid_utf8"))


def report_documents(spark, sf):
    """The Markdown report of every supplier, suggested keys confirmed."""
    result = audit(V.frame(spark, sf, V.SUPPLIERS))
    accepted = result.candidates.select("dataset_id", "column_name", F.lit("confirm").alias("decision"))
    return result.reports(accepted)


def report_lines(spark, sf):
    """Numbered report lines of every supplier, nothing confirmed."""
    lines = audit(V.frame(spark, sf, V.SUPPLIERS)).report_lines()
    in_order = Window.partitionBy("dataset_id").orderBy("place")
    return lines.select("dataset_id", F.row_number().over(in_order).alias("line_no"), "line")


def report_files(spark, sf):
    """The numbered lines of every supplier's report, written to files and read back."""
    path = shared_path(spark, "reports")
    write_reports(audit(V.frame(spark, sf, V.SUPPLIERS)).report_lines(), path)
    in_order = Window.partitionBy("dataset_id").orderBy("place")
    lines = read_reports(spark, path)
    return lines.select("dataset_id", "report", F.row_number().over(in_order).alias("line_no"), "line")


def candidate_listing(spark, sf):
    """Candidates of every table and supplier in their listing order."""
    suggested = _candidates(*V.ALL_TABLES, V.DIRTY_ORDERS, V.SUPPLIERS)(spark, sf)
    in_order = Window.partitionBy("dataset_id").orderBy(*keys.listing_order())
    return suggested.select("dataset_id", F.row_number().over(in_order).alias("nth"), "column_name", "confidence")


def ignored_answers(spark, sf):
    """Every supplier is sent the answer about the one before it: what names no finding of its own."""
    result = audit(V.frame(spark, sf, V.SUPPLIERS))
    following = F.substring_index("dataset_id", "-", -1).cast("bigint") + 1
    entries = F.transform("findings", lambda f: F.struct(F.concat(F.lit(" "), f["finding_id"]).alias("findingId")))
    answers = result.dossiers.select(
        F.concat(F.lit("supplier-"), following).alias("dataset_id"),
        F.to_json(F.struct(entries.alias("explanations"))).alias("answer"),
    )
    return enrichment.ignored_answers(result.findings, answers).select("dataset_id", "answer_key")


def audit_summary(spark, sf):
    return audit(*[V.frame(spark, sf, v) for v in [*V.ALL_TABLES, V.SUPPLIERS]]).summary


QUERIES: dict[str, Query] = {
    "profile_orders": _profile(V.DIRTY_ORDERS),
    "profile_lineitem": _profile(V.plain("lineitem")),
    "profile_documents": _profile(V.plain("documents")),
    "profile_all_tables": _profile(*V.ALL_TABLES),
    "profile_suppliers": _profile(V.SUPPLIERS),
    "value_kinds_orders": value_kinds,
    "samples_part": _samples(V.plain("part", pos="p_partkey")),
    "samples_documents": _samples(V.plain("documents", pos="doc_id")),
    "preview_orders": preview_orders,
    "preview_suppliers": preview_suppliers,
    "audit_summary": audit_summary,
    "findings_nulls": _findings("nulls", V.DIRTY_ORDERS, V.DIRTY_PART),
    "findings_nulls_outer_join": _findings("nulls", V.LABELLED),
    "findings_empties": _findings("empties", V.DIRTY_ORDERS, V.DIRTY_PART),
    "findings_duplicates": _findings("duplicates", V.DIRTY_PART, V.plain("documents", ["text"]), V.SUPPLIER_FLAGS),
    "findings_invalid_dates": _findings("invalid_dates", V.DIRTY_ORDERS),
    "findings_events_temporal": _findings(None, V.plain("events")),
    "findings_suppliers": _findings(None, V.SUPPLIERS),
    "duplicate_rows_events": duplicate_rows,
    "duplicate_rows_ties": duplicate_rows_ties,
    "preview_ties": preview_ties,
    "dataset_statuses": dataset_statuses,
    "rule_status": _rule_status(V.DIRTY_ORDERS, V.DIRTY_PART, V.plain("lineitem"), V.plain("events")),
    "key_candidates": _candidates(*V.ALL_TABLES, V.DIRTY_ORDERS, V.SUPPLIERS),
    "candidate_listing": candidate_listing,
    "candidate_evidence": candidate_evidence,
    "candidate_decisions": candidate_decisions,
    "risk_scores": _scores(*V.ALL_TABLES),
    "risk_scores_suppliers": _scores(V.SUPPLIERS),
    "risk_breakdown": _breakdown(V.DIRTY_ORDERS, V.DIRTY_PART, V.SUPPLIERS),
    "risk_ranking_suppliers": _ranking(V.SUPPLIERS),
    "audit_payloads": _payloads(V.DIRTY_ORDERS, V.SUPPLIERS),
    "model_prompts": _prompts(V.DIRTY_ORDERS, V.SUPPLIERS),
    "payload_contract": payload_contract,
    "reply_texts": reply_texts,
    "usable_responses": usable_responses,
    "offline_explanations": offline_explanations,
    "merged_explanations": merged_explanations,
    "executive_summaries": executive_summaries,
    "ignored_answers": ignored_answers,
    "markdown_escapes": markdown_escapes,
    "html_escapes": html_escapes,
    "report_names": report_names,
    "file_admission": admissions,
    "csv_profile": csv_profile,
    "csv_parse_errors": csv_parse_errors,
    "csv_separators": csv_separators,
    "csv_long_lines": csv_long_lines,
    "csv_batch_scores": csv_batch_scores,
    "csv_quoted_line_ends": csv_quoted_line_ends,
    "csv_many_headers": csv_many_headers,
    "csv_mixed_separators": csv_mixed_separators,
    "csv_previews": csv_previews,
    "csv_statuses": csv_statuses,
    "encoding_verdicts": encoding_verdicts,
    "report_documents": report_documents,
    "report_lines": report_lines,
    "report_files": report_files,
}
