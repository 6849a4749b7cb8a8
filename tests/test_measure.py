"""The measures against a plain Python count, on random rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prevuelo.operators.candidates import candidates
from prevuelo.operators.findings import findings, rule_status
from prevuelo.operators.measure import column_facts, measure, row_facts
from prevuelo.operators.rows import extra_copies, preview
from prevuelo.operators.samples import sample_values
from prevuelo.operators.score import ranking, scores
from prevuelo.sources.frames import from_table
from prevuelo.sources.shared import written

POOL = [None, "", "  ", " ", "a", "A", "a ", "42", "-1.5", "true", "2024-01-15", "15/01/2024", "2024-02-30",
        "largo " * 100, "largo " * 100 + "!", "7" * 90, " " * 90, "x" * 44, "x" * 45]
VALID = re.compile(r"\s*(2024-01-15|15/01/2024)\s*")


def brute(rows, width):
    kept = [r for r in rows if any(c is not None and c.strip() for c in r)]
    out = {}
    for i in range(width):
        values = [r[i] for r in kept]
        usable = [v for v in values if v is not None and v.strip()]
        kinds = set()
        for v in usable:
            if v in ("true",):
                kinds.add("boolean")
            elif re.fullmatch(r"-?\d+(\.\d+)?", v):
                kinds.add("number")
            elif v in ("2024-01-15", "2024-02-30"):
                kinds.add("date")
            else:
                kinds.add("string")
        out[i] = (
            len(kept), values.count(None), len([v for v in values if v is not None and not v.strip()]),
            len(set(usable)), (kinds or {"string"}).pop() if len(kinds) < 2 else "mixed",
            len([v for v in usable if not VALID.fullmatch(v)]), list(dict.fromkeys(usable))[:10],
        )
    return out, len(kept), len(set(kept))


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    width, pool = rng.randint(1, 4), rng.sample(POOL, rng.randint(2, len(POOL)))
    data = {
        name: [tuple(rng.choice(pool) for _ in range(width)) for _ in range(rng.randint(1, 120))] for name in "pqr"
    }
    flat = [(name, i, *row) for name, rows in data.items() for i, row in enumerate(rows)]
    rng.shuffle(flat)
    headers = [f"c{i}" for i in range(width)][::-1]
    df = spark.createDataFrame(flat, ", ".join(["ds string", "at long", *[f"{h} string" for h in headers]]))
    many = from_table(df, F.col("ds"), F.col("at"), headers)
    single = from_table(df.filter("ds = 'p'"), "alone", F.col("at"), headers)
    facts = written(measure(many, single), "facts")
    samples = sample_values([many, single], facts)
    profile = column_facts(facts).join(samples, ["dataset_id", "column_pos"], "left").collect()
    totals = {r.dataset_id: (r.row_count, r.unique_count) for r in row_facts(facts).collect()}
    for name, rows in [*data.items(), ("alone", data["p"])]:
        expected, kept, distinct = brute(rows, width)
        if not kept:
            assert name not in totals
            continue
        assert totals[name] == (kept, distinct)
        got = {
            r.column_pos: (r.row_count, r.null_count, r.empty_count, r.unique_count, r.inferred_type,
                           r.invalid_date_count, r.sample_values or [])
            for r in profile if r.dataset_id == name
        }
        assert got == expected


def test_samples_of_many_values(spark):
    """More values than buckets, some with late first positions, some hot."""
    rng = random.Random(1)
    rows = [(i, str(rng.randint(0, 3)) if i < 500 else str(rng.randint(0, 400)), "hot" if i % 3 else f"v{i}") for i in range(3000)]
    frame = from_table(spark.createDataFrame(rows, "at long, a string, b string").repartition(7), "t", F.col("at"), ["a", "b"])
    got = {r.column_pos: r.sample_values for r in sample_values([frame], written(measure(frame), "facts")).collect()}
    assert got == {0: list(dict.fromkeys(r[1] for r in rows))[:10], 1: list(dict.fromkeys(r[2] for r in rows))[:10]}


@pytest.mark.parametrize("missing, total, severity", [(1, 5, "alto"), (1, 20, "medio"), (1, 100, "bajo"), (1, 21, "bajo")])
def test_severity_borders(text_frame, missing, total, severity):
    rows = [("k", None if i < missing else "v") for i in range(total)]
    hit = findings(measure(text_frame(["k", "email"], rows))).filter("category = 'nulls'").first()
    assert (hit.severity, hit["count"]) == (severity, missing)


def test_both_roundings(text_frame):
    rows = [("k", None if i < 3 else "v") for i in range(2000)]
    hit = findings(measure(text_frame(["k", "v"], rows))).filter("category = 'nulls'").first()
    assert hit.percentage == 0.2 and "(0.1%)" in hit.description


def test_date_rule(text_frame):
    bad = text_frame(["created_date"], [("2024-01-15",), ("2024-13-01",), ("2024-02-30",), ("15/01/2024",)])
    hit = findings(measure(bad)).filter("category = 'invalid_dates'").first()
    assert hit["count"] == 2
    good = text_frame(["event_date"], [("2024-01-15",), ("2024-06-30",), ("01/12/2024",)])
    assert findings(measure(good)).filter("category = 'invalid_dates'").count() == 0


def test_late_rule_is_silent(text_frame):
    frame = text_frame(["event_date", "ingestion_date"], [("2024-01-15", "2024-01-20"), ("2024-01-16", "2024-01-15")])
    facts = measure(frame)
    assert findings(facts).count() == 0
    status = {r.rule: (r.status, r.rules_executed) for r in rule_status(facts).collect()}
    assert status["late_arriving"] == ("evaluated_no_finding", 5)
    one = rule_status(measure(text_frame(["event_date"], [("2024-01-15",)]))).filter("rule = 'late_arriving'").first()
    assert one.status == "not_evaluable"


def test_score_cap_and_rank(spark):
    found = spark.createDataFrame(
        [("a", 0, i, f"f{i}", "alto") for i in range(6)] + [("b", 0, 0, "x", "medio"), ("b", 0, 1, "y", "bajo")],
        "dataset_id string, rule_pos int, column_pos int, finding_id string, severity string",
    )
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset_id string")
    ranked = {r.dataset_id: (r.risk_rank, r.raw_total, r.total, r.risk_level) for r in ranking(scores(every, found)).collect()}
    assert ranked == {"a": (1, 120, 100, "alto"), "b": (2, 15, 15, "bajo"), "c": (3, 0, 0, "bajo")}


@pytest.mark.parametrize(
    "header, values, expected",
    [
        ("id", [str(i) for i in range(100)], ("primary_key", "alta")),
        ("user_id", [str(min(i, 98)) for i in range(100)], ("primary_key", "media")),
        ("user_id", [str(min(i, 96)) for i in range(100)], None),
        ("id", [None] + [str(i) for i in range(99)], None),
        ("id", ["2024-01-15"], None),
        ("product_code", [str(i) for i in range(100)], ("business_key", "alta")),
        ("ref", [None] * 5 + [str(i) for i in range(95)], ("business_key", "media")),
        ("numero", [str(min(i, 89)) for i in range(100)], ("business_key", "baja")),
        ("numero", [None] * 6 + [str(i) for i in range(94)], None),
        ("updated_at", ["x"] * 10, ("incremental_marker", "alta")),
        ("updated_at", [None, None] + ["x"] * 8, ("incremental_marker", "media")),
        ("updated_at", [None] * 3 + ["x"] * 7, None),
        ("created_at", ["x"] * 10, ("incremental_marker", "media")),
        ("load_date", [""] + ["x"] * 9, ("incremental_marker", "baja")),
        ("last_update_id", [str(i) for i in range(10)], ("incremental_marker", "alta")),
        ("precio", [str(i) for i in range(10)], None),
    ],
)
def test_candidates(text_frame, header, values, expected):
    frame = text_frame([header, "pad"], [(v, "z") for v in values])
    got = candidates(measure(frame)).filter(F.col("column_name") == header).first()
    assert (got and (got.candidate_type, got.confidence)) == expected


def test_row_operators(text_frame):
    rows = [("a", None), ("b", ""), ("a", None), ("a", ""), ("b", ""), ("b", ""), (None, "z")]
    frame = text_frame(["x", "y"], rows)
    copies = sorted((r.row_pos, r.first_pos, r.x, r.y) for r in extra_copies(frame).collect())
    assert copies == [(2, 0, "a", None), (4, 1, "b", ""), (5, 1, "b", "")]
    shown = [(r.x, r.y) for r in preview(frame).orderBy("row_pos").collect()]
    assert shown == [(x or "", y or "") for x, y in rows]


def test_wide_table(spark):
    frame = from_table(spark.range(50).selectExpr(*[f"id % {i + 1} AS col{i}" for i in range(300)]), "wide")
    got = {r.column_pos: r.unique_count for r in column_facts(measure(frame)).collect()}
    assert got == {i: min(i + 1, 50) for i in range(300)}


def test_names_must_differ(text_frame):
    with pytest.raises(ValueError):
        measure(text_frame(["a"], [("1",)]), text_frame(["a"], [("1",)]))


def test_positions_are_asked_for_behind_a_shuffle(spark):
    from pyspark.sql import functions as F

    from prevuelo.sources.frames import from_table

    df = spark.range(10).withColumn("g", F.col("id") % 3)
    from_table(df.filter("id > 2").select("g"), "t")
    for other in (df.groupBy("g").count(), df.repartition(3), df.join(df.select("id"), "id"), df.orderBy("g")):
        with pytest.raises(ValueError, match="pos"):
            from_table(other, "t")
        from_table(other, "t", F.col("g"))
