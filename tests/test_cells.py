import calendar
import itertools

import pytest
from pyspark.sql import functions as F

from prevuelo.functions import cells as C
from prevuelo.functions import headers


def evaluate(spark, expr, values):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v string").coalesce(1)
    return [r.out for r in df.selectExpr("i", f"{expr} AS out").orderBy("i").collect()]


def test_missing_empty_usable(spark):
    values = [None, "", "   ", "\t\n", " 　﻿", "x", " x ", "0"]
    assert evaluate(spark, C.is_empty("v"), values) == [False, True, True, True, True, False, False, False]
    assert evaluate(spark, C.is_usable("v"), values) == [False] * 5 + [True] * 3


@pytest.mark.parametrize(
    "kind, values",
    [
        ("boolean", ["true", "FALSE", "True"]),
        ("number", ["42", "-7", "12.50", "007"]),
        ("date", ["2024-01-15", "01/15/2024", "01-15-2024", "2024-02-30", "2024-01-15T10:00:00Z"]),
        ("string", ["+5", ".5", "1e5", "1,000", " 42", "42\n", "true ", "15/01/2024", "2024-13-01", "hello", "-"]),
    ],
)
def test_value_kind(spark, kind, values):
    assert evaluate(spark, C.value_kind("v"), values) == [kind] * len(values)


# What a lenient JavaScript date reader does with a date and these tails (measured once, stored here).
ACCEPTED = {
    "2024-01-15": [
        "", " ", "  ", "\t", "Z", " Z", "T10:00", "T10:00:00", "T10:00:00Z", "T10:00:00.123", "T10:00:00+02:00",
        "T10:00:00+0200", "T24:00", "T24:00:00", " 10:00", " 10:00:00", " 10:00:00.5", " 10:00:00 Z", " 10:00:00Z",
        " 10:00:00 UTC", " 10:00 GMT", " 10:00 EST", " 10:00 AM", " 12:00 am", " 10:00:00 +0200", " 10:00:00 +2:00",
        " 10:00:00 +02", " 24:00", " 1:05", " 1:5", " UTC", ", 10:00", " 10:00 ", "t10:00", "\n",
    ],
    "01/15/2024": ["", " ", "Z", " 10:00", " 10:00:00.5", " 10:00 PM", " 10:00:00 -0530", " 24:00", ", 10:00"],
    "01-15-2024": ["", " ", " Z", " 10:00", " 10:00 PM", " 10:00:00 +02:00"],
}
REJECTED = {
    "2024-01-15": [
        "T", "T10", "T10:00+02", "T24:00:01", "T25:00", "T10:60", "T10:00:60", " 13:00 PM", " 10:00PM", " 24:00:01",
        " 25:00", " 10", " abc", "abc", "5", "-5", "T10:00:00 ", "T1:00", "T10:0", "T10:00:00,5", " PM", "T10:00 PM",
        "--", "-01",
    ],
    "01/15/2024": ["T10:00", "T10:00:00Z", " 13:00 PM", " 25:00", " 10", "abc"],
    "15/01/2024": ["", " 10:00"],
    "2024-00-10": ["", " 10:00"],
    "12/32/2024": [""],
}


@pytest.mark.parametrize("table, expected", [(ACCEPTED, True), (REJECTED, False)])
def test_loose_dates(spark, table, expected):
    values = [head + tail for head, tails in table.items() for tail in tails]
    got = evaluate(spark, f"{C._matches('v', C.LOOSE_DATE)}", values)
    assert [v for v, g in zip(values, got) if g != expected] == []


def test_valid_dates_against_the_calendar(spark):
    years = [0, 1, 99, 100, 1600, 1700, 1900, 1999, 2000, 2023, 2024, 2100, 2400, 9999]
    days = list(itertools.product(years, range(0, 14), range(0, 33)))

    def real(y, m, d):
        return y >= 100 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]

    for layout in ["{y:04}-{m:02}-{d:02}", "{d:02}/{m:02}/{y:04}", " {d:02}-{m:02}-{y:04}\t", "{y:04}-{m:02}-{d:02} 23:59:59"]:
        values = [layout.format(y=y, m=m, d=d) for y, m, d in days]
        assert evaluate(spark, C.valid_date("v"), values) == [real(*day) for day in days]


def test_invalid_date_layouts(spark):
    values = ["2024-01-15T24:00:00", "2024-01-15T10:00:00Z", "2024-01-15 10:00:00.5", "2024-1-5", "15/01-2024", "2024-01-15x"]
    assert evaluate(spark, C.valid_date("v"), values) == [False] * len(values)


def test_keys_identify_whole_values(spark):
    long = "palabra " * 5000
    values = ["a", long, long + "x", long[:-1], "s" + "0" * 44, "9" * 80, " " * 80, None, ""]
    keys = evaluate(spark, C.cell_key("v"), values)
    assert len(set(keys)) == len(values)
    assert all(k is None or len(k) <= 33 for k in keys)
    codes = evaluate(spark, C.key_code(C.cell_key("v").join("()")), values)
    assert codes == ["s", "s", "s", "s", "s", "n", "0", None, "0"]


def test_row_keys_do_not_run_together(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("a", None), ("1:a", "b"), ("a1:b", ""), ("a", "-"), ("-", "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(F.expr(C.row_key(["x", "y"]))).distinct().count() == len(rows)


def test_header_predicates(spark):
    names = ["event_type", "runtime", "precio", "ID", "user_id", "id_user", "identity", "CÓDIGO", "preferred", "nro"]
    df = spark.createDataFrame(list(enumerate(names)), "i long, n string").orderBy("i")
    name = F.col("n")

    def flags(column):
        return [n for n, r in zip(names, df.select(column.alias("f")).collect()) if r.f]

    assert flags(headers.is_temporal(name, F.lit("string"))) == ["event_type", "runtime"]
    assert flags(headers.names_primary_key(name)) == ["ID", "user_id", "id_user"]
    assert flags(headers.names_business_key(name)) == ["CÓDIGO", "preferred", "nro"]


def test_dates_with_offsets_and_comments(spark):
    values = [
        "2024-01-15 10:00:00 GMT+0200", "2024-01-15 10:00:00 (x)", "2024-01-15 10:00 UTC-3", "2024-01-15 (a) (b)", "01/15/2024 9:05 pm EST",
        "2024-01-15 10:00:00 (x", "2024-01-15 (a(b))", "2024-01-15 GMT+02 x",
    ]
    # the reader takes comments that are nested or left open, too
    assert evaluate(spark, C.value_kind("v"), values) == ["date"] * 7 + ["string"]
