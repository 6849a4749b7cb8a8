"""Datasets that are dealt whole, against the same datasets as pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from prevuelo.functions import cells as C
from prevuelo.operators import measure as M
from prevuelo.operators.samples import first_values
from prevuelo.sources.frames import from_table
from prevuelo.sources.shared import written

POOL = [None, "", "  ", "a", "A", "42", "-1.5", "true", "2024-01-15", "15/01/2024", "2024-02-30", "-", "7" * 90, " " * 90,
        " ", "2024-01-15 10:00:00", " 2024-01-15", "largo " * 100, "\U0001f600"]


@pytest.fixture
def many(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, "p", "p", "p", "q", "r"]), rng.choice([None, *range(60)]), *rng.choices(POOL[: rng.choice([5, 19])], k=3)) for _ in range(900)]
    spark.createDataFrame(rows, "ds string, at long, a string, b string, c string").write.parquet(str(tmp_path / "t"))
    return from_table(spark.read.parquet(str(tmp_path / "t")), F.col("ds"), F.col("at"), ["a", "b", "c"])


def lines(facts):
    return sorted(map(repr, facts.drop("sample_bound").collect()))


@pytest.mark.parametrize("columns, whole_rows", [(None, True), (["b"], False), (["b"], True), ([], True)])
def test_dealt_or_as_pairs(many, monkeypatch, columns, whole_rows):
    """Every dataset as pairs, the large ones, the null one among them, and none."""
    found = []
    for limit in [0, 1000, M.DEALT_CELLS]:
        monkeypatch.setattr(M, "DEALT_CELLS", limit)
        found.append(lines(M.measure(many, columns=columns, whole_rows=whole_rows)))
    assert found[0] and found[0] == found[1] == found[2]


def test_samples_of_dealt_datasets(many, monkeypatch):
    found = []
    for limit in [0, M.DEALT_CELLS]:
        monkeypatch.setattr(M, "DEALT_CELLS", limit)
        found.append(sorted(map(repr, first_values([many], written(M.measure(many), "facts")).collect())))
    assert found[0] and found[0] == found[1]


def test_a_dealt_row_travels_once(many):
    text = M.measure(many)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange (\w+)", text)
    assert len(exchanges) == 1 and "Expand" not in text


def test_rows_behind_their_samples_are_not_spread(many):
    """The bound of a row's own dataset is looked at before its cells are spread."""
    text = first_values([many], written(M.measure(many), "facts"))._jdf.queryExecution().optimizedPlan().toString()
    assert "last_bound" in text[text.index("Expand"):]


def test_codes_by_first_characters(spark):
    """The codes are those of the patterns asked one after the other."""
    rng = random.Random(5)
    parts = ["2024", "01", "13", "31", "-", "/", " ", "T", "t", ":", "10:00:00", "true", "FALSE", ".", "\n", "x", "　", "02-30", "24:00", "-05", "Z"]
    texts = [p for p in POOL if p is not None] + ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(6000)]
    texts += [f"2024-{m}{e}" for m in ["01-01", "00-01", "12-32", "02-31"] for e in ["", " 23:59:59", "T24:00:00", " 24:00:00", "t00:00:60", "x", " ", "\n"]]
    plain = (
        f"CASE WHEN NOT v RLIKE r'[^{C.SPACE}]' THEN '0' WHEN v RLIKE r'{C.BOOLEAN}' THEN 'b' WHEN v RLIKE r'{C.NUMBER}' THEN 'n'"
        f" WHEN v RLIKE r'{C.LOOSE_DATE}' THEN IF({C.valid_date('v')}, 'D', 'd') WHEN {C.valid_date('v')} THEN 'S' ELSE 's' END"
    )
    both = spark.createDataFrame([(t,) for t in texts], "v string").selectExpr("v", f"{C.cell_code('v')} AS code", f"{plain} AS expected")
    assert both.filter("code <> expected").collect() == []
    assert both.select("code").distinct().count() == 7


def test_rows_are_dealt_without_being_held(many):
    """Up to 200 tasks the shuffle writes rows as they come; more only where shares would get too large."""
    assert [M._tasks(n) for n in [0, 1, 30_000_000, 1_500_000_000, 4_000_000_000]] == [1, 1, 30, 200, 500]


def test_keys_are_worked_out_before_the_spread(many, monkeypatch):
    """Once for a row and not once for each of its pairs; and dealt rows are sorted by a number."""
    assert "keys=[dealt#" in M.measure(many)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(M, "DEALT_CELLS", 0)
    text = M.measure(many)._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Expand") < text.index("sha2")


def test_keys_with_codes(spark):
    """Codes in front of keys are those of the patterns, whatever the cell; equal keys are equal cells."""
    rng = random.Random(7)
    parts = ["2024-01-15", "1", "-", "T", "t", "f", "A", "z", "true", "FALSE", ".", " ", "é", "Ñ", "\n", "\u00a0", "02-30", "x" * 30]
    texts = [p for p in POOL if p is not None] + ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)]
    texts = sorted({*texts, "A" * 32, "A" * 33, "7" * 32, "7" * 33, "2024-01-15" + " " * 30, "2024-02-30" + " " * 22, "Fals", "falsé"})
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    both = df.selectExpr("v", f"{C.coded_key('v')} AS key", f"{C.cell_code('v')} AS expected", f"{C.key_code(C.cell_key('v'))} AS code")
    assert both.filter(f"{C.coded_key_code('key')} <> expected OR code <> expected").collect() == []
    assert both.select("key").distinct().count() == len(texts)
    assert df.selectExpr(C.cell_key("v")).distinct().count() == len(texts)
    assert spark.sql(f"SELECT {C.coded_key('CAST(NULL AS STRING)')}").first()[0] is None


def test_usual_cells_need_no_look_aside(spark, monkeypatch):
    """Blank cells, days and what is only laid out like them get their codes in generated code; all else as before."""
    rng = random.Random(11)
    usual = ["", "  ", "\t", "17.0", "-5", "1-2-3", "A", "1996-01-02", "1996-13-01", "2024-02-30", "0099-01-01", "2023-02-29", "0000-00-00"]
    texts = ["".join(rng.choices("0012319- ", k=rng.choice([1, 3, 8, 9, 10, 11]))) for _ in range(3000)]
    texts += [f"{y}-{m}-{d}" for y in ["2024", "0100", "abcd", "+024", "20 4", "２02"] for m in ["02", "1", "13", " 1"] for d in ["29", "30", "1", "1 ", " 1", "1T", "3x"]]
    texts += ["     -  - ", "--5", "5-", "-1.5-", "-", "1e-5", "01-01-2024", "31/12/2024", "  ", "\x00", "\x00 ", "true", "Fals"]
    texts = sorted({*usual, *texts})
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    both = df.selectExpr("v", f"{C.coded_key_code(C.coded_key('v'))} AS code", f"{C.cell_code('v')} AS expected", f"{C.is_usable('v')} AS usable", f"v RLIKE r'[^{C.SPACE}]' AS seen")
    assert both.filter("code <> expected OR usable <> seen").collect() == []
    monkeypatch.setattr(C, "_code_aside", lambda cell: "'?'")
    quick = df.filter(F.col("v").isin(usual)).selectExpr("v", f"{C.coded_key_code(C.coded_key('v'))} AS code")
    assert quick.filter("code = '?'").collect() == [] and quick.count() == len(usual)
