"""Records over line ends, separators and headers of many files, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from prevuelo.operators.measure import column_facts, measure, measure_counts
from prevuelo.plans.audit import audit_csv
from prevuelo.sources import csv as source
from prevuelo.sources import files
from prevuelo.sources.files import file_name, inspect_text
from prevuelo.sources.frames import from_table


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Splits of 200 bytes, so that records run over several of them."""
    monkeypatch.setattr(files, "_BLOCK_BITS", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def written_by_hand(rng, sep, width, n, end):
    """A file's text and its rows, as Python's reader sees them."""

    def cell():
        kind = rng.random()
        if kind < 0.2:
            inner = "".join(rng.choice(["a", '""', sep, "\n", "\r\n", "\n\n", "   \n", "é", " "]) for _ in range(rng.choice([3, 20, 150])))
            return f'"{inner}"'
        return rng.choice(["", "x", "5\" tubo", " ", "long text " * 3, "1", "a'b"])

    lines = [sep.join(f"h{i}" for i in range(width))]
    for _ in range(n):
        cells = [cell() for _ in range(width)]
        cells = cells[: rng.randint(1, width)] if rng.random() < 0.1 else cells + ["more"] * (rng.random() < 0.1)
        lines.append(sep.join(cells))
        lines += [""] * (rng.random() < 0.05) + ["  "] * (rng.random() < 0.05)
    text = end.join(lines) + end * rng.randint(0, 2)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return text, rows[0], rows[1:]


@pytest.mark.parametrize("seed", range(3))
def test_files_of_all_kinds_against_a_plain_reader(spark, small_splits, tmp_path, seed):
    rng, want, errors, names = random.Random(seed), set(), set(), {}
    for i in range(6):
        sep, width = ",;|\t"[i % 4], 2 + i % 3
        text, header, rows = written_by_hand(rng, sep, width, 60, ["\n", "\r\n"][i % 2])
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
        names[f"f{i}.csv"] = header
        for k, row in enumerate(rows):
            padded = [*row[:width], *[None] * (width - len(row))]
            if any((c or "").strip() for c in padded):
                want.add((f"f{i}.csv", k, *padded))
            if len(row) != width:
                few = "few" if len(row) < width else "many"
                errors.add((f"f{i}.csv", k, f"Too {few} fields: expected {width} fields but parsed {len(row)}"))
    found = source.read_all(spark, str(tmp_path), dataset_id=file_name)
    assert found.records.rows.rdd.getNumPartitions() > 6
    got_names = {}
    for r in found.records.headers.orderBy("column_pos").collect():
        got_names.setdefault(r.dataset_id, []).append(r.column_name)
    assert got_names == names
    in_order = {}
    for r in found.records.rows.orderBy("dataset", "pos").collect():
        in_order.setdefault(r.dataset, []).append(tuple(r.cells))
    wanted = {}
    for name, _, *cells in sorted(want, key=lambda w: w[:2]):
        wanted.setdefault(name, []).append(tuple(cells))
    assert in_order == wanted
    assert {(r.dataset_id, r.row, r.message) for r in found.parse_errors.collect()} == errors


def test_one_quoted_line_end_keeps_all_splits(spark, tmp_path):
    rows = [f"{i},v{i}" for i in range(200_000)]
    (tmp_path / "big.csv").write_text("id,v\n" + "\n".join([*rows[:5], '"5\n5",x', "  ", *rows[5:]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1024 * 1024))
    try:
        found = source.read_all(spark, str(tmp_path), dataset_id=file_name)
        read = files.raw_lines(spark, str(tmp_path)).rdd.getNumPartitions()
        assert read > 2 and found.records.rows.count() == 200_001
        # no file goes through one task: the stored lines keep the splits they were read in
        assert spark.read.parquet(*[p for p in found.parse_errors.inputFiles() if "records-" in p]).rdd.getNumPartitions() >= 2
        assert [(r.row, r.message) for r in found.parse_errors.collect()] == [(6, "Too few fields: expected 2 fields but parsed 1")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plans_do_not_grow_with_headers(spark, tmp_path):
    plans = []
    for n in (1, 7):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"id,x{i}\n{i},2\n")
        found = source.read_all(spark, str(folder), dataset_id=file_name)
        text = plan(measure(found.records)), plan(found.parse_errors)
        assert all("MultiLine" not in t for t in text)
        plans.append([t.count("Relation [") for t in text])
    assert plans[0] == plans[1]


def test_every_line_votes_on_the_separator(spark, tmp_path):
    """The first ten lines speak for commas, the thousands behind them do not."""
    lines = ["id;name,x", *[f"{i};a,b" for i in range(9)], *[f"{i};a,b,{i},c" for i in range(3000)]]
    (tmp_path / "late.csv").write_text("\n".join(lines))
    (tmp_path / "commas.csv").write_text("a,b;c\n1,2;3\n" + "4,5\n" * 50)
    (tmp_path / "tabs.csv").write_text("a\tb\n1\t2,5\n3\t4,5\n")
    a = audit_csv(spark, str(tmp_path), dataset_id=file_name)
    assert {r.dataset_id: r.parse_error_count for r in a.summary.collect()} == {"late.csv": 0, "commas.csv": 0, "tabs.csv": 0}
    names = {(r.dataset_id, r.column_name) for r in a.profile.collect()}
    assert names == {("late.csv", "id"), ("late.csv", "name,x"), ("commas.csv", "a"), ("commas.csv", "b;c"), ("tabs.csv", "a"), ("tabs.csv", "b")}


def test_the_rule_in_sql_is_the_rule_on_lines(spark, tmp_path):
    rng, want = random.Random(8), {}
    for i in range(25):
        lines = ["".join(rng.choice(["a", "b", ",", ";", "\t", "|", '"x,y"', " "]) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))]
        lines = [line if line.count('"') % 2 == 0 else "q" for line in lines]
        (tmp_path / f"f{i}.csv").write_text("\n".join(lines))
        want[f"f{i}.csv"] = source.detect_separator(lines) or ","
    got = source.survey(spark, str(tmp_path), dataset_id=file_name).files
    assert {r.dataset_id: r.sep for r in got.collect()} == want


def test_datasets_of_several_files(spark, tmp_path):
    for folder, name, text in [("x", "a", "id,v\n1,2\n"), ("x", "b", "id,v\n3,4\n"), ("x", "c", "other\n5\n"), ("y", "a", "k\n1\n2\n")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.csv").write_text(text)
    a = audit_csv(spark, str(tmp_path), dataset_id=lambda p: F.element_at(F.split(p, "/"), -2))
    assert {(r.dataset_id, r.row_count, r.column_count) for r in a.summary.collect()} == {("x", 2, 2), ("y", 2, 1)}
    assert [(r.dataset_id, r.status) for r in a.rejected.collect()] == [("x", "other_header")]
    assert {r.k for r in a.preview("y").collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        a.preview("z")


def test_line_ends_of_all_kinds(spark, tmp_path):
    (tmp_path / "cr.csv").write_bytes(b'id,v\r1,"a\rb"\r\r2,c\r')
    (tmp_path / "crlf.csv").write_bytes(b'id,v\r\n1,"a\r\nb"\r\n\r\n2,c\r\n')
    (tmp_path / "open.csv").write_bytes(b'id,v\n1,2\n3,"never closed\n4,5\n')
    found = source.read_all(spark, str(tmp_path), dataset_id=file_name)
    got = {}
    for r in found.records.rows.orderBy("dataset", "pos").collect():
        got.setdefault(r.dataset, []).append(tuple(r.cells))
    assert got["crlf.csv"] == [("1", "a\r\nb"), ("2", "c")]
    assert got["cr.csv"] == [("1", "a\nb"), ("2", "c")]
    assert got["open.csv"] == [("1", "2"), ("3", "never closed\n4,5")]
    assert [(r.dataset_id, r.row, r.message) for r in found.parse_errors.collect()] == [("open.csv", 1, "Malformed quotes")]


def test_malformed_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"x"y\n2,"z"  \n3,"p""q"\n4,"r\n')
    found = source.read_all(spark, str(tmp_path), dataset_id=file_name)
    assert [tuple(r.cells) for r in found.records.rows.orderBy("pos").collect()] == [("1", '"x"y'), ("2", "z"), ("3", 'p"q'), ("4", "r")]
    assert sorted((r.row, r.message) for r in found.parse_errors.collect()) == [(0, "Malformed quotes"), (3, "Malformed quotes")]


def test_records_are_measured_like_frames(spark, tmp_path):
    rng = random.Random(3)
    values = ["1", "2.5", "x", "", "  ", "2024-01-31", "true", "y" * 40]
    rows = [[rng.choice(values) for _ in range(3)] for _ in range(200)]
    rows = [r for r in rows if any(c.strip() for c in r)]
    (tmp_path / "t.csv").write_text("id,code,v\n" + "".join(",".join(r) + "\n" for r in rows))
    records = source.read_all(spark, str(tmp_path), dataset_id=lambda p: F.lit("t")).records
    frame = from_table(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, id string, code string, v string"), "t", F.col("at"), ["id", "code", "v"])
    for how in (measure, measure_counts, lambda s: measure(s, columns=["code"]), lambda s: measure(s, columns=["id", "v"], whole_rows=False)):
        one, two = (sorted(map(tuple, how(s).drop("sample_bound").collect())) for s in (records, frame))
        assert one == two and one
    assert column_facts(measure(records, from_table(spark.range(3), "u"))).count() == 4


def test_inspection_tells_widths(spark, tmp_path):
    (tmp_path / "w.csv").write_text('a;b,c\n1;2\n"x;y";3\n')
    line = inspect_text(spark, str(tmp_path), {}, ",;").first()
    assert [[(b.x, b.y) for b in h] for h in line.widths] == [[(1, 2.0), (2, 1.0)], [(2, 3.0)]] and line.first_line == "a;b,c"
