import pytest

from prevuelo.plans.audit import audit_csv
from prevuelo.sources.csv import detect_separator, read_csv
from prevuelo.sources.files import admit, file_name


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path / name)

    return put


def cells(scan):
    return [tuple(r)[2:] for r in scan.frame.with_headers().orderBy("row_pos").collect()]


def errors(scan):
    return sorted((r.row, r.message) for r in scan.parse_errors.filter("row IS NOT NULL").collect())


def test_missing_is_not_empty(spark, write):
    scan = read_csv(spark, write("a.csv", "id,status\n1,active\n2\n3,\n4,inactive"))
    assert cells(scan) == [("1", "active"), ("2", None), ("3", ""), ("4", "inactive")]
    assert errors(scan) == [(1, "Too few fields: expected 2 fields but parsed 1")]


def test_ragged_and_quoted_lines(spark, write):
    text = 'k,a,b,c\n1,active,"a ""q"" b",z\n2\n3,,x\n4,"",y\n5,"a,b"\n6,  ,z,EXTRA,MORE\n,,\n'
    scan = read_csv(spark, write("c.csv", text))
    assert cells(scan) == [
        ("1", "active", 'a "q" b', "z"),
        ("2", None, None, None),
        ("3", "", "x", None),
        ("4", "", "y", None),
        ("5", "a,b", None, None),
        ("6", "  ", "z", "EXTRA"),
    ]
    assert [row for row, _ in errors(scan)] == [1, 2, 3, 4, 5, 6]


def test_quoted_line_end_and_blank_lines(spark, write):
    scan = read_csv(spark, write("b.csv", 'id,status\n1,active\n"x\ny",2\n\n   \n9,8,7\n'))
    assert cells(scan) == [("1", "active"), ("x\ny", "2"), ("9", "8")]
    assert errors(scan) == [
        (2, "Too few fields: expected 2 fields but parsed 1"),
        (3, "Too many fields: expected 2 fields but parsed 3"),
    ]


def test_stray_and_long_quotes(spark, write):
    cell = 'dice ""hola"" ' * 3000
    path = write("q.csv", 'id,medida\n1,5" tubo\n2,"' + cell + '"\n3,x"y"z\n')
    scan = read_csv(spark, path)
    assert cells(scan) == [("1", '5" tubo'), ("2", 'dice "hola" ' * 3000), ("3", 'x"y"z')]
    assert errors(scan) == []
    from prevuelo.sources.csv import _complete_line
    from prevuelo.sources.files import inspect_text

    assert not inspect_text(spark, [path], {",": _complete_line(",")}).first().whole_file[","]
    torn = write("torn.csv", 'id,medida\n1,"a\nb"\n' + '2,"' + cell + '\n')
    assert inspect_text(spark, [torn], {",": _complete_line(",")}).first().whole_file[","]
    long = read_csv(spark, write("short.csv", 'id,a,b\n1,"' + cell + '"\n2,x,y\n'))
    assert errors(long) == [(0, "Too few fields: expected 3 fields but parsed 2")]


def test_trailing_newline_is_no_row(spark, write):
    scan = read_csv(spark, write("t.csv", "id,nombre\n1,Alice\n2,Bob\n3,Carol\n"))
    assert len(cells(scan)) == 3 and errors(scan) == []


def test_rows_keep_file_order_over_splits(spark, write):
    body = "".join(f"{i},v{i % 7}\n" if i % 1000 else f"{i}\n" for i in range(40_000))
    path = write("big.csv", "id,v\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024))
    try:
        scan = read_csv(spark, path)
        assert scan.frame.rows.rdd.getNumPartitions() > 1
        assert [row for row, _ in errors(scan)] == list(range(0, 40_000, 1000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_of_a_split_file_are_in_order(spark, write):
    path = write("long.csv", "id,v\n" + "".join(f"{i},{'x' * 90}\n" for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1024 * 1024))
    try:
        scan = read_csv(spark, path)
        assert scan.frame.rows.rdd.getNumPartitions() > 3
        assert [r.id for r in scan.frame.with_headers().orderBy("row_pos").collect()] == [str(i) for i in range(60_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folder_of_all_sorts(spark, write, tmp_path):
    write("a.csv", "id,status\n1,active\n2,x\n")
    write("bad.csv", b"id,status\n1,\xe9\n")
    write("bom.csv", b"\xef\xbb\xbfid,status\n1,caf\xc3\xa9\n")
    write("empty.csv", "")
    write("lone.csv", "only\nx\ny\n")
    write("other name+1.csv", "a;b;c\n1;2,5;3\n4;5,5;6\n")
    write("notes.txt", "id,status\n1,2")
    write("header.csv", "id,status\n")
    a = audit_csv(spark, str(tmp_path), dataset_id=file_name)
    expected = spark.createDataFrame([(p.name,) for p in tmp_path.iterdir()], "dataset_id string")
    assert {r.dataset_id: r.status for r in a.statuses(expected).collect()} == {
        "a.csv": "audited",
        "bad.csv": "encoding",
        "bom.csv": "audited",
        "empty.csv": "empty",
        "lone.csv": "audited",
        "other name+1.csv": "audited",
        "notes.txt": "extension",
        "header.csv": "no_data",
    }
    widths = {r.dataset_id: (r.row_count, r.column_count) for r in a.summary.collect()}
    assert widths == {"a.csv": (2, 2), "bom.csv": (1, 2), "lone.csv": (2, 1), "other name+1.csv": (2, 3)}
    assert [r.column_name for r in a.profile.filter("dataset_id = 'bom.csv'").orderBy("column_pos").collect()] == ["id", "status"]
    lone = a.parse_errors.filter("dataset_id = 'lone.csv'").collect()
    assert [(r.row, r.message) for r in lone] == [(None, "Unable to auto-detect delimiting character; defaulted to ','")]


def test_bad_files_do_not_end_the_job(spark, write, tmp_path):
    write("a.csv", b"caf\xe9,x\n1,2\n")
    write("b.csv", "\n\n")
    write("c.csv", "id,status\n1,x\n")
    a = audit_csv(spark, str(tmp_path), dataset_id=file_name)
    assert {r.dataset_id: r.status for r in a.rejected.collect()} == {"a.csv": "encoding", "b.csv": "no_data"}
    assert [(r.dataset_id, r.row_count) for r in a.summary.collect()] == [("c.csv", 1)]
    with pytest.raises(ValueError, match="UTF-8"):
        audit_csv(spark, str(tmp_path / "a.csv"))


def test_refusals(spark, write):
    with pytest.raises(ValueError, match="vacío"):
        read_csv(spark, write("e.csv", ""))
    with pytest.raises(ValueError, match="UTF-8"):
        read_csv(spark, write("u.csv", b"id,x\n1,\xff\xfe\n"))
    with pytest.raises(ValueError, match="Formato no soportado"):
        read_csv(spark, write("data.xlsx", "id,x\n1,2\n"))


def test_admission_takes_the_first_reason(spark):
    files = spark.createDataFrame(
        [("a.csv", 10), ("B.CSV", 10_485_760), ("c.csv", 10_485_761), ("d.csv", 0), ("e.txt", 0)], "path string, length long"
    )
    verdicts = {r.path: (r.status, r.error) for r in admit(files, max_bytes=10 * 1024 * 1024).collect()}
    assert verdicts == {
        "a.csv": ("admitted", None),
        "B.CSV": ("admitted", None),
        "c.csv": ("too_big", "El archivo excede el tamaño máximo permitido (10 MB)."),
        "d.csv": ("empty", "El archivo está vacío."),
        "e.txt": ("extension", "Formato no soportado. Solo se permiten archivos: .csv"),
    }


def test_separator_detection():
    assert detect_separator(["a,b,c", "1,2,3"]) == ","
    assert detect_separator(["a;b;c", "1,5;2;3", "1;2;3"]) == ";"
    assert detect_separator(["a\tb", "1\t2"]) == "\t"
    assert detect_separator(["a|b", '"x|y"|2']) == "|"
    assert detect_separator(["solo", "x"]) is None


def test_names_as_written(spark, write):
    scan = read_csv(spark, write("h.csv", 'Id,id,id,"long\nname",\n1,2,3,4,5\n'))
    assert scan.frame.headers == ("Id", "id", "id", "long\nname", "")
    assert [tuple(r)[2:] for r in scan.frame.rows.collect()] == [("1", "2", "3", "4", "5")] and errors(scan) == []


def test_paths_with_pattern_characters(spark, write, tmp_path):
    for name in ("ventas[1].csv", "d{1}.csv", "a*b.csv", "q?.csv"):
        write(name, "id,x\n1,2\n")
    assert audit_csv(spark, str(tmp_path), dataset_id=file_name).summary.count() == 4


def test_stray_quotes_are_counted_from_a_cells_start(spark, write):
    scan = read_csv(spark, write("s.csv", 'a,b,c,d,e\n1,x"b,c",\n'))
    assert cells(scan) == [("1", 'x"b', 'c"', "", None)]
    assert errors(scan) == [(0, "Too few fields: expected 5 fields but parsed 4")]


def test_line_of_very_many_fields(spark, write):
    scan = read_csv(spark, write("w.csv", "a,b,c\n1,2,3\n" + "x," * 30_000 + "x\n4,5,6\n"))
    assert cells(scan) == [("1", "2", "3"), ("x", "x", "x"), ("4", "5", "6")]
    assert errors(scan) == [(1, "Too many fields: expected 3 fields but parsed 30001")]


def test_many_headers_are_inspected_once(spark, write, tmp_path, monkeypatch):
    from prevuelo.sources import csv

    calls = []
    plain = csv.inspect_text
    monkeypatch.setattr(csv, "inspect_text", lambda *a: calls.append(a) or plain(*a))
    for i in range(6):
        write(f"f{i}.csv", f"id,x{i % 4}\n{i},2\n")
    a = audit_csv(spark, str(tmp_path), dataset_id=file_name)
    assert len(calls) == 1 and len(a.frames) == 4 and a.summary.count() == 6
    shown = a.preview("f5.csv")
    assert shown.columns == ["dataset_id", "row_pos", "id", "x1"] and shown.first().id == "5"
