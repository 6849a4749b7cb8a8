"""What the physical plans must look like to hold at a thousand times the data."""

import re

import pytest
from pyspark.sql import functions as F

from prevuelo.operators.candidates import candidates
from prevuelo.operators.findings import findings
from prevuelo.operators.measure import measure, measure_counts
from prevuelo.operators.rows import extra_copies, preview
from prevuelo.operators.samples import first_values
from prevuelo.sources.frames import from_table
from prevuelo.sources.shared import written


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan") / "t")
    spark.range(1000).selectExpr("id", "id % 7 AS g", "concat('v', id) AS v", "id % 3 AS ds").write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def check_common(text):
    for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonEval", "ArrowEval", "MapInPandas", "SinglePartition"]:
        assert bad not in text


def test_measure_scans_once_and_shuffles_values_once(table):
    text = plan(measure(from_table(table, "t")))
    check_common(text)
    assert text.count("FileScan parquet") == 1
    keyed = [e for e in exchanges(text) if "key#" in e]
    assert len(keyed) == 1
    # values are counted before they travel, and the later shuffles carry tallies only
    assert "partial_count(1)" in text and len(exchanges(text)) == 3
    assert "SortAggregate" not in text


def test_counts_send_no_values(table):
    text = plan(findings(measure_counts(from_table(table, "t"), from_table(table, "u"))))
    check_common(text)
    assert "sha2" not in text and "key#" not in text
    assert len(exchanges(text)) == 2 and text.count("FileScan parquet") == 2


def test_counts_equal_measures(table):
    one, two = (
        f(from_table(table, "t")).select("column_pos", "row_count", "null_count", "empty_count", "invalid_date_count", "inferred_type")
        for f in (measure, measure_counts)
    )
    one, two = (sorted(map(tuple, d.filter("column_pos >= 0").collect())) for d in (one, two))
    assert one == two


def test_many_tables_share_one_shuffle(table):
    text = plan(measure(*[from_table(table, f"t{i}") for i in range(5)]))
    assert text.count("FileScan parquet") == 5
    assert len(exchanges(text)) == 3


def test_rules_add_no_shuffle(table):
    base = plan(measure(from_table(table, "t")))
    for rule in [findings, candidates]:
        text = plan(rule(measure(from_table(table, "t"))))
        check_common(text)
        assert len(exchanges(text)) == len(exchanges(base))


def test_only_named_columns_are_read(table):
    text = plan(measure(from_table(table, "t", F.col("id"), ["g"])))
    assert "ReadSchema: struct<id:bigint,g:bigint>" in text


def test_samples_filter_before_they_travel(table):
    frame = from_table(table, "t", F.col("id"), ["id", "v"])
    text = plan(first_values([frame], written(measure(frame), "facts")))
    check_common(text)
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(id,", text)


def test_preview_keeps_a_heap_not_a_sort(table):
    assert "TakeOrderedAndProject" in plan(preview(from_table(table, "t", F.col("id"))))
    many = plan(preview(from_table(table, F.col("ds"), F.col("id"))))
    check_common(many)
    assert "LessThanOrEqual(id," in many and "SortMergeJoin" not in many


def test_extra_copies_count_before_they_travel(table):
    text = plan(extra_copies(from_table(table, "t", F.col("id"), ["g"])))
    check_common(text)
    assert "partial_count(1)" in text and "Window" not in text


def test_preview_passes_on_ten_rows_a_task(table):
    """Of every dataset, each task sends its first ten rows at most."""
    many = plan(preview(from_table(table, F.col("ds"), F.col("id"))))
    window = many.index("WindowGroupLimit")
    limits = [m.start() for m in re.finditer("WindowGroupLimit", many)]
    assert "Partial" in many and len(limits) == 2
    # read from the bottom: the partial limit stands below the exchange, the final one above it
    assert window < many.index("Exchange hashpartitioning(dataset") < limits[1]


@pytest.mark.parametrize("partitions", [16, 200])
def test_copies_of_a_hot_row_are_not_dealt_to_one_task(spark, tmp_path, partitions):
    path = str(tmp_path / "t")
    spark.range(30_000).selectExpr("id", "IF(id % 3 = 0, 'hot', concat('v', id % 7000)) AS v").repartition(16).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = extra_copies(from_table(spark.read.parquet(path), "t", F.col("id"), ["v"]))
        assert "BroadcastHashJoin" in plan(found)
        sizes = [r.n for r in found.filter("v = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 9_999 and len(sizes) >= 8 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
