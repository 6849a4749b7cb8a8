"""Preview and extra copies where rows share positions, and where one row fills a third of a table."""

from collections import Counter

from pyspark.sql import functions as F

from prevuelo.operators.findings import findings
from prevuelo.operators.measure import measure
from prevuelo.operators.rows import extra_copies, preview
from prevuelo.sources.frames import from_table


def frame(spark, rows, many=False):
    df = spark.createDataFrame(rows, "ds string, at long, a string, b string")
    return from_table(df, F.col("ds") if many else "t", F.col("at"), ["a", "b"])


def test_copies_on_one_position(spark):
    rows = [("t", 1, "x", "y")] * 5 + [("t", 1, "p", "q")] * 3 + [("t", 1, "x", "z")]
    f = frame(spark, rows)
    got = Counter(tuple(r)[1:] for r in extra_copies(f).collect())
    assert got == {(1, 1, "x", "y"): 4, (1, 1, "p", "q"): 2}
    found = findings(measure(f)).filter("category = 'duplicates'").first()
    assert found["count"] == sum(got.values())


def test_copies_on_mixed_positions(spark):
    rows = [("t", p, "x", None) for p in (3, 1, 1, 2, 3, 3)] + [("t", 9, "", "y"), ("t", 9, None, "y")]
    got = Counter(tuple(r)[1:] for r in extra_copies(frame(spark, rows)).collect())
    assert got == {(1, 1, "x", None): 1, (2, 1, "x", None): 1, (3, 1, "x", None): 3}


def test_preview_of_tied_rows(spark):
    rows = [("d", 1, f"v{i % 4}", "w") for i in range(25)] + [("e", 5, "only", None)]
    got = preview(frame(spark, rows, many=True)).collect()
    assert Counter(r.dataset_id for r in got) == {"d": 10, "e": 1}
    given = Counter((r[0], r[1], r[2], r[3] or "") for r in rows)
    assert all(n <= given[k] for k, n in Counter(map(tuple, got)).items())
    again = preview(frame(spark, rows[::-1], many=True)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_a_hot_row_is_many_tasks(spark, tmp_path):
    path = str(tmp_path / "hot")
    spark.range(30_000).selectExpr("id", "IF(id % 3 = 0, 'same', concat('v', id)) AS a").repartition(4).write.parquet(path)
    f = from_table(spark.read.parquet(path), "t", F.col("id"), ["a"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        copies = extra_copies(f)
        assert copies.count() == 9_999
        sizes = copies.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) >= 4 and max(r["count"] for r in sizes) < 5_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
