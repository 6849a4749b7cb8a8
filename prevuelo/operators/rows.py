"""Operators that return rows of a frame: preview and extra copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prevuelo.functions.cells import array_key, row_key
from prevuelo.sources.frames import Frame, Records
from prevuelo.sources.shared import written

PREVIEW_ROWS = 10

# Rows are dealt into this many buckets to bound the first ten; see ``_first_rows``.
_BUCKETS = 64

# A key with more than its share of the copies in one of so many parts per shuffle partition is hot.
_PARTS = 8

# Equal rows at one position that one task puts out.
_TIED = 100_000


def _first_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The first ten rows of each dataset, numbered by ``nth``; rows that share a position are in the order of their keys.

    A stored bound per dataset, the tenth smallest of the first positions of hash buckets of rows, lets through at least
    ten rows and few more; of these every task passes on ten per dataset.
    """
    bucket = F.pmod(F.xxhash64("pos", *columns), F.lit(_BUCKETS)).alias("bucket")
    firsts = rows.groupBy("dataset", bucket).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    seen = firsts.groupBy("dataset").agg(F.array_sort(F.collect_list("first")).alias("seen"), F.max("last").alias("last"))
    bounds = written(seen.select("dataset", F.coalesce(F.get("seen", F.lit(PREVIEW_ROWS - 1)), "last").alias("bound")), "preview")
    last = bounds.agg(F.max("bound")).first()[0]
    early = rows.filter(F.col("pos") <= (-1 if last is None else last)).join(bounds, "dataset").filter("pos <= bound")
    in_order = Window.partitionBy("dataset").orderBy("pos", F.expr(key))
    return early.drop("bound").withColumn("nth", F.row_number().over(in_order)).filter(F.col("nth") <= PREVIEW_ROWS)


def preview(frame: Frame) -> DataFrame:
    """The first ten rows of each dataset, missing cells shown as empty text.

    Rows that share a position are taken in the order of their row keys; equal ones are the same to a reader.
    """
    if frame.name is not None:
        first = frame.rows.orderBy("pos").limit(PREVIEW_ROWS)
    else:
        first = _first_rows(frame.rows, row_key(frame.columns), frame.columns)
    shown = first.selectExpr("dataset", "pos", *[f"coalesce({c}, '') AS {c}" for c in frame.columns])
    return shown.toDF("dataset_id", "row_pos", *frame.headers)


def record_previews(records: Records) -> DataFrame:
    """(dataset_id, nth, column_pos, column_name, value): the first ten rows of each dataset, whatever its header."""
    first = _first_rows(records.rows, array_key("cells"), ["cells"])
    cells = first.select(F.col("dataset").alias("dataset_id"), "nth", F.posexplode("cells").alias("column_pos", "value"))
    named = cells.join(records.headers, ["dataset_id", "column_pos"])
    return named.select("dataset_id", "nth", "column_pos", "column_name", F.coalesce("value", F.lit("")).alias("value"))


def extra_copies(frame: Frame) -> DataFrame:
    """Every row that repeats an earlier row of its dataset, with the position it repeats.

    Of equal rows one at the first position is the original; rows that share that position with it are copies too.
    Equal rows are counted, and their first position found, on (row key, position) pairs with partial aggregation. The
    repeated keys are stored and meet the rows again: the hot ones, of which there can be only a few for each partition,
    are sent to all tasks, so that their rows stay where they are; the rows of the others are dealt by key.
    """
    spark = frame.rows.sparkSession
    keyed = frame.rows.withColumn("key", F.expr(row_key(frame.columns)))
    repeated = (
        keyed.groupBy("dataset", "key")
        .agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )
    repeated = written(repeated, "copies")
    share = (repeated.agg(F.sum("copies")).first()[0] or 0) / (_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # as many keys as there are parts can have more than one part's share: the bound of what is broadcast
    hot = F.broadcast(repeated.filter(F.col("copies") > share).drop("copies"))
    cold = repeated.filter(F.col("copies") <= share).drop("copies")
    met = keyed.join(hot, ["dataset", "key"]).unionByName(
        keyed.join(hot.drop("first_pos"), ["dataset", "key"], "left_anti").join(cold, ["dataset", "key"])
    )
    out = ["dataset", "pos", "first_pos", *frame.columns]
    # equal rows at the first position: all but one, from their number, put out in parts
    tied = met.filter("pos = first_pos").groupBy(*out).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = tied.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 2) DIV {_TIED})")))
    tied = tied.repartition("pos", "part", *frame.columns)
    tied = tied.withColumn("nth", F.explode(F.expr(f"sequence(1L, least({_TIED}L, n - 1 - part * {_TIED}L))")))
    copies = met.filter("pos > first_pos").select(*out).unionByName(tied.select(*out))
    return copies.toDF("dataset_id", "row_pos", "first_pos", *frame.headers)
