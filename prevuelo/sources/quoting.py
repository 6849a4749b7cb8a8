"""Records of files in which quoted cells run over line ends, without reading any file in one piece.

A line maps the state in which it begins (inside a quoted cell or not) to the state in which it ends, and such maps can
be composed: they are composed within each split of a file, then over its splits, which gives the state at the start of
every split and with it that of every line. A record that goes on in the next splits is found by where it was opened.

What is read is stored once, so that splits and line numbers stay the same in all that follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prevuelo.sources.files import position_in_file
from prevuelo.sources.shared import written


def _before(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``known``, ``odd``: what the lines before each one make of the state at the start.

    Columns ``always`` (the state in which a line ends, whatever it was before; else NULL) and ``turns`` (the line
    changes the state) tell what a line does. The state before a line is ``known``, or else that at the start, turned if
    ``odd``.
    """
    up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = F.when(F.col("turns"), F.lit(1)).otherwise(0)
    df = df.withColumn("turned", F.coalesce(F.sum(turned).over(up_to), F.lit(0)))
    fixed = F.last(F.when(F.col("always").isNotNull(), F.struct("always", "turned")), ignorenulls=True).over(up_to)
    df = df.withColumn("fixed", fixed)
    since = F.col("turned") - F.coalesce(F.col("fixed.turned"), F.lit(0))
    return df.select("*", F.col("fixed.always").alias("known"), (since % 2 == 1).alias("odd")).drop("turned", "fixed")


def _turned(state: Column, odd: Column) -> Column:
    return state != odd


def _effects(lines: DataFrame) -> DataFrame:
    """``always`` and ``turns`` of a line from how it ends when begun outside (``opens``) and inside (``stays``) quotes."""
    opens, stays = F.col("opens"), F.col("stays")
    return lines.select("*", F.when(opens == stays, opens).alias("always"), F.coalesce(opens & ~stays, F.lit(False)).alias("turns"))


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block, start, carry) of every split: whether it begins inside a quoted cell, and the position of the record
    that was opened last in the splits before it."""
    quotes = written(_before(_effects(lines.where("opens IS NOT NULL").select("file", "block", "row", "opens", "stays")), ["file", "block"], "row"), "quotes")
    # what a whole split does, from its last line with a quote; packed into a number behind the row, so that max finds it
    always = F.coalesce("always", F.when(F.col("known").isNotNull(), _turned(F.col("known"), _turned(F.col("odd"), F.col("turns")))))
    turns = F.when(F.col("always").isNull() & F.col("known").isNull(), _turned(F.col("odd"), F.col("turns"))).otherwise(False)
    code = F.when(always.isNull(), 0).when(always, 2).otherwise(4) + F.when(turns, 1).otherwise(0)
    ends = quotes.groupBy("file", "block").agg(F.max(F.shiftleft("row", 3).bitwiseOR(code)).alias("last"))
    splits = lines.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    effect = F.col("last").bitwiseAND(F.lit(6))
    splits = splits.select(
        "file", "block", F.when(effect == 2, True).when(effect == 4, False).alias("always"), F.coalesce(F.col("last") % 2 == 1, F.lit(False)).alias("turns")
    )
    starts = _before(splits, ["file"], "block").select("file", "block", _turned(F.coalesce("known", F.lit(False)), F.col("odd")).alias("start"))
    starts = written(starts, "starts")
    # a quote that opens a cell in a line begun outside; the last one before a split is the record that enters it
    inside = _turned(F.coalesce("known", "start"), F.col("odd"))
    opened = quotes.join(starts, ["file", "block"]).where(~inside & F.col("opens"))
    opened = opened.groupBy("file", "block").agg(F.max(position_in_file(F.col("block"), F.col("row"))).alias("opened"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return starts.join(opened, ["file", "block"], "left").select("file", "block", "start", F.max("opened").over(earlier).alias("carry"))


def assemble(lines: DataFrame) -> DataFrame:
    """(file, pos, text): the records of stored lines (file, block, row, value, opens, stays).

    ``opens`` and ``stays`` tell whether a line with a quote ends inside a quoted cell, begun outside or inside of one;
    NULL for lines without. Empty lines outside of quotes are no records. A cell that is never closed ends with its file.
    """
    found = _before(_effects(lines.join(written(_starts(lines), "splits"), ["file", "block"])), ["file", "block"], "row")
    inside = _turned(F.coalesce("known", "start"), F.col("odd"))
    pos = position_in_file(F.col("block"), F.col("row"))
    begins = ~F.col("inside") & ~F.col("value").isin("", "\r")
    so_far = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    found = found.select("file", "block", "row", "value", F.coalesce("opens", F.lit(False)).alias("opens"), inside.alias("inside"), "carry")
    found = found.withColumn("pos", F.coalesce(F.max(F.when(begins, pos)).over(so_far), "carry"))
    alone = found.where(begins & ~F.col("opens")).select("file", "pos", F.col("value").alias("text"))
    # the lines of one record, wherever they were read
    several = found.where(F.col("inside") | (begins & F.col("opens"))).groupBy("file", "pos")
    in_order = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    text = F.array_join(F.transform(in_order, lambda x: x["value"]), "\n")
    return alone.unionByName(several.agg(text.alias("text")))
