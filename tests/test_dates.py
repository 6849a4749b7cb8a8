"""Lenient dates against verdicts of a JavaScript engine's own reader."""

from prevuelo.functions import cells as C

# Texts with a date prefix that the reader takes for dates, and texts that it does not.
DATES = [
    "2024-01-15", "2024-01-15 Jan", "2024-01-15T10:00", "2024-01-15T10:00Z", "2024-01-15 10:0", "2024-01-15 10:00:00",
    "2024-01-15 24:00:00", "2024-01-15 10:00 AM", "2024-01-15 10:00 Z", "2024-01-15 UTC", "2024-01-15 GMT+0530", "2024-01-15 EST",
    "2024-01-15(c)", "2024-01-15 (a", "2024-01-15, 10:00", "2024-01-15,", "2024-01-15.", "2024-01-15/", "2024-01-15:",
    "2024-01-15;", "2024-01-15  10:00", "2024-01-15 10:00 (x)", "2024-01-15 10:00 UT", "2024-01-15 Jan 10:00", "2024-01-15Z",
    "2024-01-15 z", "2024-01-15 10:00:00 GMT+0100 (CET)", "2024-01-15 10:00 +01:00", "2024-01-15\"", "2024-01-15 #",
    "2024-01-15 \u00a010:00", "2024-01-15\n10:00", "01/15/2024 ", "01/15/2024 10:", "01/15/2024 10:00", "01/15/2024 10:00:00.5",
    "01/15/2024 24:00", "01/15/2024 12:00 am", "01/15/2024 Z", "01/15/2024 GMT+5", "01/15/2024 GMT+05:30", "01/15/2024 PDT",
    "01/15/2024 (c)", "01/15/2024 (a (b))", "01/15/2024,10:00", "01/15/2024 ,", "01/15/2024 .", "01/15/2024-", "01/15/2024 /",
    "01/15/2024 :", "01/15/2024 ;", "01/15/2024\t10:00", "01/15/20240", "01/15/2024 10:00:00:00", "01/15/2024 10:00 UTC+1",
    "01/15/2024-", "01/15/2024z", "01/15/2024 10:00+01", "01/15/2024'", "01/15/2024!", "01/15/2024\u00a0", "01/15/2024\n",
    "01/15/2024 10:00\n", "1999-10-10 10:00:00:00 ,", "00/12/2024Dec-january", "2024-02-30(openz202410:",
    "01/15/2024!pdt10:january", "2024-01-15januarypm ", "2024-01-15january!'", "2024-12-31ut23:59", "2024-01-15T10:00",
    "2024-12-31 ' 10:00:00:00", "12/31/20245!Dec-10:00:00:00", "2024-12-31 ut+05:30", "12/31/20245pdt(open13:00 PMa.m.",
    "01/15/2024Z10:00", "1999-10-10Jan(openz0:00 am", "2024-12-31january\tjanuary", "01-15-2024GMT10:00:00.599", "2024-02-30pdt; ",
    "12/31/20245 EST0:00 am", "2024-02-30Jan(openEST", "2024-02-30(a (b) c)'/10:00", "12/31/20245'EST", "1999-10-10Z/10:",
    "1999-10-10ut9:5", "01/15/2024UTC#'Dec-", "2024-02-30GMT#ut", "1999-10-10(openGMT+5#)", "01/15/2024(open+05.",
    "12/31/20245(a (b) c)", "2024-12-31(a)GMT:", "12/31/20245january(open10:00:00:00", "12/31/20245pdt10:00:00.123456",
    "01/15/2024(openjanuary.", "01/15/2024(open\"Z", "01/15/2024 GMT+5", "2024-02-30\t(a (b) c)", "1999-10-10EST #",
    "01/15/2024Z(open25:00", "1999-10-10,0:00 am+0524:01", "12/31/20245ut(a)", "2024-02-30(open+05:30",
    "13/01/2024Dec-10:00:00.52024january",
]
NO_DATES = [
    "2024-01-15x", "2024-01-15 Monday", "2024-01-15T", "2024-01-15T24:01", "2024-01-15T10:00:00+05", "2024-01-15T10:00 +05:30",
    "2024-01-15 10", "2024-01-15 10:00:60", "2024-01-15 13:00 PM", "2024-01-15 10 AM", "2024-01-15 +05", "2024-01-15 +5",
    "2024-01-15 XST", "2024-01-15 -", "2024-01-15 1", "2024-01-15 2024", "2024-01-155", "2024-01-1500", "2024-01-15 10.30",
    "2024-01-15 10:00:00,5", "2024-01-15 T10:00", "2024-01-15-1", "2024-01-15 1/2", "2024-01-15 AM 10:00", "2024-01-15 10:00 pmx",
    "2024-01-15 a.m.", "2024-01-15 \u00e9", "2024-01-15 of", "2024-01-15 th", "2024-01-15st", "01/15/2024 x",
    "01/15/2024 January 2", "01/15/2024 Mon", "01/15/2024T10", "01/15/2024T10:00:00.123456", "01/15/2024T24:00",
    "01/15/2024t10:00", "01/15/2024T10:00+0530", "01/15/2024T1:00", "01/15/2024 25:00", "01/15/2024 10:00AM", "01/15/2024 AM",
    "01/15/2024 +0530", "01/15/2024 -5", "01/15/2024 )", "01/15/2024 10:00 x", "01/15/2024 99", "01/15/2024 5 6",
    "01/15/2024 10:00.5", "01/15/2024 10h", "01/15/2024 T 10:00", "01/15/2024/1", "01/15/2024 1-2", "01/15/2024+05:00",
    "01/15/2024 10:00 -0100x", "01/15/2024 10:00 A", "01/15/2024 10:00 p.m.", "01/15/2024\u00e9", "01/15/2024 de", "01/15/2024th",
    "00/12/2024ESTAM\",", "45/33/2024.10hz", "01/15/202410:00:6010:00:00.5AM10:00:00.5", "1999-10-1010:00:00.5-1234510:00pdt",
    "01-15-2024-1234525:00##", "1999-10-10-12345", "2024-01-15EST10:00:00.5zUTC", "1999-10-10,12:30 PM25:00",
    "12/31/2024524:0110:00:00.123456(open", "2024-01-15524:00'", "31-12-2024a.m. ", "1999-10-10z-12345de", "12/31/202455z-12345",
    "00/12/2024./'0:00 am", "00/12/202424:00UTC", "2024-02-30#99\"th", "12/31/2024523:59510:00:602024", "00/12/2024+05:30(open:",
    "13/01/202410:00+0530january#", "2024-12-3123:5910h10:00:60", "1999-10-105XST12:30 PM", "01/15/2024of-th",
    "01/15/2024th10:00:00.5", "12/31/20245pdt9:5z24:01", "2024-02-30#23:59!-",
]


def test_stored_verdicts(spark):
    rows = [(t, True) for t in DATES] + [(t, False) for t in NO_DATES]
    df = spark.createDataFrame(rows, "t string, is_date boolean").selectExpr("t", "is_date", f"{C.value_kind('t')} AS kind")
    assert [r for r in df.collect() if (r.kind == "date") != r.is_date] == []


def test_long_texts_end(spark):
    """No text is too long for the matcher, and none takes long."""
    tails = [" " * 200_000, " (a)" * 50_000, " (" + "(" * 100_000, " Z" * 50_000, " 10:00" + " +05" * 30_000, ",:" * 100_000 + "x"]
    df = spark.createDataFrame([("2024-01-15" + t,) for t in tails], "t string").selectExpr(f"{C.value_kind('t')} AS kind")
    assert [r.kind for r in df.collect()][0] == "date"
