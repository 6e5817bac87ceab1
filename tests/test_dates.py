"""One layout per column: the vote, the parse and the rejected rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventlens.operators import dates

STAMP = dt.datetime(2020, 7, 25, 12, 27, 21)
DAY, MINUTE, MONTH = dt.datetime(2020, 7, 25), dt.datetime(2020, 7, 25, 12, 27), dt.datetime(2020, 7, 1)

#: (text, what it says, layout)
VALUES = [
    ("2020-07-25 12:27:21", STAMP, "year-month-day"),
    ("2020-07-25T12:27:21Z", STAMP, "year-month-day"),
    ("2020-07-25T12:27:21.123456789+00:00", STAMP.replace(microsecond=123456), "year-month-day"),
    ("2020-07-25 12:27", MINUTE, "year-month-day"),
    ("2020/07/25", DAY, "year/month/day"),
    ("2020.07.25", DAY, "year.month.day"),
    ("20200725", DAY, "yearmonthday"),
    ("20200725T122721", STAMP, "yearmonthday"),
    ("20200725122721", STAMP, "yearmonthday"),
    ("7/25/2020 1:05 PM", dt.datetime(2020, 7, 25, 13, 5), "month/day/year"),
    ("7/25/2020 12:05 a.m.", dt.datetime(2020, 7, 25, 0, 5), "month/day/year"),
    ("25/07/2020", DAY, "day/month/year"),
    ("25-07-2020 12:27", MINUTE, "day-month-year"),
    ("07-25-2020", DAY, "month-day-year"),
    ("25.07.2020 12:27:21", STAMP, "day.month.year"),
    ("25 Jul 2020", DAY, "day monthname year"),
    ("25-Jul-2020 12:27", MINUTE, "day monthname year"),
    ("Sat, 25 Jul 2020 12:27:21 GMT", STAMP, "day monthname year"),
    ("July 25, 2020", DAY, "monthname day year"),
    ("Jul 25 2020 12:27", MINUTE, "monthname day year"),
    ("Saturday, July 25th, 2020 12:27:21", STAMP, "monthname day year"),
    ("Sat Jul 25 12:27:21 PDT 2020", STAMP, "monthname day year"),
    ("Sat Jul 25 12:27:21 +0000 2020", STAMP, "monthname day year"),
    ("2020-Jul-25", DAY, "year monthname day"),
    ("2020-07", MONTH, "year-month"),
    ("July 2020", MONTH, "monthname year"),
]


def test_every_layout_reads_its_values(spark):
    df = spark.createDataFrame([(i, v) for i, (v, *_) in enumerate(VALUES)], "i int, v string")
    split = dates.split_value(df, "v")
    got = {r["i"]: r for r in split.select("i", "__date", *[dates.read_date(x).alias(x.name.replace(".", "_")) for x in dates.LAYOUTS]).collect()}
    for i, (value, want, layout) in enumerate(VALUES):
        assert got[i][layout.replace(".", "_")] == want, (value, got[i])


@pytest.mark.parametrize("pattern,winner", [("%m/%d/%Y", "month/day/year"), ("%d/%m/%Y", "day/month/year"), ("%d.%m.%Y", "day.month.year")])
def test_values_that_one_layout_alone_reads_decide(spark, pattern, winner):
    days = [dt.date(2021, 1, 1) + dt.timedelta(n) for n in range(365)]
    df = spark.createDataFrame([(i, d.strftime(pattern)) for i, d in enumerate(days)], "i int, d string").repartition(3)
    found = dates.vote(df, ["d"])["d"]
    assert (found.layout, found.read[winner], found.values) == (winner, 365, 365)
    got = dates.with_timestamp(df, "d", found.layout).select("i", "_ts").collect()
    assert all(r["_ts"].date() == days[r["i"]] for r in got)


def test_month_first_wins_a_draw_and_several_columns_at_once(spark):
    df = spark.createDataFrame([("01/02/2020", "5 May 2020", None), ("03/04/2020", "6 May 2020", " ")], "a string, b string, c string")
    found = dates.vote(df, ["a", "b", "c"])
    assert (found["a"].layout, found["b"].layout, found["c"].layout, found["c"].values) == ("month/day/year", "day monthname year", None, 0)
    assert dates.with_timestamp(df, "c", None).where("_ts is not null").count() == 0


def test_unread_rows_come_back_with_a_reason(spark):
    rows = [(1, "2020-07-25"), (2, "2020-02-30"), (3, "25/07/2020"), (4, "soon"), (5, None), (6, ""), (7, "2020-07-26 25:00"), (8, "2020-13-01")]
    df = spark.createDataFrame(rows, "i int, d string")
    layout = dates.column_layout(df, "d")
    assert layout == "year-month-day"
    bad = {r["i"]: r["reason"] for r in dates.rejected(df, "d", layout).collect()}
    assert bad == {2: "no layout", 3: "another layout", 4: "no layout", 7: "no layout", 8: "no layout"}
    assert [r["i"] for r in dates.with_timestamp(df, "d", layout).where(F.col("_ts").isNotNull()).collect()] == [1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "d string")
    assert dates.column_layout(df, "d") is None and dates.rejected(df, "d", None).count() == 0


def test_a_vote_reads_a_date_once_however_many_values_hold_it(spark):
    stamps = [dt.datetime(2021, 3, 14) + dt.timedelta(minutes=7 * n) for n in range(2000)]
    df = spark.createDataFrame([(f"{t:%d/%m/%Y %H:%M:%S}", f"{t:%B %d, %Y}", "13/13/2020 25:00") for t in stamps], "a string, b string, c string")
    counted = dates.date_counts(df, ["a", "b", "c"])
    days = len({t.date() for t in stamps})
    assert {(r["name"], r["clock"]): r["count"] for r in counted.groupBy("name", "clock").count().collect()} == {("a", True): days, ("b", True): days, ("c", False): 1}
    found = dates.vote(df, ["a", "b", "c"])
    assert (found["a"].layout, found["a"].read["day/month/year"], found["b"].read["monthname day year"]) == ("day/month/year", 2000, 2000)
    assert (found["c"].layout, found["c"].values) == (None, 2000)


@pytest.mark.parametrize(
    "value,date,hour,minute,second",
    [
        ("12:30 2020-07-25 12:30", "2020-07-25", 12, 30, "0"), ("2020-07-25 1:02:03.5 PM", "2020-07-25", 13, 2, "3.5"), ("2020-07-25 13:02 pm", "2020-07-25", None, 2, "0"),
        ("2020-07-25 12:30:", "2020-07-25", 12, 30, "0"), ("2020-07-25\t 12:30 Z", "2020-07-25", 12, 30, "0"), ("202007251227", "20200725", 12, 27, "0"),
        (", Jul 25,  2020 ,", "Jul 25, 2020", 0, 0, "0"), ("a:b", "a:b", 0, 0, "0"), ("2020-07-25\n", "2020-07-25", 0, 0, "0"),
    ],
)
def test_parts_of_odd_values(spark, value, date, hour, minute, second):
    got = dates.split_value(spark.createDataFrame([(value,)], "v string"), "v").first()
    assert (got["__date"], got["__hour"], got["__minute"], float(got["__second"])) == (date, hour, minute, float(second))


def test_a_filter_on_a_read_date_does_not_repeat_the_split(spark):
    df = spark.createDataFrame([(1, "25/07/2020 10:00"), (2, "soon")], "i int, d string")
    good = dates.with_timestamp(df, "d", "day/month/year").where(F.col("_ts").isNotNull())
    assert [r["i"] for r in good.collect()] == [1]
    for frame in (good, dates.rejected(df, "d", "day/month/year")):
        assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert [(r["i"], r["reason"]) for r in dates.rejected(df, "d", "day/month/year").collect()] == [(2, "no layout")]
