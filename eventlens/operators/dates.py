"""I20 for whole columns: one layout per column, found by a vote of all its rows, then one parse.

A value is split once into a time (24 hours or AM/PM, fraction cut at microseconds), a zone and a
day name, which are dropped (the wall clock stays), and a date. Every layout reads the date by a
pattern of its own, so layouts of one shape (month first, day first) are told apart by the values
that only one of them can read. The vote is one aggregate of a count per layout and column; the
layout that reads most values wins, of equals the one listed first. Values that it cannot read come
back as rows, with the reason.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month and day names, and the shapes of times and zones.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_NAME = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
)
DAY_NAME = r"(?i)^(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:r|rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"
COMPACT_TIME = r"^(\d{8})[T ]?(\d{2})(\d{2})(\d{2})?(?:\.\d+)?(?:Z)?$"
TIME = r"(?i)(?:^|[ T,])(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?(?:\s*([ap])\.?m\b\.?)?"
ZONE = rf"(?:\s*(?:Z|(?:UTC|GMT)?[+-]\d{{2}}:?\d{{2}}|(?!{MONTH_NAME}\b)[A-Z]{{2,5}})(?![A-Za-z0-9]))?"


@dataclass(frozen=True)
class Layout:
    """A date layout: its name, a pattern of the whole date, which of its pieces are year, month and day (0: the first), and what parts them."""

    name: str
    pattern: str
    year: int
    month: int
    day: int
    sep: str = ""
    named: bool = False


def _numbers(sep: str, name: str) -> list[Layout]:
    """Month first and day first, with one separator."""
    pattern = rf"^(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})$"
    return [Layout(f"month{name}day{name}year", pattern, 3, 1, 2, name), Layout(f"day{name}month{name}year", pattern, 3, 2, 1, name)]


#: In the order that decides between layouts which read equally many values.
LAYOUTS = (
    Layout("year-month-day", r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3, "-"),
    Layout("year/month/day", r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3, "/"),
    Layout("year.month.day", r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", 1, 2, 3, "."),
    Layout("yearmonthday", r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    *_numbers("/", "/"),
    *_numbers("-", "-"),
    *_numbers(r"\.", "."),
    Layout("monthname day year", rf"(?i)^{MONTH_NAME} +(\d{{1,2}})(?:st|nd|rd|th)?,? +(\d{{4}})$", 3, 1, 2, named=True),
    Layout("day monthname year", rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?[ -]{MONTH_NAME}[ ,-]+(\d{{4}})$", 3, 2, 1, named=True),
    Layout("year monthname day", rf"(?i)^(\d{{4}})[ -]{MONTH_NAME}[ -](\d{{1,2}})$", 1, 2, 3, named=True),
    Layout("year-month", r"^(\d{4})-(\d{2})$", 1, 2, 0, "-"),
    Layout("monthname year", rf"(?i)^{MONTH_NAME},? +(\d{{4}})$", 2, 1, 0, named=True),
)
BY_NAME = {layout.name: layout for layout in LAYOUTS}
PARTS = ("__date", "__hour", "__minute", "__second")


def split_value(df: DataFrame, col: str) -> DataFrame:
    """``df`` with the parts of a text date: date, hour (null if there is none that can be), minute, second.

    A pattern runs only on values with a character that it needs; the time is found once and cut as text. What
    several columns use is a column of its own, so that it is computed once, in code of a size that gets compiled.
    """
    c = F.col
    timed = lambda name: F.contains(c(name), F.lit(":"))
    at = df.withColumn("__trimmed", F.trim(c(col).cast("string")))
    at = at.withColumn("__named", F.when(F.ascii("__trimmed") >= ord("A"), F.regexp_replace("__trimmed", DAY_NAME, "")).otherwise(c("__trimmed")))
    compact = (F.length("__named") >= 12) & ~timed("__named")
    at = at.withColumn("__spaced", F.when(compact, F.regexp_replace("__named", COMPACT_TIME, "$1 $2:$3:$4")).otherwise(c("__named")))
    at = at.withColumn("__plain", F.when(timed("__spaced"), F.regexp_replace("__spaced", r":$", "")).otherwise(c("__spaced")))
    # "[ T,]h:mm[:ss[.f]][ am]", empty if there is none
    at = at.withColumn("__time", F.when(timed("__plain"), F.regexp_extract("__plain", TIME, 0)).otherwise(F.lit("")))
    none = c("__time") == ""
    # what stands before the time, if nothing follows it
    before = F.length("__plain") - F.length("__time")
    last = none | (F.position(c("__time"), c("__plain")) == before + 1)
    at = at.withColumns({"__cut": F.split("__time", ":"), "__bare": F.when(last, F.substring(c("__plain"), F.lit(1), before))})
    text = F.get("__cut", F.lit(2))
    at = at.withColumns({
        "__said": F.when(~none, F.translate(F.get("__cut", F.lit(0)), " Tt,", "").cast("int")),
        "__half": F.when(F.contains(F.lower("__time"), F.lit("m")), F.lower(F.regexp_extract("__plain", TIME, 4))).otherwise(F.lit("")),
        "__digits": F.when(F.contains(text, F.lit(".")), F.regexp_extract(text, r"^\d+(?:\.\d{1,6})?", 0)).otherwise(F.substring(text, 1, 2)),
    })
    said, half = c("__said"), c("__half")
    hour = F.when(none, F.lit(0)).when(half == "", said).when(said.between(1, 12), said % 12 + F.when(half == "p", 12).otherwise(0))
    minute = F.when(~none, F.substring(F.get("__cut", F.lit(1)), 1, 2).cast("int"))
    zero = F.lit(0).cast("decimal(16,6)")
    second = F.when(c("__digits").isNull(), zero).otherwise(F.coalesce(c("__digits").try_cast("decimal(16,6)"), zero))
    whole = F.regexp_replace("__plain", TIME + ZONE, " ")
    date = F.when(c("__bare").rlike(r"^[0-9A-Za-z./-]*\z"), c("__bare")).otherwise(F.trim(F.regexp_replace(whole, r"^[\s,]+|[\s,]+$|\s(?=\s)", "")))
    parts = {"__date": date, "__hour": hour, "__minute": F.coalesce(minute, F.lit(0)), "__second": second}
    at = at.withColumns(parts)
    # a generator of one row: a filter on what is read from the date would else be moved below the split, with
    # every shared column written out again in it
    kept = [c(x) for x in [*df.columns, *PARTS[1:]]]
    return at.select(*kept, F.explode(F.array("__date")).alias("__date"))


def read_date(layout: Layout) -> Column:
    """The timestamp of split parts under a layout; null if it cannot read them.

    The pattern runs once, on dates of its kind; a date that matches is cut at its separators.
    """
    date = F.col("__date")
    kind = F.contains(date, F.lit(layout.sep)) if layout.sep else F.length(date) == 8
    kind = date.rlike("[A-Za-z]") if layout.named else kind
    whole = F.when(kind & date.rlike(layout.pattern), date)
    if layout.named:
        cut = F.split(whole, "[ ,-]+")
    else:
        cut = F.split(whole, re.escape(layout.sep)) if layout.sep else F.array(*[F.substring(whole, a, n) for a, n in ((1, 4), (5, 2), (7, 2))])
    group = lambda i: F.get(cut, F.lit(i - 1)) if i else F.lit("1")
    if layout.named:
        month = (F.instr(F.lit(MONTHS), F.lower(F.substring(group(layout.month), 1, 3))) + 2) / 3
        day = F.translate(group(layout.day), "stndrhSTNDRH", "")  # 1st, 2nd, 3rd, 4th
    else:
        month, day = group(layout.month).try_cast("int"), group(layout.day)
    return F.try_make_timestamp_ntz(
        group(layout.year).try_cast("int"), month.cast("int"), day.try_cast("int"), F.col("__hour"), F.col("__minute"), F.col("__second")
    )


def _there(col: str) -> Column:
    return F.col(col).isNotNull() & (F.trim(F.col(col).cast("string")) != "")


@dataclass(frozen=True)
class Vote:
    """What a column's values say: values that are there, how many each layout reads, the winner (None if none reads any)."""

    values: int
    read: dict[str, int]
    layout: str | None


def date_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(name, __date, clock, n): the values that are there, counted by column, date and whether their time is one."""
    listed = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")
    long = split_value(df.select(listed).select("x.name", "x.value").where(_there("value")), "value")
    clock = F.try_make_timestamp_ntz(F.lit(2000), F.lit(1), F.lit(1), F.col("__hour"), F.col("__minute"), F.col("__second")).isNotNull()
    return long.select("name", "__date", clock.alias("clock")).groupBy("name", "__date", "clock").agg(F.count(F.lit(1)).alias("n"))


def vote(df: DataFrame, cols: Sequence[str]) -> dict[str, Vote]:
    """The layout of every column, from one aggregate over all rows (a row of counts per column).

    Layouts read the date alone, and a time is one or none whatever the date: so each date of a column is read
    once, not each value, after a count that is combined before the shuffle.
    """
    day = {"__hour": F.lit(0), "__minute": F.lit(0), "__second": F.lit(0).cast("decimal(16,6)")}
    read_by = [F.when(F.col("clock") & read_date(layout).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, layout in enumerate(LAYOUTS)]
    said = date_counts(df, cols).withColumns(day).select("name", "n", reduce(lambda a, b: a + b, read_by).alias("bits")).groupBy("name", "bits").agg(F.sum("n").alias("n"))
    found: dict[tuple[str, int], int] = {}
    for r in said.collect():  # at most a row per column and set of layouts that read one text
        for i in (-1, *[i for i in range(len(LAYOUTS)) if r["bits"] >> i & 1]):
            found[r["name"], i] = found.get((r["name"], i), 0) + r["n"]
    out = {}
    for c in cols:
        read = {layout.name: found.get((c, i), 0) for i, layout in enumerate(LAYOUTS)}
        best = max(read, key=read.get)  # the first of equals
        out[c] = Vote(found.get((c, -1), 0), read, best if read[best] else None)
    return out


def with_timestamp(df: DataFrame, col: str, layout: str | None, out: str = "_ts") -> DataFrame:
    """``df`` with ``out``: the column's values read by one layout, null where that cannot be."""
    if layout is None:
        return df.withColumn(out, F.lit(None).cast("timestamp_ntz"))
    split = split_value(df, col)
    return split.withColumn(out, F.when(_there(col), read_date(BY_NAME[layout]))).drop(*PARTS)


def rejected(df: DataFrame, col: str, layout: str | None) -> DataFrame:
    """The rows whose value is there but unread, with ``reason``: another layout's, or none's."""
    marked = with_timestamp(df, col, layout, "__ts").where(_there(col) & F.col("__ts").isNull()).drop("__ts")
    split = split_value(marked, col)
    other = reduce(lambda a, b: a | b, [read_date(x).isNotNull() for x in LAYOUTS])
    return split.withColumn("reason", F.when(other, "another layout").otherwise("no layout")).drop(*PARTS)


def is_text(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes)[col] in ("string",) or dict(df.dtypes)[col].startswith(("varchar", "char"))


def column_layout(df: DataFrame, col: str) -> str | None:
    """The layout of one text column."""
    return vote(df, [col])[col].layout
