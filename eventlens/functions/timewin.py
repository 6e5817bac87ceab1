"""Tolerant timestamp parsing and weekly windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text layouts, tried in order, after a zone is dropped (wall clock kept),
# '/' and 'T' are made '-' and ' ', and month-first dates are turned round.
NUMBER_FORMATS = ("yyyy-M-d H:mm:ss[.SSSSSS]", "yyyy-M-d H:mm", "yyyy-M-d")
ZONE = r"(\d:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$"
MONTH_FIRST = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?=$|[ T])"
YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=$|[ T])"
LONG_FRACTION = r"(\.\d{6})\d+$"
# "Mon Apr 06 22:19:45 PDT 2009", "Wed Oct 10 20:19:24 +0000 2018": day name and zone are dropped.
DAYNAME_LAYOUT = r"^[A-Za-z]{3},? ([A-Za-z]{3}) +(\d{1,2} \d{2}:\d{2}:\d{2}) (?:[A-Za-z]{2,5}|[+-]\d{4}) (\d{4})$"
DAYNAME_FORMAT = "MMM d HH:mm:ss yyyy"

GLOBAL_WINDOW = "global"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(col) -> Column:
    """First layout that parses wins; anything else -> null (never throws)."""
    c = F.trim(_c(col).cast("string"))
    plain = F.regexp_replace(F.regexp_replace(c, ZONE, "$1"), LONG_FRACTION, "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, MONTH_FIRST, "$3-$1-$2"), YEAR_FIRST, "$1-$2-$3")
    plain = F.regexp_replace(plain, r"^(\d{4}-\d{1,2}-\d{1,2})T", "$1 ")
    parsed = [F.try_to_timestamp(plain, F.lit(fmt)) for fmt in NUMBER_FORMATS]
    stripped = F.regexp_replace(c, DAYNAME_LAYOUT, "$1 $2 $3")
    parsed.append(F.when(c.rlike(DAYNAME_LAYOUT), F.try_to_timestamp(stripped, F.lit(DAYNAME_FORMAT))))
    return F.coalesce(*parsed).cast("timestamp_ntz")


def unparsed_count(col) -> Column:
    """Aggregate: values that are there and that no layout reads."""
    c = _c(col)
    return F.count_if(c.isNotNull() & (F.trim(c.cast("string")) != "") & parse_timestamp(c).isNull())


def time_window(ts) -> Column:
    """Monday..Sunday week of a timestamp as 'YYYY-MM-DD/YYYY-MM-DD'."""
    day = F.to_date(_c(ts))
    monday = F.date_sub(day, F.weekday(day))
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def global_window() -> Column:
    """The single window used when a table has no date column."""
    return F.lit(GLOBAL_WINDOW)
