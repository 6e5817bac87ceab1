"""Schema resolution and conforming (B1-B9, H1, K2 building blocks).

Column resolution is driver-side logic over ``df.columns``; it reads no data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidate column names, in priority order (names are case-sensitive).
MERGE_TEXT_COLUMNS = ("raw_text", "text", "raw_tweet", "clean_text")
TSV_TEXT_COLUMNS = ("tweet", "text", "Tweet", "tweet_text", "message")
POST_TEXT_COLUMNS = ("text", "tweet", "content", "sentence")
DATE_COLUMNS = ("date", "created_at", "timestamp")

# Defaults for a missing event column.
DEFAULT_EVENT_ID = -1
DEFAULT_EVENT_TITLE = "Unknown Event"


class MissingColumnError(ValueError):
    pass


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """B1/B2: first candidate present in the schema (exact, case-sensitive match)."""
    present = set(df.columns)
    for name in candidates:
        if name in present:
            return name
    if required:
        raise MissingColumnError(f"none of {list(candidates)} in {df.columns}")
    return None


def conform(
    df: DataFrame,
    text_candidates: Sequence[str] = MERGE_TEXT_COLUMNS,
    default_event_id: int = DEFAULT_EVENT_ID,
    default_event_title: str = DEFAULT_EVENT_TITLE,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Project to (raw_text, event_id, event_title); defaults fill missing *columns* only."""
    text_col = resolve_column(df, text_candidates)
    # a text id is kept as it is; a numeric one (a float where ids have gaps, too) is a long
    event_id = F.lit(default_event_id).cast("long")
    if "event_id" in df.columns:
        event_id = F.col("event_id") if dict(df.dtypes)["event_id"] == "string" else F.col("event_id").cast("long")
    event_title = (
        F.col("event_title").cast("string") if "event_title" in df.columns else F.lit(default_event_title)
    )
    return df.select(
        F.col(text_col).cast("string").alias("raw_text"),
        event_id.alias("event_id"),
        event_title.alias("event_title"),
        *[F.col(c) for c in extra],
    )


def global_event_id(dataset_name, event_id) -> Column:
    """B7: '<dataset>_<event_id>': a number printed as an integer, a text id as it is."""
    ds = F.col(dataset_name) if isinstance(dataset_name, str) else dataset_name
    eid = F.col(event_id) if isinstance(event_id, str) else event_id
    return F.concat(ds.cast("string"), F.lit("_"), eid.cast("string"))


def title_from_name(name) -> Column:
    """Folder name to title ('_' -> ' ')."""
    c = F.col(name) if isinstance(name, str) else name
    return F.replace(c, F.lit("_"), F.lit(" "))
