"""Apply the emotion-feature step (K3) to a stream of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventlens.operators.schema import MERGE_TEXT_COLUMNS, conform
from eventlens.plans.pipelines import emotion_features


def stream_posts(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                 glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming scan of the post files in ``folder`` (optionally only names matching ``glob``)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def stream_emotion_features(posts: DataFrame, text_candidates=MERGE_TEXT_COLUMNS) -> DataFrame:
    """Conform (text column by priority, default event columns) then K3 features, per micro-batch."""
    keep = [c for c in posts.columns if c not in ("event_id", "event_title")]
    conformed = conform(posts, text_candidates, extra=[c for c in keep if c not in text_candidates])
    return emotion_features(conformed, "raw_text")
