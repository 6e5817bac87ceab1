"""Composed pipelines (K1-K4, J12) built from the operators.

Each returns a lazy DataFrame except where an ML fit or the component loop
must run jobs; fact rows are never collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import text as tx
from eventlens.functions.timewin import global_window, time_window
from eventlens.operators import dates
from eventlens.operators.cluster import COVID_CLUSTERS, SEED, SENTIMENT_CLUSTERS, assign_events, silhouette_sampled
from eventlens.operators.graph import merge_events
from eventlens.operators.neighbours import reduce_neighbours
from eventlens.operators.rows import count_distinct, dedupe_first, dense_codes, keep_rows, union_all
from eventlens.operators.schema import (
    DATE_COLUMNS,
    MERGE_TEXT_COLUMNS,
    POST_TEXT_COLUMNS,
    conform,
    global_event_id,
    resolve_column,
    title_from_name,
)
from eventlens.operators.topics import COHERENCE_MAX_TERMS, mean_coherence, title_events, topic_coherence
from eventlens.operators.vectors import embed_text, reduce_dims, text_vectors
from eventlens.session import discard, materialize
from eventlens.sources.files import list_event_folders, read_headerless_posts, scan_event_folders, with_row_numbers, write_events

# ---------------------------------------------------------------------------
# K1: labelled folders -> events
# ---------------------------------------------------------------------------


def label_posts(
    df: DataFrame,
    group_col: str,
    text_col: str,
    order_cols: Sequence[str],
    dataset_name: str = "crisisnlp",
    groups: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """K1 on a loaded table: event id per group name (dense, sorted names; every
    group in ``groups`` counts even if it has no usable text), semantic clean,
    length filter, dedupe on clean text keeping the first row in
    (event_id, order) order.

    Returns (raw_tweet, clean_text, event_id, event_title, source, *carry).
    """
    names = groups if groups is not None else df.select(group_col)
    ids = dense_codes(names.select(F.col(group_col)), group_col, out="event_id")
    posts = (
        df.select(
            F.col(group_col),
            *[F.col(c) for c in dict.fromkeys([*order_cols, *carry])],
            F.col(text_col).cast("string").alias("raw_tweet"),
        )
        .filter(F.col("raw_tweet").isNotNull())
        .withColumn("clean_text", tx.clean_semantic("raw_tweet"))
    )
    posts = keep_rows(posts, tx.has_min_length("clean_text")).join(ids, group_col)
    kept = dedupe_first(posts, "clean_text", ["event_id", *order_cols])
    return kept.select(
        "raw_tweet",
        "clean_text",
        F.col("event_id").cast("long").alias("event_id"),
        title_from_name(F.col(group_col)).alias("event_title"),
        F.lit(dataset_name).alias("source"),
        *[F.col(c) for c in carry],
    )


def ingest_labelled(spark, root: str, dataset_name: str = "crisisnlp", glob: str = "*.tsv") -> DataFrame:
    """K1 on files: one scan of every TSV below ``root`` -> events table."""
    return ingest_with_ledger(spark, root, dataset_name, glob)[0]


def ingest_with_ledger(spark, root: str, dataset_name: str = "crisisnlp", glob: str = "*.tsv") -> tuple[DataFrame, DataFrame]:
    """K1 on files with A5's ledger: the events table, and (path, folder, reason, rows) of what the scan left out."""
    scan = scan_event_folders(spark, root, glob=glob)
    # a folder counts even if its files hold no data row, no text column or nothing at all
    folders = list_event_folders(spark, root, glob)
    return label_posts(scan.posts, "folder", "raw_tweet", ["path", "row_no"], dataset_name, groups=folders), scan.ledger


# ---------------------------------------------------------------------------
# K2: unify and merge datasets
# ---------------------------------------------------------------------------


@dataclass
class Dataset:
    name: str
    df: DataFrame
    order: Sequence[str]  # columns of any number and type giving the row order inside the dataset


def merge_datasets(datasets: Sequence[Dataset], text_candidates: Sequence[str] = MERGE_TEXT_COLUMNS) -> DataFrame:
    """K2: conform each input, tag it, union, drop null texts, keep the first
    occurrence of every raw text (earlier dataset wins, then row order).

    Returns (raw_text, event_id, event_title, dataset_name, global_event_id).
    """
    parts, order = [], ["_rank"]
    for rank, ds in enumerate(datasets):
        # first by the dataset's own order, whatever its types; between datasets the rank decides
        own = [f"_o{rank}_{i}" for i in range(len(ds.order))]
        c = conform(ds.df.select("*", *[F.col(x).alias(o) for x, o in zip(ds.order, own)]), text_candidates, extra=own)
        order += own
        parts.append(
            c.filter(F.col("raw_text").isNotNull())
            .withColumn("dataset_name", F.lit(ds.name))
            .withColumn("global_event_id", global_event_id(F.lit(ds.name), F.col("event_id")))
            .withColumn("_rank", F.lit(rank))
        )
    if any(dict(p.dtypes)["event_id"] == "string" for p in parts):
        parts = [p.withColumn("event_id", F.col("event_id").cast("string")) for p in parts]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    kept = dedupe_first(union, "raw_text", order)
    return kept.select("raw_text", "event_id", "event_title", "dataset_name", "global_event_id")


# ---------------------------------------------------------------------------
# K3: emotion-preserving features
# ---------------------------------------------------------------------------

FEATURE_COLUMNS = (
    "emoji_count", "exclamation_count", "question_count", "hashtag_count",
    "uppercase_word_count", "tweet_length", "word_count",
)


def emotion_features(df: DataFrame, raw_col: str = "raw_text", drop_empty: bool = True) -> DataFrame:
    """K3: display-clean text plus seven counts, then drop empty texts."""
    clean = tx.clean_display(F.col(raw_col))
    out = df.withColumn("clean_text", clean).select(
        *df.columns,
        "clean_text",
        tx.emoji_count("clean_text").alias("emoji_count"),
        tx.exclamation_count("clean_text").alias("exclamation_count"),
        tx.question_count("clean_text").alias("question_count"),
        tx.hashtag_count(raw_col).alias("hashtag_count"),
        tx.uppercase_word_count(raw_col).alias("uppercase_word_count"),
        tx.tweet_length("clean_text").alias("tweet_length"),
        tx.word_count("clean_text").alias("word_count"),
    )
    if drop_empty:
        out = keep_rows(out, F.trim(F.col("clean_text")) != "")
    return out


# ---------------------------------------------------------------------------
# K4: weekly volume
# ---------------------------------------------------------------------------


def weekly_counts(df: DataFrame, ts_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """K4: rows per (time_window, keys); a text column is read by the layout it votes for, unread rows are dropped (``dates.rejected`` gives them)."""
    if dates.is_text(df, ts_col):
        stamped = dates.with_timestamp(df, ts_col, dates.column_layout(df, ts_col))
    else:
        stamped = df.withColumn("_ts", F.col(ts_col))
    w = keep_rows(stamped.select(*keys, "_ts"), F.col("_ts").isNotNull())
    return w.groupBy(time_window("_ts").alias("time_window"), *keys).agg(F.count(F.lit(1)).alias("num_posts"))


# ---------------------------------------------------------------------------
# Event discovery
# ---------------------------------------------------------------------------


@dataclass
class DiscoveryConfig:
    clusters: int = COVID_CLUSTERS
    seed: int = SEED
    embed_dim: int = 256
    reduced_dim: int = 10
    sample_cap: int | None = None  # an exact-size seeded sample of the posts; None: all of them
    with_emotion: bool = True
    encoder: Callable[[], Callable] | None = None  # see vectors.embed_text; None: hashed TF-IDF
    neighbour_layout: bool = False  # reduce by the neighbour graph in place of PCA


def prepare_posts(
    df: DataFrame,
    order_col: str,
    text_candidates: Sequence[str] = POST_TEXT_COLUMNS,
    date_candidates: Sequence[str] = DATE_COLUMNS,
    with_emotion: bool = True,
    carry: Sequence[str] = (),
    spent: list | None = None,
) -> DataFrame:
    """Cleaning stages of discovery: resolve columns, drop null text, clean,
    keep clean text longer than 10, dedupe on clean text (first by order),
    then parse dates (dropping unparsable) or use the single 'global' window.
    Dedupe runs before date parsing, as in the reference. A text date column is
    read by one layout, the one that most of its rows vote for. ``spent``: as in ``dedupe_first``.
    """
    text_col = resolve_column(df, text_candidates)
    date_col = resolve_column(df, date_candidates, required=False)
    cols = [F.col(order_col), F.col(text_col).cast("string").alias("raw_text")]
    cols += [F.col(c) for c in carry if c not in (order_col, text_col, date_col)]
    if date_col:
        cols.append(F.col(date_col).alias("_date"))
    posts = df.select(*cols).filter(F.col("raw_text").isNotNull()).withColumn("clean_text", tx.clean_semantic("raw_text"))
    if with_emotion:
        posts = posts.withColumn("emotion_text", tx.clean_emotion("raw_text"))
    posts = keep_rows(posts, tx.has_min_length("clean_text"))
    posts = dedupe_first(posts, "clean_text", [order_col], spent=spent)
    if date_col:
        if dates.is_text(posts, "_date"):
            posts = dates.with_timestamp(posts, "_date", dates.column_layout(df, date_col))
        else:
            posts = posts.withColumn("_ts", F.col("_date").cast("timestamp_ntz"))
        posts = keep_rows(posts, F.col("_ts").isNotNull())
        posts = posts.withColumn("time_window", time_window("_ts")).drop("_date")
        posts = posts.withColumn("date", F.date_format("_ts", "yyyy-MM-dd HH:mm:ss")).drop("_ts")
    else:
        posts = posts.withColumn("time_window", global_window())
    return posts


TITLE_BYTES = 64  # of an event's id and title, about
BROADCAST_BYTES = 32 << 20


class Discovery:
    """What a discovery finds: the events, with scores and statistics that are computed when asked for.

    ``facts`` is the written table of posts with their event_id; ``labelled`` the written first clusters.
    """

    def __init__(self, facts: DataFrame, order_col: str, labelled: DataFrame, label_col: str, vec_col: str, tables: Sequence[tuple[str, DataFrame]] = ()):
        self.facts, self.order_col, self.labelled, self.label_col, self.vec_col = facts, order_col, labelled, label_col, vec_col
        self.tables = [*tables, ("clustered", labelled), ("events", facts)]

    @cached_property
    def titles(self) -> DataFrame:
        """event_id, num_tweets, event_title: a row per event, written."""
        return materialize(title_events(self.facts, "event_id", "clean_text"), "event-titles")

    @cached_property
    def events(self) -> DataFrame:
        """A row per kept post: order column, texts, carried columns, event_id, event_title, time_window.

        Titles are sent to all tasks if their counted number allows it, so the posts are not shuffled by a hot event.
        """
        named = self.titles.select("event_id", "event_title")
        if named.count() * TITLE_BYTES <= BROADCAST_BYTES:
            named = F.broadcast(named)
        cols = [c for c in self.facts.columns if c not in ("event_id", "time_window")]
        return self.facts.join(named, "event_id").select(*cols, "event_id", "event_title", "time_window")

    @cached_property
    def coherence(self) -> DataFrame:
        """event_id, num_tweets, coherence, for events of ten posts or more."""
        return topic_coherence(self.facts, "event_id", self.order_col, "clean_text", max_terms=COHERENCE_MAX_TERMS)

    @cached_property
    def summary(self) -> DataFrame:
        """One row: total_events, total_tweets, time_windows, mean_coherence, scored_events."""
        mean = mean_coherence(self.coherence)
        totals = self.facts.agg(count_distinct("event_id", "total_events"), F.count(F.lit(1)).alias("total_tweets"), count_distinct("time_window", "time_windows"))
        return totals.select("*", mean.select("mean_coherence").scalar().alias("mean_coherence"), mean.select("scored_events").scalar().alias("scored_events"))

    @cached_property
    def score(self) -> DataFrame:
        """One row: Euclidean silhouette of the first clusters, error_bound, num_rows, sampled."""
        return silhouette_sampled(self.labelled, self.order_col, self.vec_col, self.label_col)

    @cached_property
    def stages(self) -> DataFrame:
        """(stage, num_rows) in the order of the stages, counted from their tables."""
        rows = [t.agg(F.lit(i).alias("n"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("num_rows")) for i, (name, t) in enumerate(self.tables)]
        return union_all(rows).orderBy("n").select("stage", "num_rows")


def discover_from_labels(
    posts: DataFrame, labelled: DataFrame, order_col: str, label_col: str, vec_col: str, score_col: str | None = None, tables: Sequence[tuple[str, DataFrame]] = (),
) -> Discovery:
    """J12 from given first clusters: merge -> events, with titles, coherence, statistics.

    ``posts`` has order_col, clean_text and time_window, ``labelled`` order_col, a label and a vector (``score_col``: the
    vectors that the silhouette is taken of, by default the same). The events are written once.
    """
    merged = merge_events(labelled.select(order_col, F.col(vec_col).alias("_v"), F.col(label_col).alias("_label")), "_label", "_v")
    facts = materialize(posts.join(merged.select(order_col, "event_id"), order_col), "events", "zstd")
    return Discovery(facts, order_col, labelled, label_col, score_col or vec_col, tables)


def discover(df: DataFrame, order_col: str, cfg: DiscoveryConfig | None = None, carry: Sequence[str] = ()) -> Discovery:
    """Posts -> cleaned/deduped -> vectors -> reduce -> k-means -> ``discover_from_labels``, with score and stage counts.

    Posts, vectors and labels are tables written once; every later step reads them. What no later step reads is removed.
    """
    from eventlens.operators.rows import sample_n

    cfg, spent = cfg or DiscoveryConfig(), []
    posts = materialize(prepare_posts(df, order_col, with_emotion=cfg.with_emotion, carry=carry, spent=spent), "posts", "zstd")
    for table in spent:
        discard(table)
    kept = sample_n(posts, cfg.sample_cap, cfg.seed, order_col) if cfg.sample_cap else posts
    texts = kept.select(order_col, "clean_text")
    if cfg.encoder is None:
        feats = text_vectors(texts, "clean_text", cfg.embed_dim, keep=[order_col])
    else:
        feats = embed_text(texts, "clean_text", cfg.encoder)
    feats = materialize(feats.select(order_col, "embedding"), "post-vectors")
    if cfg.neighbour_layout:
        reduced = feats.join(reduce_neighbours(feats, order_col, "embedding", cfg.reduced_dim), order_col)
    else:
        reduced = reduce_dims(feats, "embedding", cfg.reduced_dim)
    reduced = materialize(reduced, "post-reduced")
    discard(feats)
    labelled = materialize(assign_events(reduced, "reduced", cfg.clusters, cfg.seed, out="_cluster", key=order_col), "post-clusters")
    discard(reduced)
    return discover_from_labels(kept, labelled, order_col, "_cluster", "embedding", "reduced", [("read", df), ("clean", posts), ("sampled", kept)])


def discover_events(
    df: DataFrame, order_col: str, cfg: DiscoveryConfig | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """The events of ``discover``, one row per kept post."""
    return discover(df, order_col, cfg, carry).events


SENTIMENT_CONFIG = DiscoveryConfig(clusters=SENTIMENT_CLUSTERS, with_emotion=False)


def discover_sentiment(spark, path: str, cfg: DiscoveryConfig = SENTIMENT_CONFIG) -> DataFrame:
    """J12, sentiment variant: headerless Latin-1 CSV (A2), early projection of
    (text, date, sentiment), dedupe on clean text in file order, date parse,
    k=200, no emotion text; a seeded exact-size sample only if ``cfg`` asks for one.
    Returns (row_no, raw_text, clean_text, sentiment, date, event_id, event_title, time_window).
    """
    posts = with_row_numbers(read_headerless_posts(spark, path).select("text", "date", "sentiment"), "row_no")
    return discover_events(posts, "row_no", cfg, carry=["sentiment"])


# The export projections of the two discovery variants.
COVID_EXPORT_COLUMNS = ("raw_text", "clean_text", "emotion_text", "event_id", "event_title", "time_window")
SENTIMENT_EXPORT_COLUMNS = ("raw_text", "date", "sentiment", "clean_text", "time_window", "event_id", "event_title")


def export_events(df: DataFrame, path: str, columns: Sequence[str] = COVID_EXPORT_COLUMNS, fmt: str = "parquet") -> None:
    """Write the fixed projection of a discovery result (whole table, one write job)."""
    write_events(df.select(*columns), path, fmt=fmt)
