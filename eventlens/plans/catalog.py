"""Query catalogue: one Spark DataFrame builder per operator/query of the survey.

Every builder takes (spark, sf_dir) and reads the driver tables (or data
Spark derives from them) in full. Output columns are aliased to match the
DuckDB twins in ``eventlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions import text as tx
from eventlens.functions.encoding import is_encoding_suspect, repair_encoding, repair_fully, to_cp1252_mojibake, to_mojibake
from eventlens.functions.timewin import parse_timestamp, time_window
from eventlens.operators import cluster, dates, graph, neighbours, rows, topics, vectors
from eventlens.operators.schema import conform, resolve_column, title_from_name, DATE_COLUMNS
from eventlens.plans import pipelines as pl
from eventlens.session import shared_scratch
from eventlens.sources import files
from eventlens.sources.tables import read_table

# Fixed values used by the catalogue queries.
DECORATION_PREFIX = "RT @u"
DECORATION_MIDDLE = ": http://t.co/x "
DECORATION_SUFFIX = " #Tag # 😔😔!!!!!!???? 🚀 🇫🇷❤"
SAMPLE_SIZE = 100
SAMPLE_SEED = 42
TFIDF_DIM = 256
VEC_DECIMALS = 9
COHERENCE_DECIMALS = 12


# Row keys of the driver tables; CPU-heavy text tables are spread on them when
# the scan has fewer partitions than the session's parallelism.
ROW_KEYS = {
    "documents": ("doc_id",),
    "conversations": ("conv_id", "turn"),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", *ROW_KEYS.get(name, ()))


def decorated_documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.concat(
        F.lit(DECORATION_PREFIX), F.col("doc_id").cast("string"), F.lit(DECORATION_MIDDLE), F.col("text"),
        F.lit(DECORATION_SUFFIX),
    )
    return d.select("doc_id", raw.alias("raw_text"))


def clean_posts(spark, sf_dir) -> DataFrame:
    """documents -> (doc_id, source, lang, raw_text, clean_text), clean text > 10 chars, deduped (first doc_id)."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    posts = d.select("doc_id", "source", "lang", F.col("text").alias("raw_text")).withColumn(
        "clean_text", tx.clean_semantic("raw_text")
    )
    return rows.dedupe_first(rows.keep_rows(posts, tx.has_min_length("clean_text")), "clean_text", ["doc_id"])


# --- flagship -----------------------------------------------------------------

def q_source_titles(spark, sf_dir):
    posts = clean_posts(spark, sf_dir)
    return topics.title_events(posts, "source", "clean_text")


# --- scalar cleaners ------------------------------------------------------------

def _on_decorated(fn) -> Callable:
    def q(spark, sf_dir):
        d = decorated_documents(spark, sf_dir)
        return d.select("doc_id", fn(F.col("raw_text")).alias("clean_text"))

    return q


q_clean_semantic = _on_decorated(tx.clean_semantic)
q_clean_emotion = _on_decorated(tx.clean_emotion)
q_clean_display = _on_decorated(tx.clean_display)
q_strip_urls = _on_decorated(tx.strip_urls)
q_strip_mentions = _on_decorated(tx.strip_mentions)
q_strip_rt = _on_decorated(tx.strip_rt)
q_strip_lead_punct = _on_decorated(tx.strip_lead_punct)
q_unhash = _on_decorated(tx.unhash)
q_cap_bang = _on_decorated(tx.cap_bang)
q_cap_question = _on_decorated(tx.cap_question)
q_cap_mixed = _on_decorated(tx.cap_mixed)
q_squash_ws = _on_decorated(tx.squash_ws)


def q_repair_encoding(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", repair_encoding(to_mojibake(F.col("text"))).alias("text"))


def q_repair_cp1252(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", repair_encoding(to_cp1252_mojibake(F.col("text"))).alias("text"))


# Good characters beyond Latin-1 around damaged text.
MIXED_HEAD, MIXED_MIDDLE, MIXED_TAIL = "😔 привет “", "” 東京 ", " 🚀 naïve €"


def _mixed(first, second):
    return F.concat(F.lit(MIXED_HEAD), first, F.lit(MIXED_MIDDLE), second, F.lit(MIXED_TAIL))


def q_repair_mixed(spark, sf_dir):
    """I3 by runs, to a fixed point: texts double-encoded once (CP1252) and twice (Latin-1) between good characters."""
    text = F.col("text")
    mixed = _mixed(to_cp1252_mojibake(text), to_mojibake(to_mojibake(text)))
    return table(spark, sf_dir, "documents").select("doc_id", repair_fully(mixed).alias("text"))


def q_display_mixed(spark, sf_dir):
    """I13 on damaged posts with emoji (even ids), and on wholly damaged posts without any (odd ids)."""
    text = F.col("text")
    raw = F.when(F.col("doc_id") % 2 == 0, _mixed(text, to_cp1252_mojibake(text))).otherwise(to_mojibake(F.concat(F.lit("RT @ö: «"), text, F.lit("» !!!!!"))))
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_display(raw).alias("clean_text"))


def q_emotion_features(spark, sf_dir):
    return pl.emotion_features(decorated_documents(spark, sf_dir), "raw_text").drop("raw_text")


def q_emotion_report(spark, sf_dir):
    """C3 count: rows before and after dropping empty display-clean texts."""
    d = decorated_documents(spark, sf_dir).select("doc_id", "raw_text")
    # texts that cleaning empties come as rows of their own
    emptied = d.where(F.col("doc_id") % 5 == 0).select("doc_id", F.lit("@only_a_mention").alias("raw_text"))
    clean = tx.clean_display(F.col("raw_text"))
    return rows.union_all([d, emptied]).agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(F.trim(clean) != "").cast("long").alias("rows_after"),
        F.count_if(F.trim(clean) == "").cast("long").alias("removed"),
    )


def q_encoding_audit(spark, sf_dir):
    """C4 count: texts still holding suspect characters after display cleaning with one level of repair."""
    d = table(spark, sf_dir, "documents")
    cleaned = tx.clean_display(to_mojibake(to_mojibake(F.col("text"))), once=True)
    return d.agg(F.count_if(is_encoding_suspect(cleaned)).cast("long").alias("suspects"), F.count(F.lit(1)).alias("rows"))


def q_encoding_suspects(spark, sf_dir):
    # Double-encoded text: one repair pass leaves single mojibake, which the audit flags.
    d = table(spark, sf_dir, "documents")
    twice = to_mojibake(to_mojibake(F.col("text")))
    cleaned = d.select("doc_id", tx.clean_display(twice, once=True).alias("clean_text"))
    return rows.keep_rows(cleaned, is_encoding_suspect("clean_text"))


def q_null_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 7
    # missing-value tokens come as rows of their own, beside every real text
    token = F.when(k == 0, F.lit("NA")).when(k == 1, F.lit("null")).otherwise(F.lit(""))
    missing = d.where(k < 3).select((-1 - F.col("doc_id")).alias("doc_id"), token.alias("text"))
    t = rows.union_all([d, missing]).select("doc_id", files.na_to_null("text").alias("text"))
    return t.dropna(subset=["text"])


# --- paths and schema -------------------------------------------------------------

def q_event_name_from_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.event_name_from_path("url").alias("event_name"))


def q_title_from_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.concat_ws("_", "source", "lang")
    return d.select("doc_id", title_from_name(name).alias("event_title"))


def q_resolve_conform(spark, sf_dir):
    parts = []
    for name in ("documents", "benchmark"):
        parts.append(conform(table(spark, sf_dir, name)).withColumn("dataset_name", F.lit(name)))
    return rows.union_all(parts)


def _merge_inputs(spark, sf_dir) -> list:
    d = table(spark, sf_dir, "documents")
    crisis = _label_posts_with_order(d)
    conv = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "event_id")
    bench = table(spark, sf_dir, "benchmark")
    return [
        pl.Dataset("crisisnlp", crisis, ["event_id", "doc_id"]),
        pl.Dataset("corona", conv, ["event_id", "turn"]),
        pl.Dataset("sentiment140", bench, ["item_id"]),
    ]


def _label_posts_with_order(d: DataFrame) -> DataFrame:
    return pl.label_posts(d, "source", "text", ["doc_id"], carry=["doc_id"])


def q_merge_datasets(spark, sf_dir):
    return pl.merge_datasets(_merge_inputs(spark, sf_dir))


def q_label_posts(spark, sf_dir):
    return pl.label_posts(table(spark, sf_dir, "documents"), "source", "text", ["doc_id"])


def q_dedupe_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    posts = d.select("doc_id", tx.clean_semantic("text").alias("clean_text"))
    return rows.dedupe_first(posts, "clean_text", ["doc_id"])


# --- counts, top-k, sampling --------------------------------------------------------

def q_stage_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = tx.clean_semantic("text")
    long_ = tx.has_min_length(c) & F.col("text").isNotNull()
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("text").alias("n_text"),
        F.count_if(long_).cast("long").alias("n_long"),
        # two independent hashes in place of the text: what is expanded for the distinct counts is narrow
        F.countDistinct(F.when(long_, F.xxhash64(F.lit(1), c)), F.when(long_, F.xxhash64(F.lit(2), c))).alias("n_unique"),
        F.countDistinct("source").alias("n_sources"),
    )


def q_event_stats(spark, sf_dir):
    return rows.event_stats(q_label_posts(spark, sf_dir), "event_id")


def q_top_events(spark, sf_dir):
    return rows.top_groups(q_label_posts(spark, sf_dir), "event_id", 10)


def q_peek_rows(spark, sf_dir):
    feats = pl.emotion_features(decorated_documents(spark, sf_dir), "raw_text")
    return rows.peek_rows(feats.select("doc_id", "raw_text", "clean_text"), "doc_id", 5)


def q_sample_n(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.sample_n(d, SAMPLE_SIZE, SAMPLE_SEED, "doc_id")


# --- time -------------------------------------------------------------------------------

def _date_strings(spark, sf_dir) -> DataFrame:
    """Every event's time in one of eight layouts, and rows of garbage under negative ids."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 8
    f = lambda layout: F.date_format("ts", layout)
    s = (
        F.when(k == 0, f("yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.concat(f("EEE MMM dd HH:mm:ss"), F.lit(" PDT "), f("yyyy")))
        .when(k == 2, f("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 3, f("yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(k == 4, f("yyyy/MM/dd"))
        .when(k == 5, f("MM/dd/yyyy"))
        .when(k == 6, f("yyyy-MM-dd HH:mm"))
        .otherwise(F.concat(f("EEE MMM d HH:mm:ss"), F.lit(" +0000 "), f("yyyy")))
    )
    garbage = e.where(k == 2).select((-1 - F.col("event_id")).alias("event_id"), F.concat(F.lit("week of "), F.col("event_id").cast("string")).alias("date"))
    return rows.union_all([e.select("event_id", s.alias("date")), garbage])


def q_parse_dates(spark, sf_dir):
    d = _date_strings(spark, sf_dir).withColumn("_ts", parse_timestamp("date"))
    d = rows.keep_rows(d, F.col("_ts").isNotNull())
    return d.select(
        "event_id",
        F.date_format("_ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        time_window("_ts").alias("time_window"),
    )


# One text column per layout, and what it keeps of the time.
DATE_COLUMN_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss", "second"), ("yyyy/MM/dd HH:mm", "minute"), ("yyyy.MM.dd", "day"), ("yyyyMMdd", "day"),
    ("MM/dd/yyyy hh:mm a", "minute"), ("dd/MM/yyyy HH:mm:ss", "second"), ("dd.MM.yyyy HH:mm", "minute"), ("MM-dd-yyyy", "day"),
    ("d MMM yyyy", "day"), ("MMMM d, yyyy", "day"), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "second"),
    ("EEE MMM dd HH:mm:ss '+0000' yyyy", "second"), ("yyyyMMdd'T'HHmmss", "second"), ("yyyy-MM", "month"),
)


def q_date_layouts(spark, sf_dir):
    """I20 by column: every event's time as fourteen text columns, each read by the layout that its column votes for; a row per value."""
    e = table(spark, sf_dir, "events")
    names = [f"d{i}" for i in range(len(DATE_COLUMN_FORMATS))]
    df = e.select("event_id", *[F.date_format("ts", layout).alias(c) for c, (layout, _) in zip(names, DATE_COLUMN_FORMATS)])
    votes = dates.vote(df, names)
    read = [
        dates.with_timestamp(df.select("event_id", F.lit(i).alias("column_no"), c), c, votes[c].layout).select(
            "event_id", "column_no", F.date_format("_ts", "yyyy-MM-dd HH:mm:ss").alias("parsed"), time_window("_ts").alias("time_window")
        )
        for i, c in enumerate(names)
    ]
    return rows.union_all(read)


def q_date_rejects(spark, sf_dir):
    """I20's unread rows: day-first dates, with rows of other layouts, impossible days and plain words beside them."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("date"))
    k = F.col("event_id") % 4
    odd = F.when(k == 0, F.lit("31/02/2020")).when(k == 1, F.lit("2020.01.31")).when(k == 2, F.concat(F.lit("week "), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    df = rows.union_all([e, e.select((-1 - F.col("event_id")).alias("event_id"), odd.alias("date"))])
    return dates.rejected(df, "date", dates.column_layout(df, "date"))


def q_time_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", time_window("ts").alias("time_window"))


def q_weekly_counts(spark, sf_dir):
    return pl.weekly_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


def q_weekly_orders(spark, sf_dir):
    return pl.weekly_counts(table(spark, sf_dir, "orders"), "o_orderdate", ["o_orderstatus"])


def q_no_date_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    assert resolve_column(d, DATE_COLUMNS, required=False) is None
    posts = pl.prepare_posts(d, "doc_id", with_emotion=False)
    return posts.select("doc_id", "time_window")


# --- groups -------------------------------------------------------------------------------

def _groups(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("/", "source", "lang").alias("grp"))


def q_filter_small_groups(spark, sf_dir):
    return rows.filter_small_groups(_groups(spark, sf_dir), "grp")


def q_dense_codes(spark, sf_dir):
    kept = rows.filter_small_groups(_groups(spark, sf_dir), "grp")
    return rows.dense_codes(kept, "grp", out="code")


# --- vectors and merging --------------------------------------------------------------------

def _graph(spark, sf_dir):
    """(codes, centroids, edges) of the embeddings' labels, each written once to the shared folder."""
    return graph.cluster_graph(table(spark, sf_dir, "embeddings"), "label", "embedding")


def q_centroids(spark, sf_dir):
    _, c, _ = _graph(spark, sf_dir)
    z = c.select(F.col("_code").alias("cid"), F.posexplode(F.arrays_zip("mean", "unit")).alias("dim", "v"))
    return z.select(
        "cid", F.col("dim").cast("long").alias("dim"),
        F.round("v.mean", VEC_DECIMALS).alias("mean"), F.round("v.unit", VEC_DECIMALS).alias("unit"),
    )


def q_knn_edges(spark, sf_dir):
    _, _, e = _graph(spark, sf_dir)
    return e.select("src", "dst", "sim", F.col("rank").cast("long").alias("rank"))


def q_adaptive_threshold(spark, sf_dir):
    _, _, e = _graph(spark, sf_dir)
    return graph.adaptive_threshold(e)


def _components(spark, sf_dir) -> DataFrame:
    _, cent, edges = _graph(spark, sf_dir)
    strong = graph.strong_edges(edges)
    return graph.connected_components(cent.select(F.col("_code").alias("id")), strong, "id")


def q_connected_components(spark, sf_dir):
    return _components(spark, sf_dir).select(F.col("id").alias("cid"), "component")


def q_renumber_events(spark, sf_dir):
    return graph.renumber_components(_components(spark, sf_dir), "id").select(F.col("id").alias("cid"), "event_id")


def q_merge_events(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return graph.merge_events(e, "label", "embedding").select("vec_id", "label", "event_id")


# --- topics -----------------------------------------------------------------------------------

def q_term_counts(spark, sf_dir):
    return topics.term_counts(clean_posts(spark, sf_dir), "source", "clean_text")


def q_title_events(spark, sf_dir):
    merged = q_merge_events(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "event_id")
    posts = clean_posts(spark, sf_dir).join(merged, "doc_id")
    return topics.title_events(posts, "event_id", "clean_text")


def _coherence(spark, sf_dir) -> DataFrame:
    return topics.topic_coherence(
        clean_posts(spark, sf_dir), "source", "doc_id", "clean_text", max_terms=topics.COHERENCE_MAX_TERMS
    )


def q_topic_coherence(spark, sf_dir):
    c = _coherence(spark, sf_dir)
    return c.select("source", "num_tweets", F.round("coherence", COHERENCE_DECIMALS).alias("coherence"))


def q_mean_coherence(spark, sf_dir):
    m = topics.mean_coherence(_coherence(spark, sf_dir))
    return m.select(F.round("mean_coherence", COHERENCE_DECIMALS).alias("mean_coherence"), "scored_events")


def q_hashed_tfidf(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.clean_semantic("text").alias("clean_text"))
    t = vectors.hashed_tfidf(d, "doc_id", "clean_text", TFIDF_DIM)
    return t.select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("weight", VEC_DECIMALS).alias("weight"))


def q_silhouette_sq(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return cluster.silhouette_table(e, "embedding", "label", "squaredEuclidean").select("silhouette")


def q_silhouette_exact(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return cluster.silhouette_exact(e, "vec_id", "embedding", "label")


# --- ML stages (rows-only checks) -----------------------------------------------------------

def q_reduce_dims(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.reduce_dims(e.select("vec_id", "embedding"), "embedding", 10).select("vec_id", "reduced")


def q_reduce_neighbours(spark, sf_dir):
    """J2 with neighbourhoods kept: spectral layout on an approximate k-NN graph."""
    return neighbours.reduce_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


def q_knn_graph_check(spark, sf_dir):
    """The graph under J2 as a property: a list per vector, no row its own neighbour, recall of 0.9 against brute force."""
    e = table(spark, sf_dir, "embeddings")
    g = neighbours.knn_graph(e, "vec_id", "embedding")
    recall = neighbours.graph_recall(e, "vec_id", "embedding", g, every=10)
    lists = g.agg(F.count(F.lit(1)).alias("num_rows"), F.count_if(F.array_contains("dsts", F.col("src"))).cast("long").alias("own"))
    return lists.select("num_rows", "own", (recall.select("recall").scalar() >= 0.9).alias("recall_reached"))


def q_reduce_neighbours_check(spark, sf_dir):
    """J2 as a property: ten components for every vector, and neighbourhoods truer than PCA's."""
    e = table(spark, sf_dir, "embeddings")
    kept = neighbours.reduce_neighbours(e, "vec_id", "embedding", 10)
    near = e.select("vec_id", "embedding").join(kept, "vec_id")
    ours, pca = (neighbours.trustworthiness(x, "vec_id", "embedding", "reduced", every=1) for x in (near, vectors.reduce_dims(e, "embedding", 10)))
    width = F.size("reduced").cast("long")
    sizes = kept.agg(F.count(F.lit(1)).alias("num_rows"), F.min(width).alias("min_width"), F.max(width).alias("max_width"))
    truer = ours.select("trust").scalar() > pca.select("trust").scalar()
    return sizes.withColumn("truer_than_pca", truer)


def q_assign_events(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    r = vectors.reduce_dims(e.select("vec_id", "embedding"), "embedding", 10)
    return cluster.assign_events(r, "reduced", 10, cluster.SEED).select("vec_id", "event_id")


def q_reduce_dims_check(spark, sf_dir):
    """J2 as a property: every vector has ten components, and their variances do not rise."""
    r = q_reduce_dims(spark, sf_dir)
    parts = [F.variance(F.col("reduced")[i]).alias(f"v{i}") for i in range(10)]
    width = F.size("reduced")
    stats = r.agg(F.count(F.lit(1)).alias("num_rows"), F.min(width).cast("long").alias("min_width"), F.max(width).cast("long").alias("max_width"), *parts)
    falling = [F.col(f"v{i}") >= F.col(f"v{i + 1}") - 1e-12 for i in range(9)]
    return stats.select("num_rows", "min_width", "max_width", reduce(lambda a, b: a & b, falling).alias("falling"))


def q_assign_events_check(spark, sf_dir):
    """J3 as a property: rows that are not with their nearest centre, and labels out of range."""
    e = table(spark, sf_dir, "embeddings")
    r = vectors.reduce_dims(e.select("vec_id", "embedding"), "embedding", 10)
    labelled, centres = cluster.assign_events(r, "reduced", 10, cluster.SEED, with_centers=True)
    dist = lambda c: F.aggregate(F.zip_with("reduced", F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    far = F.array(*[dist(c) for c in centres])
    d = labelled.select("event_id", far.alias("far"))
    wrong = F.col("far")[F.col("event_id").cast("int")] > F.array_min("far") + 1e-9
    return d.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.count_if(wrong).cast("long").alias("not_nearest"),
        F.count_if(~F.col("event_id").between(0, 9)).cast("long").alias("out_of_range"),
    )


def q_assign_events_layout(spark, sf_dir):
    """J3 as a property: labels under three layouts, rows whose label is not the same in all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    labels = [cluster.assign_events(e.repartition(n), "embedding", 10, cluster.SEED, out=f"label{n}").select("vec_id", f"label{n}") for n in (1, 8, 200)]
    all_ = labels[0].join(labels[1], "vec_id").join(labels[2], "vec_id")
    return all_.agg(F.count(F.lit(1)).alias("num_rows"), F.count_if((F.col("label1") != F.col("label8")) | (F.col("label1") != F.col("label200"))).cast("long").alias("differing"))


def q_merge_then_enrich(spark, sf_dir):
    """K2 into K3: the merged table with display text and emotion features."""
    return pl.emotion_features(q_merge_datasets(spark, sf_dir), "raw_text")


def q_export_events(spark, sf_dir):
    """The fixed projection written and read back."""
    d = table(spark, sf_dir, "documents").select(
        F.col("text").alias("raw_text"), tx.clean_semantic("text").alias("clean_text"), tx.clean_emotion("text").alias("emotion_text"),
        F.col("doc_id").alias("event_id"), F.col("source").alias("event_title"), F.lit("global").alias("time_window"), "lang", "n_chars",
    )
    out = shared_scratch(spark, "export")
    pl.export_events(d, out)
    return spark.read.parquet(out)


def q_discover_events(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return pl.discover_events(d, "doc_id", pl.DiscoveryConfig())


def _from_labels(spark, sf_dir) -> pl.Discovery:
    """Everything of J12 after k-means: the documents' posts, with the embeddings' labels as first clusters."""
    posts = pl.prepare_posts(table(spark, sf_dir, "documents"), "doc_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    return pl.discover_from_labels(posts, e, "doc_id", "label", "embedding")


def q_discover_from_labels(spark, sf_dir):
    return _from_labels(spark, sf_dir).events.select(*[c for c in pl.COVID_EXPORT_COLUMNS if c != "raw_text"], "doc_id")


def q_discover_from_labels_summary(spark, sf_dir):
    """J12's statistics: totals, mean coherence, and the silhouette of the first clusters, which must lie within its error bound of the exact one."""
    d = _from_labels(spark, sf_dir)
    exact = cluster.silhouette_exact(d.labelled, "doc_id", "embedding", "label").scalar()
    near = d.score.select((F.abs(F.col("silhouette") - exact) <= F.col("error_bound") + 1e-6).alias("x")).scalar()
    return d.summary.withColumns({"mean_coherence": F.round("mean_coherence", COHERENCE_DECIMALS), "silhouette_within_bound": near})


def q_discover_from_labels_coherence(spark, sf_dir):
    c = _from_labels(spark, sf_dir).coherence
    return c.select("event_id", "num_tweets", F.round("coherence", COHERENCE_DECIMALS).alias("coherence"))


def q_discover_stages(spark, sf_dir):
    """J12's stage counts; the last stage depends on k-means and stays out."""
    return pl.discover(table(spark, sf_dir, "documents"), "doc_id").stages.where("stage <> 'events'")


def q_discover_encoded(spark, sf_dir):
    """J12 with a caller's encoder (a projection trained on the documents) and the neighbour-preserving layout."""
    d = table(spark, sf_dir, "documents")
    encoder = vectors.train_projection(d.select(tx.clean_semantic("text").alias("clean_text")), "clean_text", width=32, dim=256)
    return pl.discover_events(d, "doc_id", pl.DiscoveryConfig(encoder=encoder, neighbour_layout=True))


# --- files (rows-only checks) -------------------------------------------------------------------

def q_csv_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = shared_scratch(spark, "csv")
    files.write_events(d, out, fmt="csv")
    back = files.read_posts_csv(spark, out)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


def _typed_csv(spark, sf_dir) -> DataFrame:
    """Events written as CSV text with missing-value tokens, and read back with inferred types."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    text = e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.when(k % 5 == 0, F.lit("NA")).otherwise(F.col("user_id").cast("string")).alias("user_id"), "value",
        F.when(k % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("even"),
        F.when(k % 1000 == 7, F.lit("n/a")).when(k % 1000 == 8, F.lit("x")).otherwise(k.cast("string")).alias("mixed"), F.lit("NULL").alias("nothing"), "event_type",
    )
    out = shared_scratch(spark, "typed")
    files.write_events(text, out, fmt="csv")
    return files.read_posts_csv(spark, out, infer=True)


def q_typed_csv(spark, sf_dir):
    """A1: values of inferred types."""
    t = _typed_csv(spark, sf_dir)
    return t.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "value": F.round("value", 6), "double_id": F.col("event_id") * 2})


def q_typed_schema(spark, sf_dir):
    """A1: the inferred type of every column."""
    kinds = _typed_csv(spark, sf_dir).dtypes
    return spark.createDataFrame(kinds, "name string, kind string")


def q_tsv_ingest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tweet"), "source")
    out = shared_scratch(spark, "tsv")
    # one file per folder, rows in doc_id order (file order decides "first"); written as
    # UTF-8 and read as Latin-1 like the reference, so non-ASCII raw text arrives double-encoded
    (
        d.repartition("source").sortWithinPartitions("doc_id").write.partitionBy("source")
        .option("sep", "\t").option("header", True).option("escape", '"').mode("overwrite").csv(out)
    )
    return pl.ingest_labelled(spark, out, glob="*.csv")  # Spark's CSV writer names files *.csv


# The headers of the mixed folders; the last one has no text column.
MIXED_HEADERS = ("doc_id\ttweet", "text\tlang\tn", "n\tx\tTweet\ty", "doc_id\tbody")


def _mixed_folders(spark, sf_dir) -> str:
    """Documents as TSV folders with four kinds of header; every 11th line has a field too many, every 13th text is NA. Returns the root."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    kind = F.pmod(F.ascii("source") + F.length("source"), F.lit(4))
    quoted = F.when(F.col("doc_id") % 13 == 5, F.lit("NA")).otherwise(F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')))
    n = F.col("doc_id").cast("string")
    line = (
        F.when(kind == 0, F.concat_ws("\t", n, quoted)).when(kind == 1, F.concat_ws("\t", quoted, "lang", n))
        .when(kind == 2, F.concat_ws("\t", n, F.lit("x"), quoted)).otherwise(F.concat_ws("\t", n, quoted))
    )
    # a short row (kind 2 lacks its last field) stays short unless it gets fields too many
    extra = F.when(F.col("doc_id") % 11 == 3, F.when(kind == 2, F.lit("\t\tover")).otherwise(F.lit("\t"))).otherwise(F.lit(""))
    lines = d.select("source", F.col("doc_id").alias("o"), F.concat(line, extra).alias("value"))
    heads = d.select("source", F.lit(-1).cast("long").alias("o"), F.element_at(F.array(*map(F.lit, MIXED_HEADERS)), (kind + 1).cast("int")).alias("value")).distinct()
    out = shared_scratch(spark, "tsv-mixed")
    one_file = rows.union_all([lines, heads]).repartition("source").sortWithinPartitions("source", "o")
    one_file.select("source", "value").write.partitionBy("source").text(out)
    return out


def q_tsv_ingest_mixed(spark, sf_dir):
    """A3-A6 with K1 on folders of mixed headers, over-long and short rows, missing texts and files without a text column."""
    return pl.ingest_with_ledger(spark, _mixed_folders(spark, sf_dir), glob="*.txt")[0]


def q_tsv_ledger(spark, sf_dir):
    """A5: what that scan left out, by folder and reason."""
    ledger = pl.ingest_with_ledger(spark, _mixed_folders(spark, sf_dir), glob="*.txt")[1]
    return ledger.groupBy("folder", "reason").agg(F.sum("rows").alias("rows"))


def q_discover_sentiment(spark, sf_dir):
    """Headerless Latin-1 CSV written from documents (dates from events joined on id), read back, discovered."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    day_name = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" PDT "), F.date_format("ts", "yyyy"))
    rows_ = d.join(e, "doc_id", "left").select(
        F.when(F.col("doc_id") % 2 == 0, 0).otherwise(4).alias("sentiment"), F.col("doc_id").alias("tweet_id"),
        day_name.alias("date"), F.lit("NO_QUERY").alias("query"), F.col("source").alias("user"), "text",
    )
    out = shared_scratch(spark, "headerless")
    # written as UTF-8 and read as Latin-1, as tsv_ingest does: no character is lost
    rows_.write.option("header", False).option("escape", '"').csv(out)
    return pl.discover_sentiment(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_titles": q_source_titles,
    "clean_semantic": q_clean_semantic,
    "clean_emotion": q_clean_emotion,
    "clean_display": q_clean_display,
    "strip_urls": q_strip_urls,
    "strip_mentions": q_strip_mentions,
    "strip_rt": q_strip_rt,
    "strip_lead_punct": q_strip_lead_punct,
    "unhash": q_unhash,
    "cap_bang": q_cap_bang,
    "cap_question": q_cap_question,
    "cap_mixed": q_cap_mixed,
    "squash_ws": q_squash_ws,
    "repair_encoding": q_repair_encoding,
    "repair_cp1252": q_repair_cp1252,
    "repair_mixed": q_repair_mixed,
    "display_mixed": q_display_mixed,
    "emotion_features": q_emotion_features,
    "encoding_suspects": q_encoding_suspects,
    "encoding_audit": q_encoding_audit,
    "emotion_report": q_emotion_report,
    "null_tokens": q_null_tokens,
    "event_name_from_path": q_event_name_from_path,
    "title_from_name": q_title_from_name,
    "resolve_conform": q_resolve_conform,
    "merge_datasets": q_merge_datasets,
    "label_posts": q_label_posts,
    "dedupe_first": q_dedupe_first,
    "stage_report": q_stage_report,
    "event_stats": q_event_stats,
    "top_events": q_top_events,
    "peek_rows": q_peek_rows,
    "sample_n": q_sample_n,
    "parse_dates": q_parse_dates,
    "date_layouts": q_date_layouts,
    "date_rejects": q_date_rejects,
    "time_window": q_time_window,
    "weekly_counts": q_weekly_counts,
    "weekly_orders": q_weekly_orders,
    "no_date_window": q_no_date_window,
    "filter_small_groups": q_filter_small_groups,
    "dense_codes": q_dense_codes,
    "centroids": q_centroids,
    "knn_edges": q_knn_edges,
    "adaptive_threshold": q_adaptive_threshold,
    "connected_components": q_connected_components,
    "renumber_events": q_renumber_events,
    "merge_events": q_merge_events,
    "term_counts": q_term_counts,
    "title_events": q_title_events,
    "topic_coherence": q_topic_coherence,
    "mean_coherence": q_mean_coherence,
    "hashed_tfidf": q_hashed_tfidf,
    "silhouette_sq": q_silhouette_sq,
    "silhouette_exact": q_silhouette_exact,
    "reduce_dims": q_reduce_dims,
    "reduce_neighbours": q_reduce_neighbours,
    "reduce_neighbours_check": q_reduce_neighbours_check,
    "knn_graph_check": q_knn_graph_check,
    "assign_events": q_assign_events,
    "reduce_dims_check": q_reduce_dims_check,
    "assign_events_check": q_assign_events_check,
    "assign_events_layout": q_assign_events_layout,
    "merge_then_enrich": q_merge_then_enrich,
    "export_events": q_export_events,
    "discover_events": q_discover_events,
    "discover_sentiment": q_discover_sentiment,
    "discover_from_labels": q_discover_from_labels,
    "discover_from_labels_summary": q_discover_from_labels_summary,
    "discover_from_labels_coherence": q_discover_from_labels_coherence,
    "discover_stages": q_discover_stages,
    "discover_encoded": q_discover_encoded,
    "csv_roundtrip": q_csv_roundtrip,
    "typed_csv": q_typed_csv,
    "typed_schema": q_typed_schema,
    "tsv_ingest": q_tsv_ingest,
    "tsv_ingest_mixed": q_tsv_ingest_mixed,
    "tsv_ledger": q_tsv_ledger,
}
