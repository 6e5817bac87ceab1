"""Per-event term statistics: term counts (E6), titles (J10) and topic
coherence (J11/E7).

Scale notes
  * Term counts are a partial aggregate on (event, term): hot terms and hot
    events combine on the map side before the shuffle.
  * Ranking happens on the (event, term) count table, never on raw token
    rows, and in two salted phases, so a hot event's vocabulary is ranked by
    many tasks before its winners meet.
  * Coherence uses the linear identity (below) instead of a V x V matrix; its
    sums are taken in Arrow batches, so the shuffle carries (event, term) counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.text import ENGLISH_STOP_WORDS, term_filter
from eventlens.session import materialize

# Fixed values of the reference's event labelling and scoring.
TITLE_TERMS = 3
MIN_EVENT_ROWS = 10
SMALL_EVENT = "Small Event"
GENERIC_EVENT = "Generic Event"
COHERENCE_MAX_TERMS = 3000
COHERENCE_EPS = 1e-9


def _terms(df: DataFrame, key: str, clean_col: str, doc_col: str | None, stop_words) -> DataFrame:
    cols = [F.col(key)] + ([F.col(doc_col)] if doc_col else [])
    return df.select(*cols, F.explode(F.split(F.col(clean_col), " ")).alias("term")).filter(
        term_filter("term", stop_words)
    )


def term_counts(df: DataFrame, key: str, clean_col: str, stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """(key, term, tf) token counts per group."""
    return _terms(df, key, clean_col, None, stop_words).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


# Salt buckets for per-event ranking: a hot event's vocabulary is ranked in
# this many tasks first, then only the per-bucket winners meet in one task.
RANK_SALT_BUCKETS = 32


def top_n_per_group(df: DataFrame, key: str, order, n: int, rank_col: str = "rank",
                    salt_col: str = "term", buckets: int = RANK_SALT_BUCKETS) -> DataFrame:
    """Exact top-n rows per ``key`` in two phases (skew-safe).

    Phase 1 ranks inside (key, hash(salt_col) % buckets); the overall top n of
    a key are necessarily among the top n of their own bucket. Phase 2 ranks
    at most ``buckets * n`` candidates per key. ``order`` must be a total order.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(buckets)))
    first = salted.withColumn(
        "_r1", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    ).filter(F.col("_r1") <= n).drop("_r1", "_salt")
    return first.withColumn(rank_col, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(
        F.col(rank_col) <= n
    )


def top_terms(tf: DataFrame, key: str, n: int = TITLE_TERMS) -> DataFrame:
    """(key, term, tf, rank) for the n most frequent terms; ties by term descending."""
    return top_n_per_group(tf, key, [F.desc("tf"), F.desc("term")], n)


def title_events(
    df: DataFrame,
    key: str,
    clean_col: str,
    n: int = TITLE_TERMS,
    min_rows: int = MIN_EVENT_ROWS,
    stop_words=ENGLISH_STOP_WORDS,
) -> DataFrame:
    """(key, num_tweets, event_title).

    Fewer than ``min_rows`` rows -> 'Small Event'; no kept term -> 'Generic Event';
    otherwise the top terms in rank order, space-joined, Title Case.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("num_tweets"))
    top = top_terms(term_counts(df, key, clean_col, stop_words), key, n)
    joined = top.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " "
        ).alias("_terms")
    )
    title = (
        F.when(F.col("num_tweets") < min_rows, F.lit(SMALL_EVENT))
        .when(F.col("_terms").isNull() | (F.col("_terms") == ""), F.lit(GENERIC_EVENT))
        .otherwise(F.initcap(F.col("_terms")))
    )
    return sizes.join(joined, key, "left").select(key, "num_tweets", title.alias("event_title"))


#: Clean text that is split at a time, and (event, term) pairs of capped events that may be sent to all tasks.
TEXT_BYTES = 8 << 20
VOCAB_ROWS = 600_000


def _slices(batch: pa.RecordBatch, limit: int = TEXT_BYTES):
    """Slices of a batch with about ``limit`` bytes of text (at least one row each)."""
    part = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _term_sums(key: str, stop_words, kept: pa.Table | None = None):
    """mapInArrow function: (key, term, tf, _s) of each slice; ``_s`` sums, over rows holding the term, their numbers of distinct terms.

    ``kept``: the only (key, term) pairs that count.
    """
    stop = pa.array(list(stop_words), pa.large_string())
    if kept is not None:
        events, words = kept[key].unique(), kept["term"].cast(pa.large_string()).unique()
        at = lambda column, values: pc.index_in(column, values).to_numpy().astype(np.int64)
        allowed = np.sort(at(kept[key], events) * len(words) + at(kept["term"].cast(pa.large_string()), words))

    def sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = pc.split_pattern(batch.column("_text").cast(pa.large_string()), " ")
        per_row = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded, event = pc.list_flatten(parts).dictionary_encode(), batch.column(key).dictionary_encode()
        terms, width = coded.dictionary, max(1, len(coded.dictionary))
        good = (pc.greater_equal(pc.utf8_length(terms), 2).to_numpy(zero_copy_only=False)) & ~pc.is_in(terms, stop).to_numpy(zero_copy_only=False)
        code, of_row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), event.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), per_row)[good[code]]
        held, tf = np.unique(row * width + code[good[code]], return_counts=True)  # a row's distinct terms
        row, code = held // width, held % width
        pair, place = np.unique(of_row[row] * width + code, return_inverse=True)
        if kept is not None:
            e, w = (pc.fill_null(pc.index_in(d, v), -1).to_numpy(zero_copy_only=False).astype(np.int64) for d, v in ((event.dictionary, events), (terms, words)))
            e, w = e[pair // width], w[pair % width]
            wanted = e * len(words) + w
            there = np.searchsorted(allowed, wanted)
            counts = (e >= 0) & (w >= 0) & (allowed[np.minimum(there, len(allowed) - 1)] == wanted)
            some = counts[place]
            row, tf = row[some], tf[some]
            pair, place = pair[counts], (np.cumsum(counts) - 1)[place[some]]
        distinct = np.bincount(row, minlength=batch.num_rows)
        whole = lambda x: np.bincount(place, x, len(pair)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [event.dictionary.take(pa.array(pair // width)), terms.take(pa.array(pair % width)).cast(pa.string()), pa.array(whole(tf)), pa.array(whole(distinct[row]))],
            names=[key, "term", "tf", "_s"],
        )

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from map(sums, _slices(batch))

    return run


def _event_terms(rows: DataFrame, key: str, stop_words, kept: pa.Table | None = None) -> DataFrame:
    """(key, term, tf, _s) of whole events; a row of ``rows`` (key, _text) is a document."""
    schema = T.StructType([rows.schema[key], *(T.StructField(n, t) for n, t in (("term", T.StringType()), ("tf", T.LongType()), ("_s", T.LongType())))])
    partial = rows.select(key, "_text").mapInArrow(_term_sums(key, stop_words, kept), schema)
    return partial.groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.sum("_s").cast("double").alias("_s"))


def _capped_sums(rows: DataFrame, key: str, doc_col: str, vocab: DataFrame, stop_words) -> DataFrame:
    """(key, term, _s) where only the terms of ``vocab`` count.

    A vocabulary of at most ``VOCAB_ROWS`` rows, counted, is sent to the tasks, and no text is shuffled. Larger ones, and
    rows that share a document's number, are joined by term and collected by document.
    """
    out, joined = None, rows
    if vocab.count() <= VOCAB_ROWS:
        again = materialize(rows.groupBy(key, doc_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("_k"), F.col(doc_col).alias("_d")), "repeated-documents")
        same = (F.col(key) == F.col("_k")) & F.col(doc_col).eqNullSafe(F.col("_d"))
        out = _event_terms(rows.join(again, same, "left_anti"), key, stop_words, vocab.toArrow()).select(key, "term", "_s")
        if again.isEmpty():
            return out
        joined = rows.join(again, same, "left_semi")
    terms = F.array_distinct(F.filter(F.split("_text", " "), lambda t: term_filter(t, stop_words)))
    present = joined.select(key, doc_col, F.explode(terms).alias("term"))
    held = present.join(vocab, [key, "term"], "left_semi").groupBy(key, doc_col).agg(F.collect_list("term").alias("_kept"))
    slow = held.select(key, F.explode("_kept").alias("term"), F.size("_kept").alias("m")).groupBy(key, "term").agg(F.sum("m").cast("double").alias("_s"))
    return slow if out is None else out.unionByName(slow).groupBy(key, "term").agg(F.sum("_s").alias("_s"))


def topic_coherence(
    df: DataFrame,
    key: str,
    doc_col: str,
    clean_col: str,
    max_terms: int | None = None,
    min_rows: int = MIN_EVENT_ROWS,
    eps: float = COHERENCE_EPS,
    stop_words=ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Mean of the row-normalised binary co-occurrence matrix per event.

    With C the V x V document co-occurrence of the event's kept terms and S_i
    its row sums, mean(C / (S + eps)) = (1/V^2) * sum_i S_i / (S_i + eps), and
    S_i = sum over documents containing term i of that document's number of
    distinct kept terms. Kept terms: all, or the top ``max_terms`` by frequency
    (ties by term). Events under ``min_rows`` rows are skipped; events without any
    kept term score 0.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("num_tweets")).filter(F.col("num_tweets") >= min_rows)
    big = df.join(sizes.select(key), key, "left_semi").select(key, doc_col, F.coalesce(F.col(clean_col), F.lit("")).alias("_text"))
    counts = _event_terms(big, key, stop_words)
    if max_terms is None:
        s_i = counts
    else:
        counts = materialize(counts, "event-terms")
        over = materialize(counts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_terms).select(key), "events-over-cap")
        s_i = counts.join(over, key, "left_anti").select(key, "term", "_s")
        if not over.isEmpty():
            # events with more terms: only the top ones count, so the numbers per document are taken again
            top = top_n_per_group(counts.join(over, key, "left_semi"), key, [F.desc("tf"), F.asc("term")], max_terms, "_r")
            vocab = materialize(top.select(key, "term"), "event-vocabulary")
            s_i = s_i.unionByName(_capped_sums(big.join(over, key, "left_semi"), key, doc_col, vocab, stop_words))
    score = s_i.groupBy(key).agg(
        (F.sum(F.col("_s") / (F.col("_s") + F.lit(eps))) / F.pow(F.count(F.lit(1)).cast("double"), 2)).alias("_c")
    )
    return sizes.join(score, key, "left").select(
        key, "num_tweets", F.coalesce(F.col("_c"), F.lit(0.0)).alias("coherence")
    )


def mean_coherence(coherence: DataFrame) -> DataFrame:
    """Average over scored events (null when there is none)."""
    return coherence.agg(F.avg("coherence").alias("mean_coherence"), F.count(F.lit(1)).alias("scored_events"))
