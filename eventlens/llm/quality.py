"""Quality classifier by importance resampling over hashed n-gram models.

A text is a bag of hashed n-grams: words, word pairs, and pairs of word *shapes* (case, ending
punctuation, repetition of the word before, length class). Two generative models are fitted, a
multinomial over the hash buckets each: the target model on the texts that labels call good,
the raw model on all texts. A text's importance weight is the ratio of the two models'
probabilities for its bag, its log the sum of the buckets' log ratios.

Texts are then drawn without replacement in proportion to their weights by Gumbel top-k: the k
largest of log weight + Gumbel noise, the noise being a hash of the row. k is a setting; by
default it is the number of texts whose weight passes the cut that parts good from bad best
among labelled rows (balanced accuracy, ``prefer`` times as heavy on keeping good ones). One
half of the labelled rows, by hash, fits the target model, the other half chooses the cut.

All counts cover all rows and whole texts; a model is as large as its buckets, whatever the
input. The k-th key is found by counting keys in ever finer bins, so nothing is sorted whole.

Defined cases: null and empty texts have no n-gram and log weight 0; rows without label only
count as raw; a doc_id labelled twice is good only if all its labels are; equal keys are told
apart by row, so exactly k rows are drawn; without any good label the target is the raw model,
all weights are 0 and all rows are kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import RowIds, columns, small_batches, strings, words
from eventlens.session import materialize

WORD_BUCKETS, SHAPES = 1 << 14, 256
N_BUCKETS = 2 * WORD_BUCKETS + SHAPES * SHAPES
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_traits(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of distinct words. Shape: case (3 bits of kind), ending (2), length class (2)."""
    import xxhash

    listed = names.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed), np.uint64, len(listed))
    match = lambda p: pc.match_substring_regex(names, p).to_numpy(zero_copy_only=False).astype(np.int64)
    letters, lower, upper = match(r"\p{L}"), match(r"\p{Ll}"), match(r"\p{Lu}")
    first = match(r"^\p{Lu}")
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 3, np.where(first == 1, 2, 4))))
    digit = match(r"\p{N}")
    ending = np.where(match(r"[^\p{L}\p{N}]{2,}$") == 1, 2, match(r"[^\p{L}\p{N}]$"))
    length = np.digitize(pc.utf8_length(names).to_numpy(zero_copy_only=False), [4, 13])
    return hashes, ((case + 5 * digit) * 3 + ending) * 3 + length  # below 90


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, text after text, and n-grams per text."""
    code, counts, names = words(texts)
    hashes, shapes = word_traits(names)
    n = len(code)
    first = np.zeros(n, bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    again = np.zeros(n, np.int64)
    again[1:] = code[1:] == code[:-1]
    again[first] = 0
    h = hashes[code]
    shape = shapes[code] + 90 * again
    pair = h.copy()
    pair[1:] = (h[1:] ^ (h[:-1] * MIX)) * MIX
    pair[first] = h[first] * MIX + np.uint64(1)
    shape_before = np.empty(n, np.int64)
    shape_before[1:] = shape[:-1]
    shape_before[first] = SHAPES - 1
    out = np.empty((n, 3), np.int64)
    out[:, 0] = (h >> np.uint64(50)).astype(np.int64)
    out[:, 1] = WORD_BUCKETS + (pair >> np.uint64(50)).astype(np.int64)
    out[:, 2] = 2 * WORD_BUCKETS + shape_before * SHAPES + shape
    return out.ravel(), counts * 3


def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(good, bucket, n) over a partition."""
    sums = np.zeros((2, N_BUCKETS), np.int64)
    for whole in batches:
        for batch in small_batches(whole, "text", 10 << 20):
            bucket, per = features(strings(batch, "text"))
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            sums[0] += np.bincount(bucket, minlength=N_BUCKETS)
            sums[1] += np.bincount(bucket[np.repeat(good, per)], minlength=N_BUCKETS)
    which, bucket = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[which, bucket])], names=["target", "bucket", "n"])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log p_target / p_raw per bucket, from counts (raw, target), within each n-gram family.

    The raw model adds one to every bucket; the target model adds the raw model, as heavy as two counts a bucket.
    """
    out = np.zeros(N_BUCKETS)
    if not counts[1].any():
        return out
    for a, b in ((0, WORD_BUCKETS), (WORD_BUCKETS, 2 * WORD_BUCKETS), (2 * WORD_BUCKETS, N_BUCKETS)):
        raw = counts[0, a:b] + 1.0
        target = counts[1, a:b] + raw / raw.sum() * (b - a) * 2.0
        out[a:b] = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return out


def scored(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = RowIds()
        for whole in batches:
            for batch in small_batches(whole, "text", 10 << 20):
                bucket, per = features(strings(batch, "text"))
                upto = np.concatenate([[0.0], np.cumsum(ratios[bucket])])
                ends = np.cumsum(per)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.take(batch.num_rows)), batch.column("doc_id").cast(pa.int64()), batch.column("text_key").cast(pa.int64()),
                     batch.column("good").cast(pa.int32()), pa.array(per), pa.array(np.round(upto[ends] - upto[ends - per], 6))],
                    names=["rid", "doc_id", "text_key", "good", "n_grams", "log_weight"],
                )

    return run


def gumbel(*keys: str, seed: int = 0) -> Column:
    """Standard Gumbel noise as a hash of the row: -log(-log(u)), u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, bins: int = 4096, small: int = 20_000) -> tuple[float, int]:
    """The k-th largest ``key`` (k >= 1, at most the row count) and how many rows are above it.

    Counts per bin, then again within the bin that holds the k-th, until few are left.
    """
    low, high = values.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = values.where(F.col("key").between(low, high))
        n = inside.count()
        width = (high - low) / bins
        if n <= small or width <= 0 or low + width == low:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / width)).alias("bin")
        left = k - above
        for b, m, lo, hi in sorted(inside.groupBy(at).agg(F.count("*"), F.min("key"), F.max("key")).collect(), reverse=True):
            if left <= m:
                low, high = lo, hi
                break
            left, above = left - m, above + m
    if low == high:
        return low, above
    listed = sorted((r[0] for r in inside.select("key").collect()), reverse=True)
    value = listed[k - above - 1]
    return value, above + listed.index(value)


def best_cut(labelled: DataFrame, prefer: float) -> float:
    """The log weight that parts good from bad best, midway between its two neighbours; prefer: how much heavier a lost good text weighs than a kept bad one.

    ``labelled`` has log_weight and good (boolean), every row of which counts: rows are added up by weight, the weights
    split into ranges, and each range is scanned in order from the counts of those below it.
    """
    weights = labelled.groupBy("log_weight").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    weights = materialize(weights.repartitionByRange("log_weight").withColumn("part", F.spark_partition_id()), "weights-by-range")
    parts = weights.groupBy("part").agg(F.sum("g"), F.sum("b"), F.max("log_weight")).orderBy("part").collect()  # a row per range
    n_good, n_bad = sum(p[1] for p in parts), sum(p[2] for p in parts)
    if not n_good or not n_bad:
        return -np.inf
    # before each range: the good and bad rows below it, and the weight next below it
    below, good, bad, last = [], 0, 0, None
    for part, g, b, most in parts:
        below.append((part, good, bad, last))
        good, bad, last = good + g, bad + b, most
    start = weights.sparkSession.createDataFrame(below, "part int, good long, bad long, last double")
    inside = Window.partitionBy("part").orderBy("log_weight")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    cuts = weights.join(F.broadcast(start), "part").select(
        "log_weight",
        (F.col("good") + F.coalesce(F.sum("g").over(before), F.lit(0))).alias("lost"),
        (F.col("bad") + F.coalesce(F.sum("b").over(before), F.lit(0))).alias("left"),
        F.coalesce(F.lag("log_weight").over(inside), "last").alias("under"),
    )
    cost = F.lit(float(prefer)) * (F.col("lost") / n_good) + (F.lit(1.0) - F.col("left") / n_bad)
    best = cuts.agg(F.min(F.struct(cost.alias("cost"), "log_weight", "under")).alias("x")).select("x.*").first()
    if float(prefer) < best["cost"]:  # dropping all costs the good ones
        return np.inf
    return -np.inf if best["under"] is None else (best["under"] + best["log_weight"]) / 2


def importance_resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    prefer: float = 3.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per input row: doc_id, text_key (hash of the text), n_grams, log_weight, key, selected."""
    known = columns(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.min("label").cast("int").alias("good"))
    source = columns(docs, doc_id=id_col, text=text_col)
    source = source.join(F.broadcast(known) if _is_small(known) else known, "doc_id", "left")
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("good", F.lit(-1)).alias("good"))
    # half of the labelled rows fit the target, the other half choose the cut
    fits = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2)) == 0
    counted = source.withColumn("good", (F.col("good") == 1) & F.coalesce(fits, F.lit(False))).mapInArrow(bucket_counts, "target int, bucket int, n long")
    counts = np.zeros((2, N_BUCKETS), np.int64)  # at most two rows per bucket come back
    for r in counted.groupBy("target", "bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.target, r.bucket] = r.n
    weighed = source.withColumn("text_key", F.xxhash64("text")).mapInArrow(
        scored(log_ratios(counts)), "rid long, doc_id long, text_key long, good int, n_grams long, log_weight double"
    )
    rows = materialize(
        weighed.withColumn("key", F.col("log_weight") + gumbel("doc_id", "text_key", seed=seed)), "quality-scores"
    )
    total = rows.count()
    if k is None:
        cut = best_cut(rows.where((F.col("good") >= 0) & ~fits).select("log_weight", (F.col("good") == 1).alias("good")), prefer)
        k = total if cut == -np.inf else rows.where(F.col("log_weight") >= cut).count()
    out = ["doc_id", "text_key", "n_grams", "log_weight", "key"]
    if k >= total or k <= 0:
        return rows.select(*out, F.lit(k > 0).alias("selected"))
    value, above = kth_largest(rows, k)
    tied = rows.where(F.col("key") == value).select("rid").orderBy("rid").limit(k - above)
    return (
        rows.join(tied.withColumn("tied", F.lit(True)), "rid", "left")
        .select(*out, ((F.col("key") > value) | F.coalesce("tied", F.lit(False))).alias("selected"))
    )


def _is_small(labels: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether the labels may be broadcast: at most ``rows`` rows of 12 bytes, counted."""
    return labels.limit(rows + 1).count() <= rows
