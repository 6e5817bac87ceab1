"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Every normalised text is cut into chunks whose ends depend on content alone: a chunk ends
at the first punctuation mark after ``min_chunk`` code points, or at ``max_chunk``. Equal
texts give equal chunks, so a text is its *recipe*, the ordered list of chunk identifiers.

An identifier is the chunk's 64-bit hash, verified: every distinct chunk is moved once to
the task of its (hash, chunk) pair, and hashes that two different chunks share are found.
Only if there are any, chunks of those hashes are told apart by a rank within the hash and
every recipe is built from (hash, rank). Recipes then group as plain arrays of longs:
documents themselves are never shuffled, sorted or compared whole.

Defined cases: null text counts as empty, and all empty texts are one group. Rows that
repeat a doc_id are rows of their own; of equal rows one stays. A null doc_id sorts last.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import SPACE_CLASS, columns, text_of
from eventlens.session import materialize

MIN_CHUNK, MAX_CHUNK = 1024, 4096


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), f"{SPACE_CLASS}+", "")


def chunk_pattern(min_chunk: int, max_chunk: int) -> str:
    return rf"(?s).{{{min_chunk - 1},{max_chunk - 1}}}?\p{{P}}|.{{1,{max_chunk}}}"


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chunk: int = MIN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks, text_key (hash of the original text).

    ``hash_bits`` shortens the chunk hash; results do not depend on it (tests use it to
    force hashes that different chunks share).
    """
    shift = 64 - hash_bits
    digest = lambda c: F.shiftrightunsigned(F.xxhash64(c), shift) if shift else F.xxhash64(c)
    source = columns(docs, doc_id=id_col, text=text_col)
    cut = source.select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.char_length(text_of("text")).alias("n_cps"), normalised("text").alias("norm")
    ).withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern(min_chunk, max_chunk)), F.lit(0)))

    rows = materialize(
        cut.select(
            F.monotonically_increasing_id().alias("rid"),
            "doc_id",
            "text_key",
            "n_cps",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform("chunks", digest).alias("recipe"),
        ),
        "dedup-rows",
    )
    chunks = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("h"), "chunk")
    shared = materialize(
        chunks.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-shared"
    )
    if not shared.isEmpty():
        rows = _ranked(cut, shared, digest)
    first = F.min(F.struct((-F.col("n_cps")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "rid"))
    # written, so that the join below is a plain one, whose hot recipe adaptive execution splits
    groups = materialize(rows.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size")), "dedup-groups")
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first.rid") == F.col("rid")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
        "text_key",
    )


def _ranked(cut: DataFrame, shared: DataFrame, digest) -> DataFrame:
    """Rows again, with recipes of hash and rank, for the case that chunks share hashes.

    Rank 0 is every chunk of an unshared hash; the chunks of a shared hash are ranked by
    their bytes, and an occurrence finds its rank by (hash, chunk).
    """
    pieces = materialize(
        cut.withColumn("rid", F.monotonically_increasing_id())  # a row's number, before it is exploded
        .select("rid", "doc_id", "text_key", "n_cps", F.sha2("norm", 256).alias("text_sha256"), F.posexplode_outer("chunks").alias("pos", "chunk"))
        .withColumn("h", digest(F.col("chunk"))),
        "dedup-pieces",
    )
    hit = pieces.join(shared, "h", "left_semi")
    ranks = (
        hit.select("h", "chunk")
        .distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long"))
    )
    told = pieces.join(ranks, ["h", "chunk"], "left")
    item = F.struct("pos", F.array("h", F.coalesce("rank", F.lit(0).cast("long"))).alias("id"))
    return materialize(
        told.groupBy("rid", "doc_id", "text_key", "n_cps", "text_sha256")
        .agg(F.sort_array(F.collect_list(F.when(F.col("chunk").isNotNull(), item))).alias("items"))
        .select("rid", "doc_id", "text_key", "n_cps", "text_sha256", F.flatten(F.col("items.id")).alias("recipe")),
        "dedup-rows",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS k,
         length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY k) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY n DESC, doc_id)
"""
