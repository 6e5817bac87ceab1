"""From raw documents to packed training sequences, in five stages.

Every stage calls one operator of ``eventlens.llm`` on all documents that its predecessor kept
and acts on its decisions; its result is written as Parquet and read again. All but the last
return the columns of ``documents``. A row is known by its doc_id and a hash of its text, so a
doc_id that occurs with several texts is several documents; rows that repeat both are copies, of
which exact deduplication keeps one.

Defined cases: a null doc_id is an id like any other, a null text an empty one; of rows that tie at
the quality cut as many stay as the operator draws, and the copies of those; an empty table gives
empty tables and an empty result; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import decontamination, exact_dedup, packing, quality, simhash
from eventlens.llm.queries import table, tokenizer_path
from eventlens.session import discard, ensure_checkpoint_dir, materialize

KEY = "__text_key"


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) a row of (doc_id, text_key); null ids match null ids."""
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn(KEY, F.xxhash64("text"))
    return keyed.join(rows, keyed["doc_id"].eqNullSafe(rows["__id"]) & (keyed[KEY] == rows["__key"]), how).drop(KEY)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, with all copies of a row of which any is drawn."""
    found = quality.importance_resample(docs, table(spark, sf_dir, "labels"))
    return _matched(docs, found.where("selected"), "left_semi")


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    found = materialize(exact_dedup.exact_dedup(docs), "pipeline-copies")
    kept = _matched(docs, found.where("kept"), "left_semi")
    twice = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return kept
    # rows that repeat both id and text: one of them
    once = kept.withColumn(KEY, F.xxhash64("text")).dropDuplicates(["doc_id", KEY]).drop(KEY)
    return _matched(kept, twice, "left_anti").unionByName(_matched(once, twice, "left_semi"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each component of near-duplicates."""
    found = simhash.near_duplicates(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "text_key")).alias("first")
    # a component is named by its least id; those of null ids alone have no name and are told apart by fingerprint
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    return _matched(docs, found.groupBy(group).agg(first).select("first.doc_id", "first.text_key"), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _matched(docs, materialize(found.select("doc_id", "text_key").distinct(), "pipeline-hits"), "left_anti")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the resampling nor the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(last)  # a stage's table goes once the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
