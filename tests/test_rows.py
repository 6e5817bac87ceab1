import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventlens.operators import rows
from eventlens.plans.pipelines import Dataset, merge_datasets


def test_dedupe_first_matches_pandas_and_is_partition_invariant(spark):
    data = [(i, f"t{i % 7}", i * 10) for i in range(60)] + [(100, None, 1), (101, None, 2)]
    df = spark.createDataFrame(data, "id long, key string, v long")
    want = pd.DataFrame(data, columns=["id", "key", "v"]).sort_values("id").drop_duplicates("key")
    for parts in (1, 8):
        got = rows.dedupe_first(df.repartition(parts), "key", ["id"]).toPandas().sort_values("id")
        assert got["id"].tolist() == want["id"].tolist()


def test_filter_small_groups_counts_before_filter(spark):
    data = [(i, "a") for i in range(10)] + [(100 + i, "b") for i in range(9)]
    df = spark.createDataFrame(data, "id long, g string")
    kept = rows.filter_small_groups(df, "g").select("g").distinct().collect()
    assert [r.g for r in kept] == ["a"]


def test_sample_n_exact_and_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a = rows.sample_n(df, 100, 42, "doc_id").collect()
    b = rows.sample_n(df.repartition(7), 100, 42, "doc_id").collect()
    assert len(a) == 100 and sorted(a) == sorted(b)
    assert rows.sample_n(df, 5000, 42, "doc_id").count() == 1000


def test_merge_datasets_precedence_and_defaults(spark):
    d1 = spark.createDataFrame([(1, "same", 7, "Flood"), (2, "only1", 8, "Fire")], "r long, raw_text string, event_id long, event_title string")
    d2 = spark.createDataFrame([(1, "same", 3, "Other")], "r long, text string, event_id long, event_title string")
    d3 = spark.createDataFrame([(1, "x3"), (2, None)], "r long, clean_text string")
    out = merge_datasets([Dataset("one", d1, ["r"]), Dataset("two", d2, ["r"]), Dataset("three", d3, ["r"])])
    got = {r.raw_text: r for r in out.collect()}
    assert set(got) == {"same", "only1", "x3"}
    assert got["same"].event_id == 7 and got["same"].dataset_name == "one"
    assert (got["x3"].event_id, got["x3"].event_title, got["x3"].global_event_id) == (-1, "Unknown Event", "three_-1")
    assert got["only1"].global_event_id == "one_8"


def test_keep_rows_evaluates_once(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, s string").withColumn("n", F.length("s"))
    out = rows.keep_rows(df, F.col("n") > 1)
    assert [r.id for r in out.collect()] == [2]
    assert out.columns == ["id", "s", "n"]


def test_conform_tolerates_text_ids(spark):
    from eventlens.operators.schema import conform

    df = spark.createDataFrame([("a", "7", "T"), ("b", "x7", "U")], "text string, event_id string, event_title string")
    got = {r.raw_text: r.event_id for r in conform(df).collect()}
    assert got == {"a": "7", "b": "x7"}
    numbers = spark.createDataFrame([("c", 3.0)], "text string, event_id double")
    out = merge_datasets([Dataset("one", df, ["event_title", "text", "event_id"]), Dataset("two", numbers, [])])
    assert {r.raw_text: r.global_event_id for r in out.collect()} == {"a": "one_7", "b": "one_x7", "c": "two_3"}


def test_merge_takes_any_order_columns(spark):
    data = [("t", "b", 1, 2, "late"), ("t", "a", 2, 9, "mid"), ("t", "a", 2, 1, "first")]
    df = spark.createDataFrame(data, "text string, path string, part int, line int, event_title string")
    out = merge_datasets([Dataset("one", df, ["path", "part", "line"])]).collect()
    assert [r.event_title for r in out] == ["first"]


def test_positions_of_many_rows_with_a_payload(spark):
    """Positions hold when plans don't share the sort's exchange."""
    n = 1_000_000
    df = spark.range(0, n, numPartitions=16).select(
        (F.col("id") * 7919 % n).alias("v"), F.concat(F.lit("payload "), F.col("id")).alias("payload")
    )
    for reuse, adaptive in (("true", "true"), ("false", "false"), ("false", "true")):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            r = rows.global_positions(df, ["v"]).agg(F.count("*").alias("n"), F.count_if(F.col("_gpos") != F.col("v")).alias("bad")).first()
            assert (r.n, r.bad) == (n, 0)
            assert rows.exact_quantile(df, "v", 0.9).first()[0] == 0.9 * (n - 1)
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_spread_only_when_under_parallel(spark):
    from eventlens.sources.tables import spread

    target = spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, numPartitions=target * 2)
    assert spread(wide, "id") is wide  # enough scan partitions: no shuffle added
    narrow = spark.range(0, 1000, numPartitions=1)
    spread_df = spread(narrow, "id")
    assert spread_df.rdd.getNumPartitions() == target
    assert sorted(r.id for r in spread_df.collect()) == list(range(1000))


@pytest.mark.parametrize("bits", [1, 64])
def test_dedupe_first_by_hashes_against_a_dict(spark, bits):
    rng = random.Random(bits)
    data = [(rng.choice([None, "", "a", "b" * 500, "é", "c"]), rng.choice([None, 1, 2]), rng.randint(0, 50), i, f"p{i}") for i in range(400)]
    df = spark.createDataFrame(data, "k string, j long, o long, i long, payload string").repartition(6)
    best = {}
    for r in data:
        best[r[:2]] = min(best.get(r[:2], r), r, key=lambda x: x[2:4])
    got = [tuple(r) for r in rows.dedupe_first(df, ["k", "j"], ["o", "i"], hash_bits=bits).collect()]
    assert sorted(got, key=str) == sorted(best.values(), key=str)


def test_dedupe_first_keeps_one_of_equal_rows_and_sorts_no_text(spark):
    df = spark.createDataFrame([("x", 1)] * 50 + [("y", 1)], "k string, o long").repartition(4)
    out = rows.dedupe_first(df, "k", ["o"])
    assert sorted(r["k"] for r in out.collect()) == ["x", "y"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" not in plan
    assert rows.dedupe_first(df.limit(0), "k", ["o"]).count() == 0
