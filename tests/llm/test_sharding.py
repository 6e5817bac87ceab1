"""Rendezvous sharding: placement, movement, slots and awkward rows."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlens.llm import sharding


def placed(spark, n, shards, **kw):
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    return sharding.assign_shards(docs, shards, **kw)


def test_rows_sizes_and_slots(spark):
    texts = ["a b", "", None, "é" * 70000, "a b"] * 40
    docs = spark.createDataFrame([(i, t, 9, 9) for i, t in enumerate(texts)], "doc_id long, text string, shard int, part int").repartition(7)
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    for s, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_a_new_shard_takes_rows_only_into_itself(spark):
    rows = placed(spark, 20000, 8).collect()
    share = Counter(r["shard"] for r in rows)
    assert set(share) == set(range(8)) and all(abs(n - 2500) < 250 for n in share.values())
    gone = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert all(r["grown_shard"] == 8 for r in gone) and abs(len(gone) - 20000 / 9) < 250


def test_weights_give_shares_and_bound_movement(spark):
    old, new = {0: 1.0, 1: 2.0, 5: 3.0}, {0: 1.0, 1: 2.5, 5: 3.0}
    rows = placed(spark, 12000, old, grown=new).collect()
    share = Counter(r["shard"] for r in rows)
    assert all(abs(share[s] - 12000 * w / 6) < 300 for s, w in old.items())
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} == {1}
    less = placed(spark, 12000, old, grown={0: 1.0, 5: 3.0}).collect()
    assert {r["shard"] for r in less if r["grown_shard"] != r["shard"]} == {1}


def test_placement_ignores_layout_and_other_columns(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "cast(id AS string) AS text", "1 AS slot")
    one = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.repartition(1)).collect()}
    many = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.withColumn("text", F.lit(None).cast("string")).repartition(13)).collect()}
    assert one == many


def test_one_hot_key_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "same")] * 300 + [(None, None)] * 5, "doc_id long, text string").repartition(9)
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == 305 and len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    for s, n in Counter(r["shard"] for r in rows).items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.weighted({0: 0.0})


def test_written_shards_and_moves(spark, tmp_path):
    docs = spark.range(900).selectExpr("id AS doc_id", "concat('t', id % 7) AS text", "id % 3 AS part")
    sharding.write_shards(docs, str(tmp_path / "s"), 4, files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    want = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs, 4).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == want and set(docs.columns) <= set(back.columns)
    gone = sharding.moved(docs, 4, 5).collect()
    assert gone and all(r["to_shard"] == 4 and want[r["doc_id"]] == r["from_shard"] for r in gone)
