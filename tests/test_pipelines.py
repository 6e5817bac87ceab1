import os
import tempfile

import pytest
from pyspark.sql import functions as F

from eventlens.plans import pipelines as pl

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_discover_events_properties(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pl.discover_events(docs, "doc_id", pl.DiscoveryConfig(clusters=8)).cache()
    rows = out.collect()
    assert rows, "some posts survive"
    ids = sorted({r.event_id for r in rows})
    assert ids == list(range(len(ids)))  # final ids are dense 0..m-1
    assert {r.time_window for r in rows} == {"global"}  # documents have no date column
    titles = {}
    for r in rows:
        titles.setdefault(r.event_id, set()).add(r.event_title)
    assert all(len(t) == 1 for t in titles.values())  # one title per event
    prepared = pl.prepare_posts(docs, "doc_id").select("doc_id")
    assert out.select("doc_id").subtract(prepared).count() == 0
    assert out.select("doc_id").distinct().count() == len(rows)


def test_discover_sentiment_headerless_csv(spark):
    root = tempfile.mkdtemp(prefix="eventlens-s140-")
    lines = []
    for i in range(40):
        topic = ["flood water rising fast in town", "huge fire near the forest road", "storm wind power cut all night"][i % 3]
        day = 6 + (i % 2) * 7
        lines.append(f'{4 if i % 2 else 0},{1000 + i},"Mon Apr {day:02d} 22:19:45 PDT 2009",NO_QUERY,u{i},"{topic} number {"x" * (i + 1)}"')
    lines.append('0,9999,"not a date",NO_QUERY,u,"this one has no usable date at all"')
    with open(f"{root}/posts.csv", "w", encoding="latin-1") as f:
        f.write("\n".join(lines) + "\n")
    out = pl.discover_sentiment(spark, root, pl.DiscoveryConfig(clusters=3, sample_cap=200_000, with_emotion=False))
    rows = out.collect()
    assert set(out.columns) >= {"raw_text", "clean_text", "sentiment", "date", "event_id", "event_title", "time_window"}
    assert {r.time_window for r in rows} <= {"2009-04-06/2009-04-12", "2009-04-13/2009-04-19"}
    assert all("no usable date" not in r.raw_text for r in rows)
    assert sorted({r.event_id for r in rows}) == list(range(len({r.event_id for r in rows})))


def test_prepare_posts_length_and_first_kept(spark):
    data = [
        (1, "abcde fghi", "2024-01-08"),          # clean text of exactly 10 characters: dropped
        (2, "Flood in the VALLEY!!", "2024-01-07 23:59:59"),
        (3, "flood in the valley", "2024-01-09"),  # same clean text as 2: the first (2) is kept
        (4, "fire near the old mill", "garbage"),  # unparsable date: dropped after dedupe
    ]
    df = spark.createDataFrame(data, "id long, text string, created_at string")
    out = {r.id: r for r in pl.prepare_posts(df, "id").collect()}
    assert set(out) == {2}
    assert out[2].clean_text == "flood in the valley"
    assert out[2].emotion_text == "flood in the valley"
    assert out[2].time_window == "2024-01-01/2024-01-07"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_order_dependent_operators_are_partition_invariant(spark):
    from eventlens.operators.rows import dense_codes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    conv = spark.read.parquet(f"{SF}/conversations.parquet").withColumnRenamed("conv_id", "event_id")
    results = []
    for parts in (1, 8):
        d = docs.repartition(parts)
        lp = pl.label_posts(d, "source", "text", ["doc_id"], carry=["doc_id"])
        merged = pl.merge_datasets([pl.Dataset("a", lp, ["event_id", "doc_id"]), pl.Dataset("b", conv.repartition(parts), ["event_id", "turn"])])
        codes = dense_codes(d, "source", "c")
        results.append((sorted(map(tuple, lp.collect())), sorted(map(tuple, merged.collect())), sorted(map(tuple, codes.collect()))))
    assert results[0] == results[1]


def test_scratch_is_cleared(spark):
    from eventlens.session import clear_scratch, materialize, scratch_root

    kept = materialize(spark.range(3), "scratch-test")
    assert kept.count() == 3
    clear_scratch(spark)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    assert not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def test_discovery_leaves_no_table_that_no_step_reads(spark):
    import glob
    import re

    from eventlens.session import scratch_root

    root = scratch_root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    docs = spark.createDataFrame([(i, f"flood water river number {'abcdefghij'[i % 10] * (3 + i // 10)}") for i in range(60)], "doc_id long, text string")
    found = pl.discover(docs, "doc_id", pl.DiscoveryConfig(clusters=3))
    left = {re.sub("-[0-9a-f]{32}$", "", x.rsplit("/", 1)[1]) for x in set(glob.glob(f"{root}/*")) - before}
    assert {"posts", "post-clusters", "events"} <= left
    assert not left & {"dedupe-rows", "dedupe-losers", "post-vectors", "post-reduced", "kmeans-rows", "kmeans-points"}
    assert found.events.count() == found.facts.count() and {r["stage"] for r in found.stages.collect()} == {"read", "clean", "sampled", "clustered", "events"}
