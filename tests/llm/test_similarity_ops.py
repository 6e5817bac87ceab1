"""SimHash components and benchmark hits against brute force; the pipeline's decisions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlens.llm import decontamination, simhash

rng = random.Random(11)


def slow_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(points):
    """Representative (least position) of each point's component, by search over neighbour lists."""
    near = [np.flatnonzero(np.bitwise_count(points ^ p) <= 2).tolist() for p in points]
    least = [None] * len(points)
    for i in range(len(points)):
        queue = [i] if least[i] is None else []
        while queue:
            x = queue.pop()
            if least[x] is None:
                least[x] = i
                queue += near[x]
    return least


def clusters(n, seed):
    """Random fingerprints, chains of close ones, and a dense ball."""
    r = np.random.default_rng(seed)
    points = r.integers(0, 2**64, n, dtype=np.uint64).tolist()
    for c in range(n // 10):
        p = points[c]
        for _ in range(6):
            p ^= (1 << int(r.integers(64))) ^ (1 << int(r.integers(64)))
            points.append(p)
    ball = points[0]
    for _ in range(n):
        points.append(ball ^ sum({1 << int(b) for b in r.integers(0, 12, 5)}))
    return np.unique(np.array(points, np.uint64))


def test_fingerprint():
    for text in ("", "a", "A b", "a b c", "One two\tthree  four\n five é É" * 9, "x " * 500):
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("block", [8, 64])
def test_shard_links(block):
    points = clusters(300, block)
    edges = simhash.link_shard(points, 2, block)
    assert all(int(points[a] ^ points[b]).bit_count() <= 2 for a, b in edges)
    forest = simhash.Forest(len(points))
    for a, b in edges:
        forest.join(a, b)
    assert [forest.root(i) for i in range(len(points))] == slow_components(points)


@pytest.mark.parametrize(("sample", "shard"), [(200, 60), (50, 400), (1000, 5000)])
def test_components_over_shards(spark, sample, shard):
    points = clusters(300, shard)
    nodes = spark.createDataFrame([(int(p.view(np.int64)), i) for i, p in enumerate(points)], "fp long, label long")
    placed, dense = simhash.shards(nodes.select("fp"), 2, sample, shard)
    edges = placed.groupBy("shard").applyInArrow(simhash.shard_edges(2, 16), simhash.EDGES)
    if dense is not None:
        edges = edges.unionByName(simhash.dense_edges(dense, 2))
    got = {r["fp"]: r["component"] for r in simhash.components(nodes, edges).collect()}
    assert [got[int(p.view(np.int64))] for p in points] == slow_components(points)


def test_near_duplicates_of_awkward_rows(spark):
    base = " ".join(f"w{i * 7 % 101}" for i in range(400))
    texts = [None, "", " \n", base, base + " x", base.upper(), "one two", "ONE  two", "other"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, base, 1), (None, "lonely", 1), (None, "", 1)], "doc_id long, text string, fp long")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fingerprint"] == "0" * 16 and {by_id[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert by_id[6]["component_id"] == by_id[7]["component_id"] == 6
    assert by_id[5]["component_id"] == 3
    for i, t in enumerate(texts):
        assert by_id[i]["fingerprint"] == f"{slow_fingerprint(t):016x}"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def slow_distance(pattern, text):
    """Least edits of the pattern to any part of the text, by the usual table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_edit_distance():
    for _ in range(300):
        pattern = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 20))]
        want = slow_distance(pattern, text)
        hit = decontamination.least_distance(pattern, text, len(pattern))
        assert hit[0] == want
        assert (decontamination.least_distance(pattern, text, want - 1) is None) if want else True
        assert slow_distance(pattern, text[: hit[1]]) == want


VOCABULARY = [f"term{i}" for i in range(400)]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        p = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[p] = rng.choice(VOCABULARY)
        elif kind == 1:
            words.insert(p, rng.choice(VOCABULARY))
        else:
            del words[p]
    return words


def test_recall_and_precision():
    items = [[rng.choice(VOCABULARY) for _ in range(rng.randint(12, 60))] for _ in range(60)]
    block = decontamination.build_items(list(range(60)), [" ".join(w) for w in items], 0.8, 5)
    docs = []
    for k in range(400):
        filler = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 300))]
        item = items[k % 60]
        part = edited(item, rng.randint(0, int(0.2 * len(item)))) if k % 2 else edited(item, int(0.5 * len(item)))
        at = rng.randint(0, len(filler))
        docs.append(filler[:at] + part + filler[at:])
    hits = {(r[0], r[1]): r for r in decontamination.find_hits(block, pa.array([" ".join(d) for d in docs], pa.large_string()), 0.8, 3)}
    truth = {(k, i) for k, d in enumerate(docs) for i in [k % 60] if slow_distance(items[i], d) <= 0.2 * len(items[i]) + 1e-9}
    assert set(hits) <= {(k, i) for k, i in hits if slow_distance(items[i], docs[k]) == hits[k, i][2] <= 0.2 * len(items[i]) + 1e-9}
    assert len(truth) >= 200
    assert len(truth & set(hits)) / len(truth) >= 0.97


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 12, 15, 19, 20, 24, 25, 30])
def test_recall_by_length(n):
    """Items at no and at all allowed edits, anywhere in a longer text; short ones are all found."""
    items = [[rng.choice(VOCABULARY) for _ in range(n)] for _ in range(40)]
    block = decontamination.build_items(list(range(40)), [" ".join(w) for w in items], 0.8, 5)
    docs = []
    for k in range(200):
        filler = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(filler))
        docs.append(filler[:at] + edited(items[k % 40], n // 5 if k % 2 else 0) + filler[at:])
    hits = {(r[0], r[1]): r[2] for r in decontamination.find_hits(block, pa.array([" ".join(d) for d in docs], pa.large_string()), 0.8, 3)}
    truth = {(k, k % 40): slow_distance(items[k % 40], d) for k, d in enumerate(docs)}
    assert all(hits[k] == truth[k] for k in set(hits) & set(truth))
    found = len(set(hits) & set(truth)) / len(truth)
    assert found == 1 if n < decontamination.SHORT else found >= 0.97


def test_contaminated_rows(spark):
    item = "The quick, brown fox jumps over the lazy dog and then it sleeps all day."
    bench = spark.createDataFrame([(1, item, 0), (2, item, 0), (3, None, 0), (4, "", 0), (5, "the dog", 0)], "item_id long, text string, doc_id int")
    texts = [None, "", item, f"x y {item.upper()} z the end. " + item, "the dog sleeps", "word " * 50000 + item, "the " * 500]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(2, item, 9), (None, item, 9)], "doc_id long, text string, item_id int")
    found = decontamination.contaminated(docs, bench)
    got = sorted(((r["doc_id"] or -1, r["item_id"], r["edits"], r["first_word"], r["last_word"]) for r in found.collect()))
    place = {-1: 0, 2: 0, 3: 2, 5: 50000}
    assert got == sorted((d, i, 0, place[d], place[d] + 14) for d in (-1, 2, 2, 3, 5) for i in (1, 2))
    small = decontamination.contaminated(docs, bench, block_bytes=10)
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in small.collect()) == [(d, i) for d, i, *_ in got]
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_pipeline_decisions(spark, tmp_path):
    import corpus_pipeline

    def prose(n):
        return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."

    clean = [prose(80) for _ in range(60)]
    leak, copy = prose(30), prose(90)
    rows = list(enumerate(clean)) + [(100, copy), (101, copy + " "), (102, copy.replace(" ", "  ")), (102, copy.replace(" ", "  ")), (103, clean[0] + "\n" + leak)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(60).split())) for i in range(20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 7) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60)] + [(200 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), schema)
        ids.append(sorted(r["doc_id"] for r in kept.collect()))
    quality, exact, near, final = ids
    assert [i for i in quality if i >= 200] == [] and set(range(60)) <= set(quality)
    assert exact == [*range(60), 102, 103]
    assert set(range(60)) | {102} <= set(near)
    assert final == [*range(60), 102]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in pieces.where(F.col("piece") == 0).collect()) == final


def test_pipeline_keeps_copies_at_the_quality_cut(spark, tmp_path):
    """Rows that repeat id and text stay together: not one of them is lost because another was not drawn."""
    import corpus_pipeline

    def prose(n):
        return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."

    rows = [(i, prose(60)) for i in range(40)] + [(100 + i, prose(40).upper() + " !!! " * 20) for i in range(40)]
    rows += [r for r in rows for _ in range(2)] + [(None, None), (7, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).collect()
    seen = {}
    for r in kept:
        seen[r["doc_id"], r["text"]] = seen.get((r["doc_id"], r["text"]), 0) + 1
    assert {k for k in seen if k[1]} >= set(rows[:40]) and all(n == rows.count(k) for k, n in seen.items())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
