"""Ranked search against scoring every document for every query."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from eventlens.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def slow(docs, queries, k):
    bags = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in queries:
        hits = []
        for doc, bag, n in bags:
            m = 100 - 50 + (50 * n * n_docs) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                for t in set(split(text)) if bag[t]
            )
            if score > 0:
                hits.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(hits, key=lambda h: h[:3])[:k])]
    return sorted(out, key=str)


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "x_y", "東京", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 60)))) for i in range(n)]


def found(spark, docs, queries, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(map(tuple, rs.ranked_search(d, q, **kw).collect()), key=str)


@pytest.mark.parametrize("segment,block", [(10**6, 64), (1500, 4)])
def test_against_scoring_all(spark, segment, block):
    docs = corpus(700) + [(900, None), (901, ""), (902, " .,!"), (903, "w250 W250 w250")] + [(904, "w7 w8 w260")] * 30
    queries = [(i, t) for i, t in corpus(12, 5)] + [(50, "w250 w260"), (51, None), (52, "unknown"), (53, "W1 w1 été")]
    assert found(spark, docs, queries, k=20, segment=segment, block=block) == slow(docs, queries, 20)


def test_queries_in_several_blocks_and_repeated_queries(spark):
    docs, queries = corpus(200), corpus(9, 3) + [(3, "w1 w2")] * 2
    got = found(spark, docs, queries, k=5, query_bytes=200)
    assert got == slow(docs, queries, 5)


def test_ties_null_ids_very_long_text_and_empty_tables(spark):
    docs = [(i % 7, "same words here") for i in range(40)] + [(None, "same words here")] * 3 + [(99, "long " * 300_000 + "rare")] + [(i, "other") for i in range(100, 160)]
    queries = [(1, "same words"), (2, "rare long")]
    assert found(spark, docs, queries, k=42) == slow(docs, queries, 42)
    assert found(spark, [], queries) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], queries) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, row long, seg long")
    queries = spark.createDataFrame([(4, "a", 1)], "item_id long, text string, query long")
    assert len(rs.ranked_search(docs, queries).collect()) <= 1


def test_blocks_are_skipped_and_bounds_hold():
    """Of 4000 documents in topics, a topical query scores few; every summary is the greatest impact of its block."""
    rng = np.random.default_rng(1)
    topics = rng.integers(0, 20, 4000)
    rows = [np.unique(np.concatenate([rng.integers(0, 30, 12), 30 + t * 40 + rng.integers(0, 40, 15)])) for t in topics]
    n_terms = 30 + 20 * 40
    df = np.bincount(np.concatenate(rows), minlength=n_terms)
    rank = np.empty(n_terms, np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(n_terms)
    weight = np.floor(1000 * np.log((2 * 4000 + 2) / (2 * np.sort(df)[::-1] + 1))).astype(np.int64)
    table = pa.table({
        "doc_id": pa.array(np.arange(4000)), "n": pa.array(np.full(4000, 27)),
        "terms": pa.array([r.astype(np.int32) for r in rows]), "tfs": pa.array([np.ones(len(r), np.int32) for r in rows]),
    })
    index = rs.indexed(4000, 4000 * 27, rank, weight, 64)((pa.scalar(0),), table)
    segment = rs.Segment(index, n_terms)
    dense = np.zeros((4000, n_terms), np.int64)
    dense[np.repeat(np.arange(4000), segment.per), segment.codes] = segment.impacts
    for b in range(0, len(segment.size), 97):
        term = index.filter(pa.compute.greater_equal(index["term"], 0))["term"][b].as_py()
        docs = segment.members[segment.begin[b] : segment.begin[b] + segment.size[b]]
        want = dense[docs][:, : term + 1].max(0)
        at = slice(segment.sum_at[b], segment.sum_at[b] + segment.width[b])
        over = segment.sum_impacts[at] - want[segment.sum_codes[at]]
        assert (over >= 0).all() and (over < rs.UNIT).all() and (want > 0).sum() == segment.width[b]
    query = np.sort(rank[30 + 5 * 40 + np.arange(8)])
    place, score = segment.best(query, weight[query], 10)
    every = dense[:, query] @ weight[query]
    assert list(score) == sorted(every.tolist(), reverse=True)[:10] and list(every[place]) == list(score)
    assert segment.scored < (every > 0).sum()
