"""Cluster merging against a brute-force model (reachability closure) on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from eventlens.operators import graph, rows, vectors


def brute_merge(labels, vecs, k=4, q=0.9, floor=10, frac=0.001):
    labels = np.asarray(labels)
    n = len(labels)
    uniq, counts = np.unique(labels, return_counts=True)
    min_size = max(floor, int(n * frac))
    valid = sorted(u for u, c in zip(uniq, counts) if c >= min_size)
    code = {u: i for i, u in enumerate(valid)}
    cent = []
    for u in valid:
        m = vecs[labels == u].mean(axis=0)
        cent.append(m / np.linalg.norm(m))
    cent = np.array(cent)
    sims = np.round(cent @ cent.T, 9)
    edges = []
    for i in range(len(valid)):
        others = sorted((j for j in range(len(valid)) if j != i), key=lambda j: (-sims[i, j], j))[:k]
        edges += [(i, j, sims[i, j]) for j in others]
    thr = np.quantile([e[2] for e in edges], q) if edges else math.nan
    # reachability closure of the strong edges; a component's id is the rank of its smallest member
    reach = np.eye(len(valid), dtype=bool)
    for i, j, s in edges:
        if s > round(thr, 9):
            reach[i, j] = reach[j, i] = True
    for _ in valid:
        reach = reach @ reach
    smallest = reach.argmax(axis=1)
    final = np.searchsorted(np.unique(smallest), smallest)
    return {idx: int(final[code[l]]) for idx, l in enumerate(labels) if l in code}


def synthetic(seed=7):
    rng = np.random.default_rng(seed)
    sizes = [12, 15, 10, 11, 20, 13, 10, 14, 16, 10, 18, 9]  # eleven clusters of >= 10 rows, one of nine
    angles = rng.uniform(0, 2 * np.pi, len(sizes))
    labels, vecs = [], []
    for lab, (sz, a) in enumerate(zip(sizes, angles)):
        pts = np.c_[np.cos(a), np.sin(a)] + rng.normal(0, 0.05, (sz, 2))
        labels += [lab * 3] * sz  # sparse label values: dense codes must renumber them
        vecs.append(pts)
    return np.array(labels), np.vstack(vecs)


def test_merge_events_matches_brute_force(spark):
    labels, vecs = synthetic()
    data = [(i, int(l), [float(x) for x in v]) for i, (l, v) in enumerate(zip(labels, vecs))]
    df = spark.createDataFrame(data, "row_id long, label long, vec array<double>")
    got = {r["row_id"]: r["event_id"] for r in graph.merge_events(df, "label", "vec").collect()}
    want = brute_merge(labels, vecs)
    assert got == want
    assert sorted(set(got.values())) == list(range(len(set(want.values()))))
    assert all(labels[i] != 33 for i in got)  # the nine-row cluster is removed


def test_merge_is_partition_invariant(spark):
    labels, vecs = synthetic(11)
    data = [(i, int(l), [float(x) for x in v]) for i, (l, v) in enumerate(zip(labels, vecs))]
    df = spark.createDataFrame(data, "row_id long, label long, vec array<double>")
    a = sorted(graph.merge_events(df.repartition(1), "label", "vec").select("row_id", "event_id").collect())
    b = sorted(graph.merge_events(df.repartition(8), "label", "vec").select("row_id", "event_id").collect())
    assert a == b


def edges_df(spark, triples):
    return spark.createDataFrame(triples, "src long, dst long, sim double")


def test_chain_merges_and_strict_threshold(spark):
    # eleven directed similarities 0.0..1.0: the 0.9 quantile is exactly 0.9
    sims = [round(0.1 * i, 9) for i in range(11)]
    triples = [(10 + i, 20 + i, s) for i, s in enumerate(sims[:-1])] + [(1, 2, 1.0)]
    e = edges_df(spark, triples)
    assert graph.adaptive_threshold(e).collect()[0]["threshold"] == 0.9
    strong = graph.strong_edges(e)
    assert sorted((r.src, r.dst) for r in strong.collect()) == [(1, 2)]  # 0.9 itself stays apart
    nodes = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5]], "id long")
    chain = edges_df(spark, [(1, 2, 0.95), (2, 3, 0.95), (5, 4, 0.95)])
    comp = {r.id: r.component for r in graph.connected_components(nodes, chain).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    ren = {r.id: r.event_id for r in graph.renumber_components(graph.connected_components(nodes, chain)).collect()}
    assert ren == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_three_clusters_two_neighbours_each(spark):
    cent = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "cid long, unit array<double>"
    )
    e = vectors.knn_edges(cent, "cid", "unit", 4).collect()
    per = {}
    for r in e:
        per.setdefault(r.src, []).append(r.dst)
    assert {k: len(v) for k, v in per.items()} == {0: 2, 1: 2, 2: 2}


def test_knn_blocked_equals_single_block(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(23, 5))
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    cent = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "cid long, unit array<double>")
    one = sorted(tuple(r) for r in vectors.knn_edges(cent, "cid", "unit", 4, block_rows=2048).collect())
    many = sorted(tuple(r) for r in vectors.knn_edges(cent, "cid", "unit", 4, block_rows=4).collect())
    assert one == many
    sims = np.round(v @ v.T, 9)
    for i in range(len(v)):
        want = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-sims[i, j], j))[:4]
        got = [r[1] for r in sorted((r for r in one if r[0] == i), key=lambda r: r[3])]
        assert got == want


def test_dense_codes_and_quantile(spark):
    df = spark.createDataFrame([(k,) for k in [5, 3, 9, 3, 100, -2, 7, 5]], "k long").repartition(4)
    a = sorted(rows.dense_codes(df, "k", "c").collect())
    assert [r.k for r in a] == [-2, 3, 5, 7, 9, 100] and [r.c for r in a] == list(range(6))
    vals = [0.3, 0.1, 0.9, 0.9, 0.5, 0.7, 0.2]
    v = spark.createDataFrame([(x,) for x in vals], "sim double").repartition(3)
    for q in (0.0, 0.5, 0.9, 1.0):
        got = rows.exact_quantile(v, "sim", q).collect()[0]["sim"]
        assert abs(got - float(np.quantile(vals, q))) < 1e-12
    empty = spark.createDataFrame([], "sim double")
    assert rows.exact_quantile(empty, "sim", 0.9).collect()[0]["sim"] is None


def test_components_of_random_graphs_against_reachability(spark):
    rng = np.random.default_rng(3)
    for n, m in ((60, 30), (60, 60), (40, 150)):
        pairs = rng.integers(0, n, (m, 2)) * 7  # sparse ids, self loops and repeats among them
        reach = np.eye(n, dtype=bool)
        for a, b in pairs // 7:
            reach[a, b] = reach[b, a] = True
        for _ in range(7):
            reach = reach @ reach
        edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long").repartition(3)
        got = graph.connected_components(spark.range(n).selectExpr("id * 7 AS id"), edges).collect()
        assert {r["id"]: r["component"] for r in got} == {i * 7: int(reach[i].argmax()) * 7 for i in range(n)}


def test_hubs_and_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    count = graph._print
    monkeypatch.setattr(graph, "_print", lambda e: (rounds.append(e.count()), count(e))[1])
    star = spark.range(0, 199_999).selectExpr("id AS src", "199999L AS dst")
    found = graph.connected_components(spark.range(200_000), star)
    assert found.where("component = 0").count() == 200_000 and len(rounds) <= 5
    rounds.clear()
    chain = spark.range(0, 9999).selectExpr("pmod(id * 48271, 10007) AS src", "pmod((id + 1) * 48271, 10007) AS dst")
    found = graph.connected_components(spark.range(10_007), chain)
    assert found.groupBy("component").count().count() == 8 and len(rounds) <= 20
    assert all(a >= b for a, b in zip(rounds, rounds[1:]))  # edges never grow


def test_components_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in graph.connected_components(spark.range(2), none).orderBy("id").collect()] == [(0, 0), (1, 1)]
    assert graph.connected_components(spark.range(0), none).count() == 0
