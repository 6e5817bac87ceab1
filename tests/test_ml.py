import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.operators import cluster, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_reduce_dims_variance_order_and_kmeans_nearest_centre(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    r = vectors.reduce_dims(e, "embedding", 10).cache()
    first = r.first()["reduced"]
    assert len(first) == 10
    var = r.select([F.variance(F.col("reduced")[i]).alias(f"v{i}") for i in range(10)]).first()
    v = [var[f"v{i}"] for i in range(10)]
    assert all(v[i] >= v[i + 1] - 1e-12 for i in range(9))  # principal components by variance
    labelled, centers = cluster.assign_events(r, "reduced", 6, with_centers=True)
    c = np.array(centers)
    for row in labelled.collect():
        x = np.array(row["reduced"])
        d = ((c - x) ** 2).sum(1)
        assert d[row["event_id"]] <= d.min() + 1e-9  # every row sits with its nearest centre


def test_kmeans_caps_k_at_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "id long, v array<double>")
    out = cluster.assign_events(df, "v", 120)
    assert out.select("event_id").distinct().count() <= 3


def blobs(n, k=8, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = 10 * rng.standard_normal((k, dim))
    return centres[rng.integers(0, k, n)] + rng.standard_normal((n, dim))


@pytest.mark.parametrize("fit_rows,key", [(20_000, None), (300, "id"), (300, None)])
def test_kmeans_labels_do_not_depend_on_partitions(spark, fit_rows, key):
    points = blobs(2000)
    points[:600] = points[0]  # one vector as a third of the rows
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    found = []
    for parts in (1, 8, 60):
        centres, grid = cluster.keyed_kmeans(df.repartition(parts), "v", 8, key=key, fit_rows=fit_rows)
        found.append((centres.tolist(), grid.unit))
    assert found[0] == found[1] == found[2] and len(found[0][0]) == 8
    labels = [{r["id"]: r["event_id"] for r in cluster.assign_events(df.repartition(p), "v", 8, key=key).collect()} for p in (1, 60)]
    assert labels[0] == labels[1]


def test_kmeans_is_about_as_tight_as_plain_lloyd_and_finds_a_far_small_group(spark):
    points = np.vstack([blobs(3000, seed=1), 500 + np.random.default_rng(1).standard_normal((4, 6))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>").repartition(5)
    centres, grid = cluster.keyed_kmeans(df, "v", 9, key="id", fit_rows=200)
    cost = cluster.Grid.squares(points, centres * grid.unit).min(1).sum()
    whole, even = np.rint(points * 1024), np.ones(len(points))
    tries = [cluster._lloyd(whole, even, cluster._first_centres(whole, even, 9, np.random.default_rng(i)), 1.0) for i in range(5)]
    best = min(cluster.Grid.squares(whole, c).min(1).sum() for c in tries) / 1024**2
    assert cost <= 1.3 * best
    near = cluster.Grid.squares(points[-4:], centres * grid.unit).argmin(1)
    assert len(set(near)) == 1 and (cluster.Grid.squares(points[:-4], centres * grid.unit).argmin(1) != near[0]).all()


def test_kmeans_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [5.0, 1.0])], "id long, v array<double>")
    assert {r["id"]: r["event_id"] is None for r in cluster.assign_events(df, "v", 2).collect()} == {1: False, 2: True, 3: False}
    assert cluster.assign_events(df.limit(0), "v", 2).count() == 0


def _silhouette(points, labels):
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        means = {c: far[i][(labels == c) & (np.arange(len(points)) != i)].mean() if ((labels == c) & (np.arange(len(points)) != i)).any() else None for c in set(labels)}
        a, b = means.pop(own), min(means.values())
        out.append(0.0 if a is None else (b - a) / max(a, b))
    return float(np.mean(out))


def test_sampled_silhouette_is_within_its_bound_and_exact_for_small_clusters(spark):
    points = blobs(1200, 5, 4, seed=4)
    labels = np.append(np.random.default_rng(4).integers(0, 5, 1199), 9)  # and a cluster of one row
    labels[:900] = cluster.Grid.squares(points[:900], points[900:905]).argmin(1)
    df = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, labels))], "id long, v array<double>, label long").repartition(4)
    want = _silhouette(points, labels)
    bounds = []
    for most in (40, 150, 10_000):
        got = cluster.silhouette_sampled(df, "id", "v", "label", per_label=most).first()
        assert abs(got["silhouette"] - want) <= got["error_bound"] + 1e-9 and got["num_rows"] == 1200
        bounds.append(got["error_bound"])
    assert bounds[0] > bounds[1] > bounds[2] and bounds[2] < 1e-12
    assert cluster.silhouette_exact(df, "id", "v", "label", block_rows=100).first()[0] == pytest.approx(want, abs=1e-8)
    assert cluster.silhouette_sampled(df.where("label = 9"), "id", "v", "label").first()["silhouette"] == 0


def test_exact_silhouette_sends_points_to_a_bounded_number_of_blocks(spark, monkeypatch):
    # a point was sent to every block of the table, so what is shuffled grew with the square of the rows
    points = blobs(900, 4, 3, seed=5)
    labels = np.random.default_rng(5).integers(0, 4, 900)
    df = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, labels))], "id long, v array<double>, label long").repartition(3)
    monkeypatch.setattr(cluster, "SILHOUETTE_BLOCKS", 5)
    monkeypatch.setattr(cluster, "SILHOUETTE_CELLS", 1000)
    seen = spark.sparkContext.accumulator(0)
    plain = cluster._block_distance_sums

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield from plain([pdf])

    monkeypatch.setattr(cluster, "_block_distance_sums", counted)
    got = cluster.silhouette_exact(df, "id", "v", "label", block_rows=20).first()[0]
    assert got == pytest.approx(_silhouette(points, labels), abs=1e-8)
    assert seen.value == 45 * 5  # 45 blocks of 20 rows, each with 5 of 180


def test_points_are_read_and_packed_whole():
    import pyarrow as pa

    listed = [[1.5, -2.0, 8.0], [0.0, 3.25, -8.0]]
    column = pa.array([[9.0] * 3, *listed], pa.list_(pa.float64())).slice(1)
    assert cluster._points(column).tolist() == cluster._points(pa.chunked_array([column])).tolist() == listed
    with pytest.raises(ValueError):
        cluster._points(pa.array([[1.0], [1.0, 2.0, 3.0]]))
    grid = cluster.Grid(8.0, 3)
    batch = pa.RecordBatch.from_arrays([column, pa.array([1, 2])], names=["v", "w"])
    (packed,) = cluster._packed(grid)([batch])
    assert (cluster._unpacked(packed.column("p").slice(1)) == grid.on(np.array(listed[1:]))).all()
    assert packed.column("w").to_pylist() == [1, 2]


def test_encoder_is_loaded_once_per_worker_in_bounded_batches(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def encode(texts):
            assert len(texts) <= 16
            return [[len(t), t.count("a")] for t in texts]

        return encode

    df = spark.range(500).selectExpr("id", "if(id % 50 = 0, null, repeat('ab', cast(id % 9 AS int))) AS t").repartition(6)
    rows = vectors.embed_text(df, "t", load, batch=16).collect()
    assert all(r["embedding"] == [len(r["t"] or ""), (r["t"] or "").count("a")] for r in rows) and len(rows) == 500
    loads = [f.split("-")[1] for f in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 6  # one per worker process


def test_trained_projection_keeps_topics_apart(spark):
    words = [["fire", "smoke", "burn"], ["flood", "river", "rain"]]
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 2], 8))) for i in range(200)], "id long, t string")
    encoder = vectors.train_projection(df, "t", width=2, dim=64)
    got = {r["id"]: r["embedding"] for r in vectors.embed_text(df, "t", encoder).collect()}
    points = np.array([got[i] for i in range(200)])
    assert points.shape == (200, 2) and ((points[::2] @ points[0] > 0).all() and (points[1::2] @ points[0] < points[::2].mean(0) @ points[0]).all())


def test_vectors_of_the_pipeline_are_those_of_the_long_table(spark):
    df = spark.createDataFrame([(1, "fire fire river the"), (2, "river rain"), (3, ""), (4, None)], "id long, t string")
    dense = {r["id"]: r["embedding"] for r in vectors.text_vectors(df, "t", 32).collect()}
    long = {(r["id"], r["bucket"]): r["weight"] for r in vectors.hashed_tfidf(df, "id", "t", 32).collect()}
    assert all(dense[i][b] == w for (i, b), w in long.items()) and sum(map(bool, dense[1])) == len([1 for i, _ in long if i == 1])
    assert dense[3] == dense[4] == [0.0] * 32


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_vector_and_its_length_are_computed_once_for_all_its_elements(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [])], "id long, v array<double>")
    out = df.select("id", vectors.l2_normalize(F.col("v")).alias("u"))
    assert {r["id"]: r["u"] for r in out.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: [1.0, None], 5: []}
    assert _plan(out).count("aggregate(") == 1


def test_tfidf_is_linear_in_the_buckets_and_bit_for_bit_that_of_the_expressions(spark):
    rng = np.random.default_rng(4)
    words = ["the", "a", "x", "élan", "ab", *[f"w{i}" for i in range(60)]]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(300)] + [(300, None), (301, "  "), (302, "a the")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    counted = vectors.bucket_counts(df, "t", 16, out="tf")
    tf = {r["id"]: r["tf"] for r in counted.collect()}
    terms = vectors.doc_terms(df, "id", "t").groupBy("id", vectors.term_bucket(F.col("term"), 16).alias("b")).count()
    assert {(i, b): n for i, row in tf.items() for b, n in enumerate(row) if n} == {(r["id"], r["b"]): r["count"] for r in terms.collect()}
    idf = [0.0, *np.log(rng.uniform(1, 9, 15)).tolist()]
    plain = F.zip_with("tf", F.array(*map(F.lit, idf)), lambda n, w: n.cast("double") * w)
    both = counted.select(vectors.tfidf_unit("tf", idf).alias("x"), vectors.l2_normalize(plain).alias("y"))
    assert both.where("x <> y").count() == 0 and both.count() == 303
    long = vectors.hashed_tfidf(df, "id", "t", 16)
    assert "zip_with" not in _plan(long) and "zip_with" not in _plan(vectors.text_vectors(df, "t", 16))
    assert long.count() == sum(n > 0 for row in tf.values() for n in row)
    assert vectors.text_vectors(df, "t", 16, keep=["id"]).columns == ["id", "embedding"]


def test_sums_of_a_round_are_whole_and_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points, weights = rng.integers(-(2**22), 2**22, (500, 3)), rng.integers(1, 2**20, 500)
    centres = points[:7].astype(float)
    rows = [(p.astype("<i4").tobytes(), int(w)) for p, w in zip(points, weights)]
    packed = spark.createDataFrame(rows, "p binary, w long").repartition(9)
    near = cluster.Grid.squares(points.astype(float), centres).argmin(1)
    assert (cluster.Grid.nearest(points.astype(float), centres, 64) == near).all()
    want = np.array([[weights[near == c].sum(), *(points * weights[:, None])[near == c].sum(0)] for c in range(7)])
    assert (cluster._totals(packed, centres) == want).all()
    monkeypatch.setattr(cluster, "DIRECT_PARTS", 2)
    assert (cluster._totals(packed, centres) == want).all()
