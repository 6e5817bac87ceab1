"""Initial clustering (J3), whatever the partitioning, and the silhouette score (J4): Spark ML, plus an exact blocked form."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.operators.rows import dense_codes
from eventlens.session import discard, materialize

# Clusters per pipeline and seed.
COVID_CLUSTERS = 120
SENTIMENT_CLUSTERS = 200
SEED = 42
KMEANS_REL_TOL = 1e-4


#: Rows that the first centres are fitted on, drawn by hash; all rows then correct them.
FIT_ROWS = 20_000
MAX_ROUNDS = 300


def _points(column) -> np.ndarray:
    """A matrix of an Arrow list column without nulls, from its buffer: no value becomes a Python number."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Grid:
    """Vectors as whole numbers, so small that their distances are exact in doubles, whatever the order of summing."""

    def __init__(self, most: float, dim: int):
        bits = (50 - int(np.ceil(np.log2(max(2, dim))))) // 2
        self.unit = (most or 1.0) / (1 << (bits - 1))

    def on(self, vectors: np.ndarray) -> np.ndarray:
        return np.rint(vectors / self.unit)

    @staticmethod
    def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (points**2).sum(1)[:, None] - 2.0 * (points @ centres.T) + (centres**2).sum(1)[None]

    @staticmethod
    def nearest(points: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
        """The place of each point's nearest centre, the first of equals; a point's own square moves all its distances alike and is left out."""
        turn, own = -2.0 * centres.T, (centres**2).sum(1)
        near = np.empty(len(points), np.int64)
        for i in range(0, len(points), step):
            far = points[i : i + step] @ turn
            far += own
            near[i : i + step] = far.argmin(1)
        return near


def _moved(total: list[int], count: int) -> np.ndarray:
    """A mean of whole numbers, rounded to one: the same for the same rows."""
    return np.array([float((2 * t + count) // (2 * count)) for t in total])


def _lloyd(points: np.ndarray, weights: np.ndarray, centres: np.ndarray, tol: float) -> np.ndarray:
    """Weighted Lloyd rounds on few points, in memory."""
    weighed = weights[:, None] * points
    for _ in range(MAX_ROUNDS):
        near = Grid.nearest(points, centres)
        order = np.argsort(near, kind="stable")
        there, first = np.unique(near[order], return_index=True)
        # whole numbers: exact below 2^53
        total, count = np.add.reduceat(weighed[order], first), np.add.reduceat(weights[order], first)
        new = centres.copy()
        for c, t, n in zip(there, total, count):
            new[c] = _moved([int(x) for x in t], int(n))
        shift = ((new - centres) ** 2).sum()
        centres = new
        if shift <= tol:
            break
    return centres


def _first_centres(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over weighted points; fewer centres if there are fewer distinct points."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    near = Grid.squares(points, points[chosen])[:, 0]
    while len(chosen) < k and near.max() > 0:
        mass = weights * near
        chosen.append(int(rng.choice(len(points), p=mass / mass.sum())))
        near = np.minimum(near, Grid.squares(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _packed(grid: Grid):
    """mapInArrow function: points on the grid as bytes of 32-bit whole numbers (a grid has at most 24 bits), which every round reads."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                points = grid.on(_points(batch.column("v"))).astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in points], pa.binary()), batch.column("w")], names=["p", "w"])

    return run


def _unpacked(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<i4").reshape(len(column), -1).astype(np.int64)


def _sums(centres: np.ndarray):
    """mapInArrow function: per centre, the number of its rows and their sums, in whole numbers; one row of bytes a partition."""

    def run(batches):
        total = np.zeros((len(centres), 1 + centres.shape[1]), np.int64)
        for batch in batches:
            if batch.num_rows:
                points, weight = _unpacked(batch.column("p")), batch.column("w").to_numpy()
                near = Grid.nearest(points.astype(np.float64), centres)
                order = np.argsort(near, kind="stable")
                there, first = np.unique(near[order], return_index=True)
                total[there, 0] += np.add.reduceat(weight[order], first)
                total[there, 1:] += np.add.reduceat((points * weight[:, None])[order], first)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return run


def _added(batches):
    """mapInArrow function: the sum of tables of whole numbers of one shape, given as bytes."""
    total = None
    for batch in batches:
        for s in batch.column("s").to_pylist():
            total = np.frombuffer(s, np.int64) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])


#: Partitions whose sums (a few kilobytes each) reach the driver as they are; those of more are added in tasks first.
DIRECT_PARTS = 256


def _totals(packed: DataFrame, centres: np.ndarray) -> np.ndarray:
    """(rows, sums...) per centre, over all rows; nothing is shuffled but, with many partitions, a row of each."""
    parts = packed.mapInArrow(_sums(centres), "s binary")
    if (n := packed.rdd.getNumPartitions()) > DIRECT_PARTS:
        parts = parts.repartition(int(n**0.5)).mapInArrow(_added, "s binary")
    total = np.zeros((len(centres), 1 + centres.shape[1]), np.int64)
    for r in parts.collect():  # a table of a row per centre each
        total += np.frombuffer(r["s"], np.int64).reshape(total.shape)
    return total


def keyed_kmeans(df: DataFrame, vec_col: str, k: int, seed: int = SEED, key: str | None = None, fit_rows: int = FIT_ROWS):
    """J3's centres, the same for the same rows under any partitioning; returns (centres on the grid, grid).

    Rows are drawn by a hash of ``key`` (by default of the vector), and coordinates are rounded to a grid
    on which sums and distances are exact, so no order of adding matters. First centres: k-means++ and
    Lloyd rounds on ``fit_rows`` drawn rows; 2 k more rows, drawn from all by squared distance, join
    them as candidates, weighted by the rows nearest to each (a far group too small for the draw is
    found this way). Then Lloyd rounds over all rows, one aggregate each, until the centres' squared
    shift is within the tolerance, which is relative to the mean variance, as in the reference.
    """
    rows = df.select(F.col(vec_col).cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), F.col(key) if key else F.col(vec_col)).alias("h")).where("v is not null")
    # without a key equal vectors have one hash, so they are one row with a weight
    rows = rows.withColumn("w", F.lit(1).cast("long")) if key else rows.groupBy("v", "h").agg(F.count(F.lit(1)).alias("w"))
    rows = materialize(rows, "kmeans-rows")
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), largest.alias("most"), F.max(F.size("v")).alias("dim")).first()
    n, dim = stats["n"], stats["dim"]
    if not n:
        return np.zeros((0, 0)), Grid(1.0, 1)
    grid, rng = Grid(stats["most"], dim), np.random.default_rng(seed)
    packed = materialize(rows.mapInArrow(_packed(grid), "p binary, w long"), "kmeans-points")
    share = 1.0 if n <= fit_rows else fit_rows / n
    drawn = rows if share == 1.0 else rows.where(F.col("h") < int(2**64 * share) - 2**63)
    some = drawn.orderBy("h", "v").select("v", "w").toArrow()
    points, weights = grid.on(_points(some["v"])), some["w"].to_numpy().astype(np.float64)
    mean = (weights[:, None] * points).sum(0) / weights.sum()
    tol = KMEANS_REL_TOL * float(((weights[:, None] * (points - mean) ** 2).sum(0) / weights.sum()).mean())
    centres = _lloyd(points, weights, _first_centres(points, weights, k, rng), tol)
    if share < 1.0:
        centres = _with_far_rows(rows, packed, grid, centres, k, rng, tol)
    centres = centres[np.lexsort(centres.T[::-1])]
    for _ in range(MAX_ROUNDS):
        totals = _totals(packed, centres)
        new = centres.copy()
        for c in np.flatnonzero(totals[:, 0]):
            count, *total = totals[c].tolist()
            new[c] = _moved(total, count)
        shift = ((new - centres) ** 2).sum()
        centres = new
        if shift <= tol:
            break
    discard(rows)
    discard(packed)
    return centres, grid


def _with_far_rows(rows: DataFrame, packed: DataFrame, grid: Grid, centres: np.ndarray, k: int, rng: np.random.Generator, tol: float) -> np.ndarray:
    """Centres refitted with 2 k rows drawn by squared distance, exactly and by hash, from all rows."""

    def far(batches):
        for batch in batches:
            points = grid.on(_points(batch.column("v"))) if batch.num_rows else np.zeros((0, centres.shape[1]))
            square = Grid.squares(points, centres).min(1)
            u = (batch.column("h").to_numpy().astype(np.float64) + 2.0**63 + 0.5) / 2.0**64
            mass = square * batch.column("w").to_numpy()
            wait = np.where(mass > 0, -np.log(u) / np.maximum(mass, 1), np.inf)  # the least of these: a draw by weight
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("h"), pa.array(wait)], names=["v", "h", "wait"])

    found = rows.mapInArrow(far, "v array<double>, h long, wait double").where(F.col("wait") < float("inf"))
    more = found.orderBy("wait", "h", "v").limit(2 * k).select("v").toArrow()["v"]
    if not len(more):
        return centres
    points = np.unique(np.vstack([centres, grid.on(_points(more))]), axis=0)
    weights = _totals(packed, points)[:, 0].astype(np.float64)
    held = weights > 0
    points, weights = points[held], weights[held]
    return _lloyd(points, weights, _first_centres(points, weights, k, rng), tol)


def assign_events(
    df: DataFrame, vec_col: str, k: int, seed: int = SEED, out: str = "event_id", with_centers: bool = False, key: str | None = None
):
    """K-means; every row with its nearest centre, the same labels under any partitioning (``keyed_kmeans``).

    ``k`` is an upper bound: no more centres than distinct vectors. With ``with_centers`` also
    returns the centres (k x dim, bounded by k). A null vector gets a null label.
    """
    centres, grid = keyed_kmeans(df, vec_col, k, seed, key)

    @F.pandas_udf("long")
    def nearest(vectors: pd.Series) -> pd.Series:
        there = vectors.notna()
        label = pd.Series([None] * len(vectors), dtype="Int64")
        if there.any() and len(centres):
            points = grid.on(np.vstack(vectors[there].to_numpy()).astype(np.float64))
            label[there.to_numpy()] = Grid.squares(points, centres).argmin(1)
        return label

    res = df.withColumn(out, nearest(F.col(vec_col).cast("array<double>")))
    return (res, [(c * grid.unit).tolist() for c in centres]) if with_centers else res


def silhouette(df: DataFrame, vec_col: str, label_col: str, distance: str = "squaredEuclidean") -> float:
    """Mean silhouette with Spark's linear-cost evaluator (squaredEuclidean or cosine)."""
    v = df.select(array_to_vector(F.col(vec_col)).alias("_features"), F.col(label_col).cast("double").alias("_label"))
    ev = ClusteringEvaluator(featuresCol="_features", predictionCol="_label", metricName="silhouette",
                             distanceMeasure=distance)
    return float(ev.evaluate(v))


def silhouette_table(df: DataFrame, vec_col: str, label_col: str, distance: str = "squaredEuclidean") -> DataFrame:
    """J4 as a one-row DataFrame (the score is computed by a distributed job)."""
    spark = df.sparkSession
    value = silhouette(df, vec_col, label_col, distance)
    schema = T.StructType([T.StructField("distance", T.StringType()), T.StructField("silhouette", T.DoubleType())])
    return spark.createDataFrame([(distance, value)], schema).select(
        "distance", F.round("silhouette", 9).alias("silhouette")
    )


_PARTIAL_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("label", T.LongType()),
    T.StructField("other", T.LongType()), T.StructField("dsum", T.DoubleType()), T.StructField("cnt", T.LongType()),
])


def _block_distance_sums(batches):
    for pdf in batches:
        out = []
        for q_ids, q_labels, q_vecs, d_ids, d_labels, d_vecs in zip(
            pdf["q_ids"], pdf["q_labels"], pdf["q_vecs"], pdf["d_ids"], pdf["d_labels"], pdf["d_vecs"]
        ):
            di, dv, dl = np.asarray(d_ids), np.vstack(d_vecs).astype(np.float64), np.asarray(d_labels)
            labels, at = np.unique(dl, return_inverse=True)
            member = np.eye(len(labels))[at]  # one product gives every row's sums by label
            all_ids, all_labels, all_vecs, squares = np.asarray(q_ids), np.asarray(q_labels), np.vstack(q_vecs).astype(np.float64), (dv * dv).sum(1)
            step = max(1, SILHOUETTE_CELLS // len(di))
            for i in range(0, len(all_ids), step):
                qi, ql, qv = all_ids[i : i + step], all_labels[i : i + step], all_vecs[i : i + step]
                dist = np.sqrt(np.maximum((qv * qv).sum(1)[:, None] + squares[None, :] - 2.0 * qv @ dv.T, 0.0))
                counts = np.repeat(member.sum(0)[None, :], len(qi), 0)
                both = np.flatnonzero(np.isin(qi, di))
                if len(both):
                    itself = qi[both, None] == di[None, :]
                    dist[both] = np.where(itself, 0.0, dist[both])
                    counts[both] -= itself.astype(np.float64) @ member
                sums = dist @ member
                r, c = np.nonzero(counts)
                out.append(pd.DataFrame({"id": qi[r], "label": ql[r], "other": labels[c], "dsum": sums[r, c], "cnt": counts[r, c].astype(np.int64)}))
        yield pd.concat(out) if out else pd.DataFrame({"id": [], "label": [], "other": [], "dsum": [], "cnt": []})


#: Blocks that every point is sent to, about; rows of the largest such block; distances in memory at a time.
SILHOUETTE_BLOCKS, SILHOUETTE_BLOCK_ROWS, SILHOUETTE_CELLS = 48, 16_384, 4_000_000


def silhouette_exact(df: DataFrame, id_col: str, vec_col: str, label_col: str, block_rows: int = 1024) -> DataFrame:
    """J4 with plain Euclidean distance over all pairs (the reference's definition).

    Quadratic work, but never materialised as pair rows: points are packed in
    blocks of ``block_rows`` (dense ids, so every block is bounded), each is
    joined with all of the larger data blocks, and each pair emits per-point
    distance sums by cluster. There are about ``SILHOUETTE_BLOCKS`` data blocks,
    so what is shuffled grows with the points, until a data block would pass
    ``SILHOUETTE_BLOCK_ROWS``. Returns one row (silhouette).
    """
    codes = dense_codes(df, id_col, out="_pid")
    pts = df.join(codes, id_col).select(
        F.col("_pid").alias("pid"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"),
        F.floor(F.col("_pid") / F.lit(block_rows)).cast("long").alias("blk"),
    )
    n = (pts.agg(F.max("pid")).first()[0] or 0) + 1
    wide = block_rows * max(1, min(SILHOUETTE_BLOCK_ROWS, n // SILHOUETTE_BLOCKS) // block_rows)
    pack = lambda x, c: x.groupBy(c).agg(F.collect_list("pid").alias("ids"), F.collect_list("label").alias("labels"), F.collect_list("vec").alias("vecs"))
    q = pack(pts, "blk").select(
        F.col("ids").alias("q_ids"), F.col("labels").alias("q_labels"), F.col("vecs").alias("q_vecs"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // wide).cast("long"))).alias("d_blk"),
    )
    d = pack(pts.withColumn("d_blk", F.floor(F.col("pid") / F.lit(wide)).cast("long")), "d_blk").select(
        "d_blk", F.col("ids").alias("d_ids"), F.col("labels").alias("d_labels"), F.col("vecs").alias("d_vecs")
    )
    partial = q.join(d, "d_blk").drop("d_blk").mapInPandas(_block_distance_sums, _PARTIAL_SCHEMA)
    per = partial.groupBy("id", "label", "other").agg((F.sum("dsum") / F.sum("cnt")).alias("mean_d"))
    ab = per.groupBy("id", "label").agg(
        F.max(F.when(F.col("other") == F.col("label"), F.col("mean_d"))).alias("a"),
        F.min(F.when(F.col("other") != F.col("label"), F.col("mean_d"))).alias("b"),
    )
    # no own-cluster partner, no other cluster, or a == b == 0 (coincident points): score 0
    s = F.when(
        F.col("a").isNull() | F.col("b").isNull() | (F.greatest(F.col("a"), F.col("b")) <= 0), F.lit(0.0)
    ).otherwise((F.col("b") - F.col("a")) / F.greatest(F.col("a"), F.col("b")))
    # points alone in their cluster have no 'a' row at all: they score 0 but still count
    scores = pts.select(F.col("pid").alias("id")).join(ab.select("id", s.alias("s")), "id", "left")
    return scores.agg(F.round(F.avg(F.coalesce(F.col("s"), F.lit(0.0))), 9).alias("silhouette"))


SILHOUETTE_SAMPLE, SAMPLE_BYTES = 200, 64 << 20
Z_BOUND = 3.0  # standard errors that the bound covers


def silhouette_sampled(df: DataFrame, id_col: str, vec_col: str, label_col: str, per_label: int = SILHOUETTE_SAMPLE, seed: int = SEED) -> DataFrame:
    """J4, Euclidean, at linear cost: one row (silhouette, error_bound, num_rows, sampled).

    Every row is compared with a sample of each cluster (``per_label`` rows by hash, fewer if all samples
    would pass ``SAMPLE_BYTES``), whose mean distances estimate those to the whole clusters. The bound sums, over
    rows, how far ``Z_BOUND`` standard errors of the own and the nearest other mean can move the row's score;
    any other cluster that could be the nearest counts with its own error. A cluster that is sampled
    whole has none, so with small clusters the score is exact and the bound 0. Rows with a null
    vector or label are left out.
    """
    rows = df.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v")
    )
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # a number per cluster
    if len(sizes) < 2:
        return rows.agg(F.lit(0.0).alias("silhouette"), F.lit(0.0).alias("error_bound"), F.count(F.lit(1)).alias("num_rows"), F.lit(0).cast("long").alias("sampled"))
    dim = rows.select(F.size("v")).first()[0]
    most = max(2, min(per_label, SAMPLE_BYTES // (8 * dim * len(sizes))))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id"))
    drawn = rows.withColumn("_p", place).where(F.col("_p") <= most).drop("_p").orderBy("label", "id").toArrow()
    labels = np.array(sorted(sizes))
    own_ids, own, points = drawn["id"].to_numpy(), np.searchsorted(labels, drawn["label"].to_numpy()), _points(drawn["v"])
    total = np.array([sizes[x] for x in labels], np.float64)
    member = np.eye(len(labels))[own]

    def scores(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, at = _points(batch.column("v")), np.searchsorted(labels, batch.column("label").to_numpy())
            itself = batch.column("id").to_numpy()[:, None] == own_ids[None, :]
            far = np.sqrt(np.maximum(Grid.squares(v, points), 0.0))
            far[itself] = 0.0
            n = member.sum(0)[None, :] - itself @ member
            mean = np.divide(far @ member, n, out=np.full(n.shape, np.inf), where=n > 0)
            spread = np.divide((far**2) @ member, n, out=np.zeros(n.shape), where=n > 0) - np.where(n > 0, mean, 0) ** 2
            row = np.arange(len(v))
            whole = np.repeat(total[None, :], len(v), 0)
            whole[row, at] -= 1  # the others of its own cluster
            left = np.clip(1 - n / np.maximum(whole, 1), 0, 1)
            error = Z_BOUND * np.sqrt(np.maximum(spread, 0) / np.maximum(n - 1, 1) * left)
            a, ea = mean[row, at], error[row, at]
            others = mean.copy()
            others[row, at] = np.inf
            b = others.min(1)
            rivals = np.where(others - error <= (b + error[row, others.argmin(1)])[:, None], error, 0.0)
            rivals[row, at] = 0.0
            eb = rivals.max(1)
            alone = (total[at] <= 1) | ~np.isfinite(a)
            greater = np.maximum(a, b)
            flat = alone | ~(greater > 0)
            s = np.divide(b - a, greater, out=np.zeros(len(a)), where=~flat)
            low, high = np.maximum(np.minimum(a, b), 0), np.where(greater > 0, greater, 1.0)
            moved = np.minimum(2.0, (np.where(a < b, ea, eb) + low / high * np.where(a < b, eb, ea)) / np.maximum(high - np.where(a < b, eb, ea), 1e-300))
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.where(flat, 0.0, moved))], names=["s", "e"])

    found = rows.mapInArrow(scores, "s double, e double")
    return found.agg(
        F.avg("s").alias("silhouette"), F.avg("e").alias("error_bound"), F.count(F.lit(1)).alias("num_rows"), F.lit(len(own)).cast("long").alias("sampled")
    )
