"""Similarity graph over clusters: adaptive threshold (J6), connected
components (J7), renumbering (J8) and the full merge (J9).

Connected components run as alternating large-star and small-star steps, as
DataFrame joins. Each round's edges are written as a table in the shared
checkpoint folder (spark.checkpoint.dir), which cuts lineage and survives
executor loss; the loop stops when no edge changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.operators.rows import dense_codes, exact_quantile, group_sizes, min_group_size
from eventlens.operators.vectors import SIM_DECIMALS, centroids, knn_edges
from eventlens.session import discard, ensure_checkpoint_dir, materialize

# Fixed values (merge parameters of the event pipeline).
NEIGHBOURS = 4          # five nearest including self, self removed
THRESHOLD_QUANTILE = 0.90
MIN_GROUP_FLOOR = 10
MIN_GROUP_FRACTION = 0.001


def adaptive_threshold(edges: DataFrame, q: float = THRESHOLD_QUANTILE) -> DataFrame:
    """Exact linear-interpolated quantile of all directed edge similarities (null if none)."""
    t = exact_quantile(edges, "sim", q)
    return t.select(F.round(F.col("sim"), SIM_DECIMALS).alias("threshold"))


def strong_edges(edges: DataFrame, q: float = THRESHOLD_QUANTILE) -> DataFrame:
    """Edges strictly above the adaptive threshold (self pairs never occur)."""
    t = adaptive_threshold(edges, q).scalar()
    return edges.filter((F.col("src") != F.col("dst")) & (F.col("sim") > t))


def _least_neighbour(both: DataFrame) -> DataFrame:
    """(u, m): the least of a node and its neighbours, combined before the shuffle."""
    return both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _star(both: DataFrame, links: DataFrame) -> DataFrame:
    """(u, v) with u > v: every link (u, v) becomes (v, the least neighbour of u).

    The join is of all links with one row per node, which adaptive execution splits at a hub.
    """
    met = links.join(_least_neighbour(both), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, both.where("v > u"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its lesser neighbours, and itself, to the least of them."""
    return _star(edges, edges.unionByName(edges.select("u", F.col("u").alias("v"))))


def _print(edges: DataFrame) -> tuple:
    """Number and hash of the edges: equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def connected_components(nodes: DataFrame, edges: DataFrame, node_col: str = "id") -> DataFrame:
    """(id, component) where component is the smallest id in the node's component.

    Alternating large-star and small-star: each round replaces the edges by as many or fewer that
    lie nearer to the least node, until every node is linked to the least of its component, which
    takes a number of rounds of the order of the logarithm of the graph's size, for hubs and long
    chains alike. A round is written once (shared folder), which cuts lineage; the rounds end when
    it leaves the edges as they are.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    ids = nodes.select(F.col(node_col).cast("long").alias("id")).distinct()
    pairs = edges.select(F.greatest("src", "dst").cast("long").alias("u"), F.least("src", "dst").cast("long").alias("v"))
    links = materialize(pairs.where("u > v").distinct(), "cc-edges")
    known = _print(links)
    while known[0]:
        last, links = links, materialize(_small_star(_large_star(links)), "cc-edges")
        discard(last)
        before, known = known, _print(links)
        if known == before:
            break
    # stars now: one edge per node that is not the least
    labels = ids.join(links.withColumnRenamed("u", "id"), "id", "left")
    return labels.select(F.col("id").alias(node_col), F.coalesce("v", F.col("id")).alias("component"))


def renumber_components(components: DataFrame, node_col: str = "id") -> DataFrame:
    """Final ids 0..m-1 in the order of each component's smallest member."""
    codes = dense_codes(components, "component", out="event_id")
    return components.join(codes, "component").select(node_col, "event_id")


def cluster_graph(
    df: DataFrame,
    key: str,
    vec_col: str,
    k: int = NEIGHBOURS,
    floor: int = MIN_GROUP_FLOOR,
    frac: float = MIN_GROUP_FRACTION,
):
    """C5 -> F2 -> E4 -> J5 on the facts; returns (codes, centroids, edges).

    The fact table is read twice (group sizes, centroids; both partial
    aggregates). Each result has one row per cluster (edges: k per cluster)
    and is written once to the shared checkpoint folder, so later steps
    never recompute anything from the facts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sizes = materialize(group_sizes(df, key, "_n"), "cluster-sizes")
    threshold = sizes.agg(min_group_size(F.sum("_n"), floor, frac)).scalar()
    valid = sizes.filter(F.col("_n") >= threshold).select(key)
    codes = materialize(dense_codes(valid, key, out="_code"), "cluster-codes")
    coded = df.join(codes, key)  # inner join: rows of small clusters drop out here (C5/D2)
    cent = materialize(centroids(coded, "_code", vec_col), "centroids")
    edges = materialize(knn_edges(cent, "_code", "unit", k), "knn-edges")
    return codes, cent, edges


def merge_events(
    df: DataFrame,
    key: str,
    vec_col: str,
    k: int = NEIGHBOURS,
    q: float = THRESHOLD_QUANTILE,
    floor: int = MIN_GROUP_FLOOR,
    frac: float = MIN_GROUP_FRACTION,
) -> DataFrame:
    """Small-cluster filter -> dense codes -> centroids -> k-NN -> threshold ->
    components -> renumber; returns ``df`` rows of kept clusters with ``event_id``.

    The fact table is read three times: group sizes, centroids (both partial
    aggregates) and the final id assignment. Everything in between is one row
    per cluster and is written once to the shared checkpoint folder, so no
    per-cluster table is recomputed from the facts.
    """
    codes, cent, edges = cluster_graph(df, key, vec_col, k, floor, frac)
    strong = strong_edges(edges, q)
    comps = connected_components(cent.select(F.col("_code").alias("id")), strong, "id")
    final = renumber_components(comps, "id").withColumnRenamed("id", "_code")
    id_map = codes.join(final, "_code").select(key, F.col("event_id").alias("_event_id"))
    out = df.join(id_map, key)
    cols = [c for c in df.columns if c != "event_id"]
    return out.select(*cols, F.col("_event_id").cast("long").alias("event_id"))
