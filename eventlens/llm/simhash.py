"""SimHash near-duplicates: shards of a vantage-point tree, joined exactly, then components.

Fingerprints: a bit is 1 if it is set in over half of the XXH64 hashes of a text's word
shingles, repeats included. Distinct fingerprints are then linked at ``max_bits`` or fewer
differing bits.

A node of the tree holds a vantage fingerprint v and a radius r. Points at distance <= r of v
belong inside, the others outside. Let two points within ``max_bits`` of each other be parted
by a node: the inner one is further than r - max_bits away (triangle inequality). So the points
of that boundary ring are copied outside, too, and every link lies whole within some shard.
Each copy goes on down the tree like any other point, so one direction of copying is enough.

The tree is fitted on a bounded sample; *every* fingerprint is sent down it. A shard that is
still too large gets a tree of its own, from a sample of that shard, and so on. Within a shard
the task goes on with exact vantage-point splits down to small blocks, which are compared bit
by bit, in numpy. Points that no radius can part (a dense ball, wider than its own boundary
ring) are joined through their one-bit neighbours instead: two points differ in two bits or
fewer if and only if they share a point at one bit or fewer from both; in a task by sorting,
and for a ball larger than a shard by a Spark group per neighbour. No pair rows are made: a
shard returns one edge per point that is linked to an earlier one (a spanning forest), which
keeps every link's connection. Components are then min-label rounds over those edges.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words
than a shingle are one shingle; repeated rows and equal fingerprints share a component; a null
doc_id has a fingerprint, and never names a component unless it is alone (then null); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventlens.llm.common import columns, hash_sample, small_batches, strings
from eventlens.session import materialize

SHINGLE, MAX_BITS, SEED = 3, 2, 42
SAMPLE = 40_000  # fingerprints that a tree is fitted on, about
SHARD, BLOCK = 24_000, 512  # fingerprints in a task's shard at most, and in a block compared bit by bit
SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text."""
    import xxhash

    found = text.lower().split()  # bytes: only A-Z is lowered, and only ASCII white space splits
    if not found:
        return 0
    n = max(1, len(found) - shingle + 1)
    grams = map(b" ".join, zip(*(found[i:] for i in range(shingle)))) if n > 1 else [b" ".join(found)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > n).astype(np.uint64) << SHIFTS).sum())


PRINTS = "doc_id long, fp long, text_key long"
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_key", pa.int64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fp (the fingerprint as a signed long), text_key (hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text"):
                texts = strings(batch, "text").cast(pa.large_binary()).to_pylist()
                fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
                ids, keys = (batch.column(c).cast(pa.int64()) for c in ("doc_id", "text_key"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64)), keys], schema=_PRINTS)

    source = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, PRINTS)


def distance(points: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ v)


def best_radius(d: np.ndarray, max_bits: int) -> tuple[int, int]:
    """The radius whose larger side, boundary ring included, is smallest; and that size."""
    upto = np.cumsum(np.bincount(d, minlength=65))
    inside = upto[:64]
    outside = len(d) - np.concatenate([np.zeros(max_bits), upto])[:64]  # distance > r - max_bits
    larger = np.maximum(inside, outside)
    r = int(np.argmin(larger))
    return r, int(larger[r])


def split_node(points: np.ndarray, max_bits: int) -> tuple[np.uint64, int, int]:
    """A vantage point of ``points``, its radius and the larger side's size: the best of a few points spread over them."""
    tries = points[np.linspace(0, len(points) - 1, 5).astype(int)]
    best = min(((*best_radius(distance(points, v), max_bits), v) for v in tries), key=lambda x: x[1])
    return best[2], best[0], best[1]


#: A split must shrink its larger side to this share, or the points count as one dense ball.
SHRINK = 0.85


def fit_tree(sample: np.ndarray, leaf: float, max_bits: int) -> list:
    """A nested [v, r, inside, outside], with None for leaves, until a leaf's share of the sample is ``leaf`` points."""
    if len(sample) <= max(leaf, 4 * max_bits):
        return None
    v, r, larger = split_node(sample, max_bits)
    if larger > SHRINK * len(sample):
        return None
    d = distance(sample, v)
    return [v, r, fit_tree(sample[d <= r], leaf, max_bits), fit_tree(sample[d > r - max_bits], leaf, max_bits)]


def send_down(tree: list | None, points: np.ndarray, max_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf number, positions of its points) for every leaf that has any."""
    todo, leaf = [(tree, np.arange(len(points)))], 0
    while todo:
        node, at = todo.pop()
        if node is None:
            if len(at):
                yield leaf, at
            leaf += 1
            continue
        v, r, inside, outside = node
        d = distance(points[at], v)
        todo += [(outside, at[d > r - max_bits]), (inside, at[d <= r])]


class Forest:
    """Union-find over positions; ``edges`` are the unions that joined something."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        top = x
        while self.parent[top] != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def neighbours(points: np.ndarray) -> np.ndarray:
    """Every point's 65 points at one bit or fewer: an array of 65 columns."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << SHIFTS])
    return points[:, None] ^ flips[None, :]


def link_dense(points: np.ndarray, at: np.ndarray, forest: Forest) -> None:
    """Links at two bits or fewer through shared one-bit neighbours, in linear space."""
    # by the top byte of the neighbour: 1/256 of the neighbours in memory at a time for large balls
    near = neighbours(points[at])
    keys = near.ravel()
    owner = np.repeat(at, near.shape[1])
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    for a, b in zip(owner[order][same].tolist(), owner[order][same + 1].tolist()):
        forest.join(a, b)


def link_shard(points: np.ndarray, max_bits: int = MAX_BITS, block: int = BLOCK) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``points``, by exact vantage-point splits."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > block:
            v, r, larger = split_node(points[at], max_bits)
            if larger <= SHRINK * len(at):
                d = distance(points[at], v)
                todo += [at[d <= r], at[d > r - max_bits]]
                continue
            if max_bits == 2:
                link_dense(points, at, forest)
                continue
        own = points[at]
        for i in range(0, len(at), 256):
            a, b = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, :]) <= max_bits)
            a = a + i
            for x, y in zip(at[a[a < b]].tolist(), at[b[a < b]].tolist()):
                forest.join(x, y)
    return forest.edges


EDGES = "a long, b long"
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shard_edges(max_bits: int, block: int):
    def run(table: pa.Table) -> pa.Table:
        points = np.sort(table["fp"].to_numpy().view(np.uint64))
        edges = np.array(link_shard(points, max_bits, block), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(points[edges[:, k]].view(np.int64)) for k in (0, 1)], schema=_EDGES)

    return run


def sent(tree: list | None, max_bits: int):
    """mapInArrow function: every fingerprint once per leaf that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("fp", pa.int64())])
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            shard = batch.column("shard")
            for leaf, at in send_down(tree, fp.view(np.uint64), max_bits):
                names = [f"{s}.{leaf}" for s in shard.take(pa.array(at)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(fp[at])], schema=schema)

    return run


def shards(points: DataFrame, max_bits: int, sample: int, shard: int) -> tuple[DataFrame, DataFrame | None]:
    """(shard, fp) rows so that each link lies in a shard; and those of shards too large that no radius parts."""
    todo = points.select(F.lit("").alias("shard"), "fp")
    total = points.count()
    done, dense = None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    large = {"": total} if total > shard else {}
    if not large:
        return todo, None
    while large:
        parts = None
        for name, n in large.items():
            own = todo.where(F.col("shard") == name)
            taken = hash_sample(own.select("fp"), "fp", sample, 7).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
            tree = fit_tree(np.sort(taken), max(16, shard / 2 * len(taken) / n), max_bits)
            if tree is None:
                dense = add(dense, own)
            else:
                parts = add(parts, own.mapInArrow(sent(tree, max_bits), "shard string, fp long"))
        if parts is None:
            break
        parts = materialize(parts, "simhash-shards")
        sizes = parts.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard)
        large = {r["shard"]: r["n"] for r in sizes.collect()}
        done = add(done, parts.where(~F.col("shard").isin(list(large)))) if large else add(done, parts)
        todo = parts
    return done if done is not None else todo.limit(0), dense


def dense_edges(points: DataFrame, max_bits: int) -> DataFrame:
    """Edges within balls larger than a shard: points that share a one-bit neighbour, as stars around the smallest."""
    if max_bits != 2:
        raise ValueError("dense balls larger than a shard are joined for max_bits = 2 only")
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(int(np.uint64(1 << i).view(np.int64))) for i in range(64)]])
    near = points.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("key"))
    first = near.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return near.join(first, "key").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, label): the least ``label`` of every node's component; each round is a written table.

    A round takes the least label over a node's neighbours and then jumps from a node to the
    label of its label's node, so long chains take a logarithm of rounds. Ends when no label
    changes; nodes without edges are not part of the rounds.
    """
    both = materialize(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "simhash-edges")
    if both.isEmpty():
        return nodes.select("fp", F.col("label").alias("component"))
    labels = materialize(both.select("a").distinct().select(F.col("a").alias("fp"), F.col("a").alias("root")), "simhash-roots")
    while True:
        low = both.join(labels, both["b"] == labels["fp"]).groupBy("a").agg(F.min("root").alias("low"))
        seen = labels.join(low, labels["fp"] == low["a"]).select("fp", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        seen = materialize(seen, "simhash-roots")
        jump = seen.select(F.col("fp").alias("at"), F.col("root").alias("further"))
        count = Observation()
        labels = materialize(
            seen.join(jump, seen["root"] == jump["at"], "left")
            .select("fp", "old", F.least("root", F.coalesce("further", "root")).alias("root"))
            .observe(count, F.sum((F.col("root") != F.col("old")).cast("long")).alias("changed"))
            .select("fp", "root"),
            "simhash-roots",
        )
        if not count.get["changed"]:
            break
    rooted = nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("label").alias("component"))
    return rooted.join(least, "root").select("fp", "component")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    sample: int = SAMPLE,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (the least doc_id reachable), text_key (hash of the text)."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("label")), "simhash-nodes")
    placed, dense = shards(nodes.select("fp"), max_bits, sample, shard)
    edges = placed.groupBy("shard").applyInArrow(shard_edges(max_bits, block), EDGES)
    if dense is not None:
        edges = edges.unionByName(dense_edges(dense, max_bits))
    found = components(nodes, edges)
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"), "text_key"
    )
