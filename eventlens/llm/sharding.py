"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every pair of a record key and a shard has a hash, made a number u in (0, 1); the record goes to
the shard with the greatest weight / -ln(u). The key and the shards alone decide. Shares are in
proportion to weights, a new shard takes records only into itself, a shard that goes gives its
records to the others, and a changed weight moves records only to or from that shard.

Placing is a narrow projection: nothing is shuffled by key, so a key that holds a third of all
rows is a large shard, not a slow task. Slots are numbered without a sort: every scan partition
numbers its rows per shard, the narrow rows are written once, and the counts of (shard, partition)
say where each partition's numbers begin.

Defined cases: a null text has no bytes (size 1, crc32 0); null keys are one key; repeated rows
are rows of their own with one shard and different slots; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import columns, text_of
from eventlens.session import materialize

#: Shards of the query: 0 to 7, all of one weight.
SHARDS = 8


def weighted(shards: int | Mapping[int, float]) -> dict[int, float]:
    """Shard number to weight; a plain count means that many shards of weight 1."""
    found = {i: 1.0 for i in range(shards)} if isinstance(shards, int) else {int(k): float(v) for k, v in shards.items()}
    if not found or min(found.values()) <= 0:
        raise ValueError(f"shards need weights above 0: {found}")
    return found


def rendezvous(keys: Sequence[str | Column], shards: int | Mapping[int, float], seed: int = 0) -> Column:
    """The shard of a record key, an int; equal scores (of 53 bits) go to the lower shard."""
    listed = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(w).alias("weight")) for i, w in sorted(weighted(shards).items())])
    keys = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\0")) for k in keys]

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*keys, s["shard"], F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((s["weight"] / -F.ln(u)).alias("score"), (-s["shard"]).alias("last"))

    return -F.array_max(F.transform(listed, score))["last"]


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the scan partition and the row's number among that partition's rows of its shard."""
    context = TaskContext.get()
    part, seen = context.partitionId() if context else 0, {}
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        place = np.empty(len(shard), np.int64)
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            place[at] = seen.get(s, 0) + np.arange(len(at))
            seen[s] = seen.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(shard), part, np.int64)), pa.array(place)], names=[*batch.schema.names, "part", "place"]
        )


def assign_shards(
    docs: DataFrame,
    shards: int | Mapping[int, float] = SHARDS,
    grown: int | Mapping[int, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``grown`` lists the shards after a change; by default one more shard of weight 1 under the next number.
    """
    now = weighted(shards)
    grown = weighted(grown) if grown is not None else now | {max(now) + 1: 1.0}
    text = text_of("text")
    placed = columns(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(["doc_id"], now).alias("shard"),
        rendezvous(["doc_id"], grown).alias("grown_shard"),
    )
    schema = ", ".join(f"{c} {t}" for c, t in placed.dtypes) + ", part long, place long"
    rows = materialize(placed.mapInArrow(numbered, schema), "shard-rows")
    # one row per shard and scan partition
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("place")).alias("slot"), "grown_shard"
    )


def moved(docs: DataFrame, old: int | Mapping[int, float], new: int | Mapping[int, float], key_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that change shards, with from_shard and to_shard: all that a change has to rewrite."""
    key = F.col(f"`{key_col}`")
    out = docs.withColumns({"from_shard": rendezvous([key], old), "to_shard": rendezvous([key], new)})
    return out.where("from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, shards: int | Mapping[int, float], files: int = 1, key_col: str = "doc_id") -> None:
    """Write whole rows below ``path``, a folder ``shard=i`` each, in about ``files`` files a shard.

    Rows are dealt to files by their place in the scan, so a key with many rows fills several files.
    """
    place = F.pmod(F.monotonically_increasing_id(), F.lit(files)) if files > 1 else F.lit(0).cast("long")
    out = docs.withColumns({"shard": rendezvous([F.col(f"`{key_col}`")], shards), "__file": place})
    out.repartition(len(weighted(shards)) * files, "shard", "__file").drop("__file").write.partitionBy("shard").parquet(path)
