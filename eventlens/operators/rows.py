"""Row-level operators: dedupe with a winner, group-size filters, dense codes,
counts, top-k and exact-size sampling.

Scale notes
  * ``dedupe_first`` groups key hashes and row numbers, never the rows: the
    partial aggregate collapses a hot key on the map side, so a key holding a
    third of all rows never lands whole in one task, and no text is sorted.
  * ``filter_small_groups`` counts per key (map-side combine), then keeps the
    qualifying keys with a semi join; the threshold is a scalar subquery, not
    a cross join.
  * ``dense_codes`` / ``global_positions`` / ``exact_quantile`` rank rows
    without a single-partition window: sort, number rows per partition, add
    per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.session import materialize


def _cols(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on a predicate over *computed* columns, evaluating them once.

    ``df.filter`` would be pushed below the projection that computes its
    input, re-evaluating that expression (e.g. a chain of regexes) a second
    time, and below any repartition, i.e. in the scan task. A zero-or-one-row
    generator is not pushed, so the columns are computed once, where they are
    defined.
    """
    flag = "__keep"
    marked = df.withColumn(flag, cond)
    gate = F.explode(F.when(F.col(flag), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return marked.select(*[F.col(c) for c in df.columns], gate.alias(flag)).drop(flag)


def _key_hash(df: DataFrame, keys: Sequence, salt: int) -> Column:
    """64 bits of the key, nulls told apart from values; another salt, another function."""
    parts = [F.lit(salt)]
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        if isinstance(k, str) and dict(df.dtypes).get(k) in ("double", "float"):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0.0 is 0.0, as in a grouping
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def dedupe_first(df: DataFrame, keys, order, hash_bits: int = 64, spent: list | None = None) -> DataFrame:
    """F1/H2: one row per key, the one with the smallest ``order`` (of equal orders one).

    Late-materialised: rows are written once, with three 64-bit hashes of the key and a number. Only
    (hashes, order, number) is grouped, by the first two hashes, with a map-side combine, so a key that
    holds a third of all rows is no hot task, and no text is sorted or compared. The numbers of the
    rows that lose are written, and the result is the written rows without them: a broadcast join
    where they are few (the written size decides), else a join on numbers, which no key skews.

    The third hash verifies the grouping: a group with two of them holds different keys, and the rows
    of such groups are told apart by their whole keys. Nulls in the key form one group, as in pandas.
    ``hash_bits`` shortens the first two hashes; results do not depend on it (tests use it). ``spent`` gets the
    tables that the result reads, for a caller that writes it and then has no use for them (``session.discard``).
    """
    keys = _cols(keys)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in _cols(order)]
    cut = 64 - hash_bits
    short = lambda h: F.shiftrightunsigned(h, cut) if cut else h
    rows = materialize(
        df.select(
            "*", short(_key_hash(df, keys, 1)).alias("__h1"), short(_key_hash(df, keys, 2)).alias("__h2"), _key_hash(df, keys, 3).alias("__h3"),
            F.struct(*order_cols).alias("__order"), F.monotonically_increasing_id().alias("__rid"),
        ),
        "dedupe-rows",
        "zstd",
    )
    groups = rows.groupBy("__h1", "__h2").agg(
        F.min(F.struct("__order", "__rid")).alias("__first"), F.min("__h3").alias("__lo"), F.max("__h3").alias("__hi")
    )
    winners = groups.select(F.col("__first.__rid").alias("__rid"), (F.col("__lo") != F.col("__hi")).alias("__mixed"))
    # a row that loses, or (mixed) that won a group of different keys
    told = rows.select("__rid").join(winners, "__rid", "left").where("__mixed is null or __mixed")
    losers = materialize(told.select("__rid", F.coalesce("__mixed", F.lit(False)).alias("__mixed")), "dedupe-losers")
    if not losers.where("__mixed").isEmpty():
        # different keys behind one pair of hashes: their rows are grouped by the keys themselves
        mixed = rows.join(losers.where("__mixed"), "__rid", "left_semi").select("__h1", "__h2")
        hit = materialize(rows.join(mixed, ["__h1", "__h2"], "left_semi"), "dedupe-mixed")
        exact = hit.groupBy(*keys).agg(F.min(F.struct("__order", "__rid")).alias("__first")).select(F.col("__first.__rid").alias("__rid"))
        lost = hit.select("__rid").join(exact, "__rid", "left_anti")
        losers = materialize(losers.select("__rid").join(hit.select("__rid"), "__rid", "left_anti").unionByName(lost), "dedupe-losers")
    if spent is not None:
        spent += [rows, losers]
    return rows.join(losers, "__rid", "left_anti").select(*df.columns)


def group_sizes(df: DataFrame, key: str, name: str = "num_tweets") -> DataFrame:
    """Rows per group."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def min_group_size(n_rows: Column, floor: int = 10, frac: float = 0.001) -> Column:
    """max(floor, int(frac * N))."""
    return F.greatest(F.lit(floor), F.floor(n_rows * F.lit(frac)).cast("long"))


def filter_small_groups(df: DataFrame, key: str, floor: int = 10, frac: float = 0.001) -> DataFrame:
    """C5 + D2: keep rows whose group has at least max(floor, int(frac*N)) rows, N before filtering."""
    sizes = group_sizes(df, key, "_n")
    threshold = sizes.agg(min_group_size(F.sum("_n"), floor, frac)).scalar()
    valid = sizes.filter(F.col("_n") >= threshold).select(key)
    return df.join(valid, on=key, how="left_semi")


def global_positions(df: DataFrame, order, out: str = "_gpos") -> DataFrame:
    """Every row of ``df`` with its 0-based position in ``order`` (a total order), distributed.

    A range-partitioned sort, in-partition positions from
    monotonically_increasing_id (partition index in the high bits), and
    offsets from a table with one row per partition (bounded by the
    partition count, so broadcasting it is safe). The sorted rows and their
    numbers are written once and both uses read that table: range bounds are
    sampled, so a second evaluation of the sort may cut partitions elsewhere.
    """
    order = _cols(order)
    numbered = materialize(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "positions")
    ranked = numbered.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    )
    per_part = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = per_part.select(
        "_part",
        (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    return ranked.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_off") + F.col("_pos")).cast("long").alias(out)
    )


def dense_codes(df: DataFrame, keys, out: str = "code") -> DataFrame:
    """F2/F4 helper: distinct ``keys`` with a dense 0-based rank in ascending key order (distributed)."""
    keys = _cols(keys)
    return global_positions(df.select(*keys).distinct(), keys, out)


def exact_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """One row: the exact linearly interpolated q-quantile of ``col`` (null when empty).

    Distributed: values get global positions by a range sort, and only the
    rows at floor/ceil((n - 1) * q) are read; no task holds all values.
    """
    vals = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    n = vals.agg(F.count(F.lit(1))).scalar()
    pos = (n - F.lit(1)).cast("double") * F.lit(q)
    placed = global_positions(vals, ["_v"], "_i")
    picked = placed.filter((F.col("_i") == F.floor(pos)) | (F.col("_i") == F.ceil(pos)))
    lo = F.min_by("_v", "_i")
    hi = F.max_by("_v", "_i")
    frac = pos - F.floor(pos)
    return picked.agg((lo + frac * (hi - lo)).alias(col))


def count_distinct(col: str, name: str | None = None, approx: bool = False, rsd: float = 0.01) -> Column:
    """Distinct non-null count as an aggregate column (exact, or HyperLogLog++ when ``approx``)."""
    agg = F.approx_count_distinct(F.col(col), rsd) if approx else F.countDistinct(F.col(col))
    return agg.alias(name or f"n_{col}")


def top_groups(df: DataFrame, key: str, n: int = 10, name: str = "num_tweets") -> DataFrame:
    """G1: the n largest groups; ties by key ascending."""
    return group_sizes(df, key, name).orderBy(F.desc(name), F.asc(key)).limit(n)


def event_stats(df: DataFrame, key: str = "event_id") -> DataFrame:
    """E8 totals: number of events and rows, one row."""
    return df.agg(count_distinct(key, "total_events"), F.count(F.lit(1)).alias("total_tweets"))


def peek_rows(df: DataFrame, order, n: int = 5) -> DataFrame:
    """First n rows in a stated order."""
    return df.orderBy(*_cols(order)).limit(n)


def sample_key(key: Column | str, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), k.cast("string")))


def _sample_point(key: Column | str, seed: int) -> Column:
    """First 12 hex digits of the sample key as a number in [0, 1); monotone in the key's order."""
    return F.conv(F.substring(sample_key(key, seed), 1, 12), 16, 10).cast("double") / float(16 ** 12)


def sample_n(df: DataFrame, n: int, seed: int, key: str, margin: float = 1.2) -> DataFrame:
    """Exactly min(n, rows) rows, reproducible: the n smallest md5(seed || key).

    Bounded at any scale: with N rows, only rows whose hash point is below
    about margin * n / N are candidates (the threshold widens until at least
    n qualify), so the final ordered limit merges ~n rows, never n rows from
    every partition. The candidate set is closed downward in md5 order, so
    the result equals a full ordered limit.
    """
    # the points alone are written, so that however often they are counted ``df`` is run once for them
    points = materialize(df.select(_sample_point(key, seed).alias("p")), "sample-points")
    total = points.count()
    if total <= n:
        return df
    cut = min(1.0, margin * n / total + 1e-9)
    while cut < 1.0 and points.where(F.col("p") <= cut).count() < n:
        cut = min(1.0, cut * 2)
    cand = df.filter(_sample_point(key, seed) <= F.lit(cut))
    return cand.orderBy(sample_key(key, seed), F.col(key)).limit(n)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """H1: union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
