"""Small helpers shared by the training-data operators.

Intermediate tables go through ``eventlens.session.materialize`` (a Parquet table in the
shared ``spark.checkpoint.dir``), so lost executors never lose them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of all contracts here: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"


def columns(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing ones drop out.

    A name that is given as ``new="old"`` is looked up case-sensitively among the
    top-level columns; a frame with two columns of that name raises ValueError.
    """
    out = []
    for new, old in names.items():
        at = [i for i, c in enumerate(df.columns) if c == old]
        if len(at) != 1:
            raise ValueError(f"column {old!r} is there {len(at)} times in {df.columns}")
        out.append((new, at[0]))
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(new) for new, i in out])


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def hash_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows, the same each time: those whose hash of ``key`` is small. All rows if there are no more."""
    total = df.count()
    if total <= rows:
        return df
    share = int(2**64 * (rows / total)) - 2**63
    return df.where(F.xxhash64(key, F.lit(seed)) < share)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class RowIds:
    """Unique row numbers within one evaluation of a mapInArrow stage: partition, then row."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self._next = (context.partitionId() if context else 0) << 40

    def take(self, n: int) -> np.ndarray:
        out = np.arange(self._next, self._next + n, dtype=np.int64)
        self._next += n
        return out


def strings(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column of an Arrow batch, null as empty, with 64-bit offsets, in buffers of its own.

    Some text kernels (ascii_lower) misread an array whose offsets don't begin at 0, as a slice's do.
    """
    column = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    return column.take(pa.array(np.arange(len(column))))


def small_batches(batch: pa.RecordBatch, name: str, limit: int = 16 << 20):
    """Slices of a batch whose column ``name`` holds about ``limit`` bytes (at least one row each)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space words of every text: code per word, words per text, distinct words.

    Arrow's ASCII white space is exactly ``[\\x20\\x09-\\x0D]``; the empty strings that
    leading and trailing white space leave are removed.
    """
    parts = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(parts)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0)
    if pc.any(empty).as_py():
        owner = np.repeat(np.arange(len(counts)), counts)
        keep = ~empty.to_numpy(zero_copy_only=False)
        counts = np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)
