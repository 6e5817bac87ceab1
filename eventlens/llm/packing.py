"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Tokenising: a slice of documents is split at white space, words are cut before a run of
closing punctuation, and the library encodes each distinct part once per slice; the ids of a
document are the ids of its parts, in order (white space and the cut are always borders of
the tokenizer's own pre-tokens). Texts with special strings go to the library whole.

Packing: pieces are dealt by hash into groups of about ``group_items``. Each group is packed
best-fit, longest first; bins that nothing left can join leave as finished sequences. The bins
that are left are the items of the next round, in fewer groups (``fan_in`` to one, never more
than ``merge_items`` items in one), until one group is left or a round joins nothing more. A
task holds one group, so its memory does not grow with the corpus. A bin is named by its first
item, which no other bin holds.

Defined cases: null and empty texts are the end id alone, one piece of length 1. A document
of a multiple of ``capacity`` ids gives full pieces only. Repeated rows are packed each for
itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import RowIds, columns, ragged, small_batches, strings, words
from eventlens.session import materialize

CAPACITY = 2048
END_ID = 0
#: Closing punctuation that is cut off a word whose rest ends in one of WORD_END.
CLOSING = ".,!?%*#$&;:|"
WORD_END = "[a-z0-9ß-öø-ÿ]$"
#: A word that is one token of its own in any surroundings, put between the parts of one call.
SEPARATOR = "0"
CACHE_PARTS = 400_000


class PartEncoder:
    """Ids of distinct parts, remembered per process up to CACHE_PARTS."""

    _by_path: dict[str, PartEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        mark = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError(f"{SEPARATOR!r} is not one token of {path}")
        self.mark = mark[0]
        self.clear()

    @classmethod
    def of(cls, path: str) -> PartEncoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.size = 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, parts: list[str]) -> None:
        """Encode parts: many in a call, told apart by the separator's id; those that hold it, alone."""
        plain = [p for p in parts if SEPARATOR not in p]
        other = [p for p in parts if SEPARATOR in p]
        lists: list[np.ndarray] = []
        for i in range(0, len(plain), 512):
            group = plain[i : i + 512]
            ids = self.whole(f" {SEPARATOR} ".join(group))
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(group) - 1:
                raise ValueError("a part holds the separator's token")
            lists += np.split(ids[ids != self.mark], cut - np.arange(len(cut)))
        lists += map(self.whole, other)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = self.size + np.cumsum(lengths)
        self.place.update(zip(plain + other, range(len(self.place), len(self.place) + len(lists))))
        self.starts.append(ends - lengths)
        self.lengths.append(lengths)
        self.flat += lists
        self.size = int(ends[-1]) if len(ends) else self.size

    def keep(self, parts: list[str]) -> None:
        """Forget all parts but these: a part that came again will come again."""
        parts = list(dict.fromkeys(parts))
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        start, length, flat = self.starts[0][at], self.lengths[0][at], self.flat[0]
        self.clear()
        self.place = {p: i for i, p in enumerate(parts)}
        ends = np.cumsum(length)
        self.starts, self.lengths, self.flat = [ends - length], [length], [flat[ragged(start, length)]]
        self.size = int(length.sum())

    def lookup(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length) of every part's ids within the array given third."""
        new = [p for p in parts if p not in self.place]
        if len(self.place) + len(new) > CACHE_PARTS:
            self.keep([p for p in parts if p in self.place])
        if new:
            self.learn(list(dict.fromkeys(new)))
            self.starts, self.lengths = [np.concatenate(self.starts)], [np.concatenate(self.lengths)]
            self.flat = [np.concatenate(self.flat)]
        at = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        return self.starts[0][at], self.lengths[0][at], self.flat[0]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        lowered = pc.ascii_lower(texts)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(lowered, s.lower()).to_numpy(zero_copy_only=False)
        if special.any():
            lowered = pc.replace_with_mask(lowered, pa.array(special), pa.scalar("", pa.large_string()))
        code, counts, names = words(lowered)
        stems = pc.ascii_rtrim(names, characters=CLOSING)
        cut = pc.match_substring_regex(stems, WORD_END).to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(cut), stems, names)
        n_stem = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        n_name = pc.binary_length(names).to_numpy(zero_copy_only=False)
        tailed = np.flatnonzero(n_stem < n_name)
        coded = stems.dictionary_encode()
        stem_code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tail_text = [n[int(k) :] for n, k in zip(names.take(pa.array(tailed)).cast(pa.large_binary()).to_pylist(), n_stem[tailed])]
        tail_names = list(dict.fromkeys(tail_text))
        listed = coded.dictionary.to_pylist()
        start, length, flat = self.lookup(listed + [t.decode() for t in tail_names])
        tail_place = {t: len(listed) + i for i, t in enumerate(tail_names)}
        tail_code = np.full(len(names), -1, np.int64)
        tail_code[tailed] = [tail_place[t] for t in tail_text]
        # each word is a stem and perhaps a tail: two entries, the missing tail of length 0
        entry = np.stack([stem_code[code], tail_code[code]], axis=1).ravel()
        length = np.append(length, 0)
        start = np.append(start, 0)
        per_entry = length[entry]
        ids = flat[ragged(start[entry], per_entry)]
        before = np.concatenate([[0], np.cumsum(per_entry)])
        ends = np.cumsum(counts) * 2
        sizes = before[ends] - before[ends - counts * 2]
        if special.any():
            pieces = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(special):
                pieces[i] = self.whole(texts[int(i)].as_py())
                sizes[i] = len(pieces[i])
            ids = np.concatenate(pieces)
        return ids, sizes


PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES = pa.schema(
    [("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def pieces_of(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows = PartEncoder.of(path), RowIds()
        for whole in batches:
            for batch in small_batches(whole, "text", 12 << 20):
                ids, sizes = encoder.documents(strings(batch, "text"))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                sizes = sizes + 1
                first = np.cumsum(sizes) - sizes
                n = -(-sizes // capacity)
                piece = ragged(np.zeros(len(n), np.int64), n)
                doc = np.repeat(np.arange(len(n)), n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at = (first[doc] + start) * 4
                raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                crc = np.fromiter((zlib.crc32(raw[a : a + k]) for a, k in zip(at.tolist(), (length * 4).tolist())), np.int64, len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.take(len(at))), batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)),
                     pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    schema=_PIECES,
                )

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number per item: longest item first, into the open bin with the least room that takes it."""
    out = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, n = 0, 0  # bit r: there is a bin with room r
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bins = open_bins[room]
            b = bins.pop()
            if not bins:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return out


PACKED = "item long, size long, bin long, offset long, fill long"
_PACKED = pa.schema([(x, pa.int64()) for x in ("item", "size", "bin", "offset", "fill")])


def packed_group(capacity: int):
    """applyInArrow function: packs one group of (item, size)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")  # rows of a group come in any order
        item, size = table["item"].to_numpy(), table["size"].to_numpy()
        bins = best_fit(size, capacity)
        order = np.argsort(bins, kind="stable")
        item, size, bins = item[order], size[order], bins[order]
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        fill = np.add.reduceat(size, first)
        before = np.cumsum(size) - size
        per = np.diff(np.append(first, len(bins)))
        columns = [item, size, np.repeat(item[first], per), before - np.repeat(before[first], per), np.repeat(fill, per)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_PACKED)

    return run


def pack(
    items: DataFrame, capacity: int = CAPACITY, group_items: int = 250_000, merge_items: int = 1_000_000, fan_in: int = 8
) -> DataFrame:
    """Place every (item, size) row, item unique and 1 <= size <= capacity: item, sequence_id, offset.

    Groups hold about ``group_items`` items first and ``merge_items`` at most later. Rounds go on until
    one group is left, or several that could not join any two bins in a round. A bin leaves the rounds
    only if it is full or its room is below the smallest bin left, so that nothing can join it.
    """
    todo = items.select(F.col("item").cast("long").alias("item"), F.col("size").cast("long").alias("size"))
    placed, count, groups, level = None, todo.count(), 0, 0
    while True:
        fewest = -(-count // (merge_items if level else group_items)) or 1
        groups = max(fewest, -(-groups // fan_in)) if groups else fewest
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(groups)))
        done = materialize(dealt.groupBy("g").applyInArrow(packed_group(capacity), PACKED), "packed")
        here = done.select("item", "bin", "offset")
        if placed is None:
            placed = here.withColumnRenamed("bin", "sequence_id")
        else:
            # a bin packed as an item moves its own items along; finished bins stay
            moved = here.select(F.col("item").alias("sequence_id"), "bin", F.col("offset").alias("shift"))
            placed = placed.join(moved, "sequence_id", "left").select(
                "item",
                F.coalesce("bin", "sequence_id").alias("sequence_id"),
                (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
            )
        if groups == 1:
            return placed
        made = done.where("offset = 0").select("bin", F.col("fill").alias("size"))
        all_bins, smallest = made.agg(F.count(F.lit(1)), F.min("size")).first()
        if level and groups == fewest and all_bins == count:
            return placed
        left = made.where(F.col("size") <= capacity - (smallest or 0))
        bins = left.count()
        todo, count, level = left.withColumnRenamed("bin", "item"), bins, level + 1
        if not count:
            return placed


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, **how
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    source = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(source.mapInArrow(pieces_of(tokenizer_path, capacity, end_id), PIECES), "pieces")
    placed = pack(pieces.select("item", F.col("length").alias("size")), capacity, **how)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
