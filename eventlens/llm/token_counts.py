"""Token counts: pieces are counted once per distinct pre-token and summed per document.

A piece of the vocabulary never has a word mark after another character (checked when the
model is read), so no merge crosses the start of a run of word marks. A text therefore falls
into *pre-tokens*, a run of spaces and the word behind it, whose piece counts add up to the
count of the whole text. No ids of a document are ever made.

A task turns its documents into rows (pre-token, where it occurs): one row per distinct
pre-token and slice of documents, the occurrences packed as one binary column, so a pre-token
that fills a third of the corpus is one row per slice. The rows meet by pre-token; there each
distinct one is counted once by the library, and its count is added up per document. What a
task has added up for a slice goes back to it as one row, and the slice adds these up.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted row
by row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import RowIds, columns, shuffle_width, small_batches, strings

WORD_MARK = "▁"
LIMIT = 4096
_MODELS: dict[str, object] = {}


def piece_model(path: str):
    """The library's model of a path, read once per process."""
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if WORD_MARK in p.lstrip(WORD_MARK)]
        if crossing:
            raise ValueError(f"pieces go across a word mark, pre-tokens don't add up: {crossing[:5]}")
        _MODELS[path] = model
    return _MODELS[path]


def pre_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes and owners of all pre-tokens of non-empty texts, and the distinct ones.

    A pre-token is named by what follows its first space, so the name "x" is " x" in the
    text and the name "" a single space at the end of a text.
    """
    nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    spaced = pc.binary_join_element_wise(nothing, pc.replace_substring(texts, WORD_MARK, " "), space)
    parts = pc.split_pattern(spaced, " ")
    flat = pc.list_flatten(parts)
    n_parts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(n_parts)), n_parts)
    ends = np.cumsum(n_parts)
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    inner = np.ones(len(owner), bool)  # all but the empty part before the first space of a text
    inner[ends - n_parts] = False
    last = np.zeros(len(owner), bool)
    last[ends - 1] = True
    at = np.flatnonzero(inner & (filled | last))  # each ends one pre-token
    before = np.maximum.accumulate(np.where(inner & filled | ~inner, np.arange(len(owner)), -1))
    extra = at - 1 - before[at - 1] if len(at) else at  # empty parts in front
    # Text "a " ends in an empty part; it is a pre-token of its own. So is no text's start.
    names = flat.take(pa.array(at))
    odd = np.flatnonzero(extra > 0)
    if len(odd):
        listed = names.take(pa.array(odd)).to_pylist()
        longer = pa.array([" " * int(k) + w for k, w in zip(extra[odd], listed)], pa.large_string())
        mask = np.zeros(len(at), bool)
        mask[odd] = True
        names = pc.replace_with_mask(names, pa.array(mask), longer)
    coded = names.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), owner[at], coded.dictionary


#: name: a pre-token, and occurs: (place u2, times u1) of the slice's documents that hold it;
#: or name null, and occurs: the slice's documents (doc_id, n_bytes) as an Arrow stream.
OCCURRENCES = "name string, slice long, occurs binary"
_OCCURRENCES = pa.schema([("name", pa.large_string()), ("slice", pa.int64()), ("occurs", pa.large_binary())])
SLICE_ROWS, SLICE_BYTES = 65536, 48 << 20  # a document's place within its slice takes two bytes
_PAIR = np.dtype([("place", "<u2"), ("times", "u1")])


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of documents: a row for each distinct pre-token, and a row for the documents."""
    ids = RowIds()
    for whole in batches:
        for batch in small_batches(whole, "text", SLICE_BYTES):
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = strings(part, "text")
                number = int(ids.take(1)[0])
                size = pc.binary_length(texts).cast(pa.int64())
                some = np.flatnonzero(size.to_numpy(zero_copy_only=False) > 0)
                code, owner, names = pre_tokens(texts.take(pa.array(some)))
                pair, times = np.unique(code * SLICE_ROWS + some[owner], return_counts=True)
                # times over 255 take several entries
                entries = -(-times // 255)
                last = np.cumsum(entries) - 1
                out = np.empty(int(entries.sum()), _PAIR)
                out["place"] = np.repeat(pair % SLICE_ROWS, entries)
                out["times"] = 255
                out["times"][last] = times - 255 * (entries - 1)
                per = np.bincount(pair // SLICE_ROWS, weights=entries, minlength=len(names)).astype(np.int64)
                cuts = np.concatenate([[0], np.cumsum(per)]) * _PAIR.itemsize
                occurs = pa.Array.from_buffers(pa.large_binary(), len(names), [None, pa.py_buffer(cuts), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), number)), occurs], schema=_OCCURRENCES)
                docs = pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), size], names=["doc_id", "n_bytes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.large_string()), pa.array([number]), pa.array([to_bytes(docs)], pa.large_binary())], schema=_OCCURRENCES
                )


#: Token sums of a slice's documents (place, n) as an Arrow stream; or, passed on, its documents.
SUMS = "slice long, is_docs boolean, body binary"
_SUMS = pa.schema([("slice", pa.int64()), ("is_docs", pa.bool_()), ("body", pa.large_binary())])


def counted(path: str, most: int = 2_000_000):
    """mapInArrow function over occurrence rows: each distinct name is counted once, then summed per slice and document."""

    def sums_of(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(at, weights=np.concatenate(sums))

    def packed(key: np.ndarray, n: np.ndarray, slices: list[int]) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(key // SLICE_ROWS, prepend=-1)).tolist()
        bodies = [
            to_bytes(pa.RecordBatch.from_arrays([pa.array((key[a:b] % SLICE_ROWS).astype(np.uint16)), pa.array(n[a:b].astype(np.uint32))], names=["place", "n"]))
            for a, b in zip(cuts, [*cuts[1:], len(key)])
        ]
        number = [slices[int(key[a] // SLICE_ROWS)] for a in cuts]
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array([False] * len(cuts)), pa.array(bodies, pa.large_binary())], schema=_SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        known: dict[str, int] = {}
        place: dict[int, int] = {}  # slices by order of appearance
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        held = 0
        for batch in batches:
            is_docs = pc.is_null(batch.column("name"))
            docs = batch.filter(is_docs)
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [docs.column("slice"), pa.array([True] * docs.num_rows), docs.column("occurs").cast(pa.large_binary())], schema=_SUMS
                )
            rows = batch.filter(pc.invert(is_docs))
            if not rows.num_rows:
                continue
            names = rows.column("name").to_pylist()
            if len(known) > most:  # bounded memory; a name that comes again is counted again
                known.clear()
            new = [x for x in dict.fromkeys(names) if x not in known]
            known.update(zip(new, map(len, model.encode(new, num_threads=1))))
            if "" in known:
                known[""] = 1  # the mark alone; the library gives an empty text no mark
            pieces = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
            occurs = rows.column("occurs")
            per = pc.binary_length(occurs).to_numpy(zero_copy_only=False).astype(np.int64) // _PAIR.itemsize
            pairs = np.frombuffer(b"".join(occurs.to_pylist()), _PAIR)
            at = [place.setdefault(x, len(place)) for x in rows.column("slice").to_pylist()]
            keys.append(np.repeat(np.array(at, np.int64) * SLICE_ROWS, per) + pairs["place"])
            sums.append(np.repeat(pieces, per) * pairs["times"].astype(np.float64))
            held += len(pairs)
            if held > most:
                key, n = sums_of(keys, sums)
                keys, sums, held = [key], [n], len(key)
                if held > most // 2:
                    yield packed(key, n, list(place))
                    keys, sums, held = [], [], 0
        if held:
            yield packed(*sums_of(keys, sums), list(place))

    return run


COUNTS = "doc_id long, n_bytes long, n_tokens long"


def summed(parts: pa.Table) -> pa.Table:
    """applyInArrow function: one slice's documents with their sums."""
    docs, n = None, np.zeros(SLICE_ROWS, np.int64)
    for is_docs, body in zip(parts["is_docs"].to_pylist(), parts["body"].to_pylist()):
        table = pa.ipc.open_stream(body).read_all()
        if is_docs:
            docs = table
        else:
            n[table["place"].to_numpy()] += table["n"].to_numpy()  # places are unique within a body
    return docs.append_column("n_tokens", pa.array(n[: docs.num_rows]))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    source = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = source.mapInArrow(occurrences, OCCURRENCES)
    met = found.repartition(shuffle_width(docs), F.xxhash64(F.coalesce("name", F.col("slice").cast("string"))))
    sums = met.mapInArrow(counted(model_path), SUMS)
    return sums.groupBy("slice").applyInArrow(summed, COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
