"""Katz backoff scoring of texts with partitioned n-gram tables.

Tokens are the words of a text (A-Z lower-cased) and one end. Four passes over the texts:

1. the unigram table: (word hash, training count) of every word, written;
2. the bigram table: (history, word) with training counts, written. Its symbols are the words
   of at least two training counts, the most frequent, at most ``vocabulary`` of them, the
   end, and one class for all other words, so that a symbol has a short number;
3. the pair table: (history, word) with training counts of every bigram with a word of the
   class, under the words' own hashes, written; so every bigram of the texts is counted;
4. scoring: a task packs the bigrams of a slice of documents by bucket: of symbols by their key,
   of words of the class by the word, the history, or both; each bucket meets its part of
   the tables, evaluates its share of every token and sends sums per document back to the slice.

The model: P(w | h) = d(n) n / c(h) for a bigram seen n times, with Good-Turing discounts d for
n <= 5, else alpha(h) times the next lower distribution. alpha is exact: the mass that h's seen words
leave, over the mass that they leave below. Below the bigrams of symbols is P(w), which adds one
to a symbol's count. The class is only backed off to: below the words of the class after a
symbol are their shares of the class, Good-Turing shares again, where words never seen
get the freed mass; below the words after a word h of the class is P(w | class), the class as history.
Probabilities of all words and one unknown word sum to 1 after any history.

Words are told apart by 64-bit hashes. What a task or the driver holds is bounded: the
vocabulary and a few numbers per symbol (``vocabulary`` rows), the ``head`` most frequent bigrams
(which tasks score by themselves, so that no bucket gets a hot key), a bucket, the numbers of a
slice and the texts of a piece of it. The tables and what is sent grow with the input.

Defined cases: null and empty texts are one end token; a null doc_id is a training row; without
training rows every text has base score 0 and words count as unknown; repeated rows count and
are scored each for itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import RowIds, columns, small_batches, strings, words
from eventlens.llm.token_counts import to_bytes
from eventlens.llm.toxicity import fold
from eventlens.session import materialize, release_shuffles

VOCABULARY, HEAD = 100_000, 50_000
BUCKET_TOKENS = 700_000
PLACE_BITS = 16  # of a text in a slice
SLICE_ROWS, SLICE_BYTES = 1 << PLACE_BITS, 16 << 20
PIECE_BYTES = 4 << 20  # of a slice's texts, split into words at once
TABLE_ROWS = 1 << 20
OUT_ROWS = 1 << 17  # of a batch of counts
RARE, END, START, FIRST = 0, 1, 2, 3  # symbols; words are numbered from FIRST
BITS = 20  # of a symbol in a bigram's key
GOOD_TURING = 5
KINDS = 3  # of buckets
MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = 7919  # a prime; (2**44 - 1) * SPREAD + 2**20 fits a long


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word code per token, words per text, and the hash of each distinct word."""
    code, counts, names = words(pc.ascii_lower(strings(batch, "text")))
    return code, counts, hashes_of(names)


def hashes_of(names: pa.LargeStringArray) -> np.ndarray:
    """XXH3 of the bytes of every name; the names are not made Python strings."""
    from xxhash import xxh3_64_intdigest

    if not len(names):
        return np.zeros(0, np.int64)
    _, offsets, data = names.buffers()
    cuts, raw = np.frombuffer(offsets, np.int64, len(names) + 1, 8 * names.offset).tolist(), data.to_pybytes()
    return np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(cuts, cuts[1:])), np.uint64, len(names)).view(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def by_slice(counted):
    """mapInArrow function: what ``counted`` makes of each slice (the columns of a table, by name), in batches of OUT_ROWS.

    It gets the pieces of a slice, so that only what is kept of a text lies in memory for all texts of the slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", SLICE_BYTES):
                out = pa.RecordBatch.from_pydict(counted(small_batches(batch, "text", PIECE_BYTES)))
                for start in range(0, out.num_rows, OUT_ROWS):
                    yield out.slice(start, OUT_ROWS)

    return run


def training(piece: pa.RecordBatch) -> np.ndarray:
    return ~piece.column("held_out").to_numpy(zero_copy_only=False)


def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): distinct words of the training texts of a slice."""

    def counted(pieces: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        found = []
        for piece in pieces:
            code, counts, hashes = tokens(piece)
            n = np.bincount(code[np.repeat(training(piece), counts)], minlength=len(hashes))
            found.append((hashes[n > 0], n[n > 0]))
        key, n = map(np.concatenate, zip(*found))
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = runs(key)
        return {"key": key[first], "n": np.add.reduceat(n, first) if len(first) else n}

    return by_slice(counted)(batches)


def discounts(counts_of_counts: dict[int, int], k: int = GOOD_TURING) -> np.ndarray:
    """Good-Turing factors d[r] for r <= k (d[0] unused, 1 beyond); absolute discounts where they are not in (0, 1)."""
    n = [0] + [counts_of_counts.get(r, 0) for r in range(1, k + 2)]
    d = np.ones(k + 1)
    if not any(n[1 : k + 1]):
        return d
    last = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        new = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and n[r + 1] and last < 1 else -1.0
        d[r] = new if 0 < new < 1 else (r - 0.5) / r
    return d


@dataclass
class Model:
    """What every task holds: bounded by the vocabulary and the head."""

    hashes: np.ndarray  # of the vocabulary, sorted
    symbols: np.ndarray
    counts: np.ndarray  # by symbol
    total: int  # training tokens, ends included
    distinct: int
    rare_total: int
    rare_d: np.ndarray
    rare_unknown: float  # log10 of an unknown word's share of the class
    buckets: int = 1
    bigram_d: np.ndarray | None = None
    log_p: np.ndarray | None = None  # log10 P(symbol)
    history: np.ndarray | None = None  # c(h) by symbol
    seen_scale: np.ndarray | None = None  # log10 factor of seen bigrams by history (0 but for exhausted histories)
    log_alpha: np.ndarray | None = None
    head_keys: np.ndarray | None = None
    head_log: np.ndarray | None = None
    to_rare: np.ndarray | None = None  # log10 P(class | symbol)
    after_rare: np.ndarray | None = None  # log10 P(symbol | class)
    pair_d: np.ndarray | None = None
    pair_total: np.ndarray | None = None  # words of the class after a symbol, and the two factors as above
    pair_scale: np.ndarray | None = None
    pair_alpha: np.ndarray | None = None

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.symbols[at], RARE)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """log10 share of the class of words seen ``counts`` times."""
        d = np.where(counts <= GOOD_TURING, self.rare_d[np.minimum(counts, GOOD_TURING)], 1.0)
        return np.where(counts > 0, np.log10(np.maximum(d * counts, 1e-300) / max(self.rare_total, 1)), self.rare_unknown)

    def seen(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(w | h) of bigrams with counts n; 0 counts back off."""
        h, w = key >> BITS, key & ((1 << BITS) - 1)
        d = np.where(n <= GOOD_TURING, self.bigram_d[np.minimum(n, GOOD_TURING)], 1.0)
        own = np.log10(np.maximum(d * n, 1e-300) / np.maximum(self.history[h], 1)) + self.seen_scale[h]
        return np.where(n > 0, own, self.log_alpha[h] + self.log_p[w])

    def pair(self, n: np.ndarray, total: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """log10 of the discounted share of pairs seen n times of their history's total."""
        d = np.where(n <= GOOD_TURING, self.pair_d[np.minimum(n, GOOD_TURING)], 1.0)
        return np.log10(np.maximum(d * n, 1e-300) / np.maximum(total, 1)) + scale

    def after_any(self, h: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What a word of the class, seen ``word`` times, n of them after h, adds to log10 P(class | h): nothing after a seen word of the class."""
        common = is_symbol(h)
        at = np.where(common, h, 0)
        seen = np.where(common, self.pair(n, self.pair_total[at], self.pair_scale[at]), 0.0)
        return np.where(n > 0, seen, self.rare(word) + np.where(common, self.pair_alpha[at], 0.0))

    def after_word(self, w: np.ndarray, n: np.ndarray, total: np.ndarray, kept: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log10 P(w | h) for a history of the class; but for the word's own share where w is of the class and not seen after h."""
        scale, alpha = backoff(np.maximum(total, 1), np.where(total > 0, kept, 1.0), p)
        lower = self.after_rare[np.where(is_symbol(w), w, RARE)]
        return np.where(n > 0, self.pair(n, total, scale), np.where(total > 0, alpha, 0.0) + lower)


def is_symbol(name):
    """A word goes by its symbol, or by its hash if it is of the class; for columns too."""
    return (name >= 0) & (name < 1 << BITS)


def backoff(n: np.ndarray, kept: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 factors of a history's seen words and of the lower distribution; p: what the seen words have there."""
    left, room = 1 - kept / n, 1 - p
    full = room < 1e-12  # everything was seen: nothing to back off to
    least = np.where(full, 0.0, np.maximum(left, 0.5 / (n + 1)))  # an exhausted history frees half a count
    return np.log10((1 - least) / (1 - left)), np.where(full, 0.0, np.log10(np.maximum(least, 1e-300) / np.maximum(room, 1e-12)))


def follow(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, word and text of every token, ends included."""
    ends = np.cumsum(counts + 1)
    w = np.empty(len(names) + len(counts), np.int64)
    text = np.repeat(np.arange(len(counts)), counts + 1)
    inner = np.ones(len(w), bool)
    inner[ends - 1] = False
    w[inner], w[ends - 1] = names, END
    h = np.empty(len(w), np.int64)
    h[1:] = w[:-1]
    h[ends - counts - 1] = START
    return h, w, text


def bigram_keys(model: Model, code: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and text of every token, ends included."""
    h, w, text = follow(model.symbols_of(hashes)[code], counts)
    return h << BITS | w, text


def named_pairs(model: Model, code: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, word and text of every token; words of the class by their hashes."""
    symbol = model.symbols_of(hashes)
    return follow(np.where(symbol == RARE, hashes, symbol)[code], counts)


def bigrams(model: Model):
    """(key, n): bigrams of symbols of the training texts of a slice."""

    def counted(pieces: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        found = []
        for piece in pieces:
            key, text = bigram_keys(model, *tokens(piece))
            found.append(key[training(piece)[text]])
        key = np.concatenate(found)
        del found
        key.sort()
        first = runs(key)
        return {"key": key[first], "n": np.diff(first, append=len(key))}

    return by_slice(counted)


def pairs(model: Model):
    """(h, w, n): bigrams of the training texts of a slice that have a word of the class."""

    def counted(pieces: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        found = []
        for piece in pieces:
            h, w, text = named_pairs(model, *tokens(piece))
            use = training(piece)[text] & ~(is_symbol(h) & is_symbol(w))
            found.append((h[use], w[use]))
        h, w = map(np.concatenate, zip(*found))
        del found
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        first = runs(h, w)
        return {"h": h[first], "w": w[first], "n": np.diff(first, append=len(h))}

    return by_slice(counted)


def bucket_of(key: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Bucket of keys: of bigrams of symbols (kind 0), of words of the class (kind 1), of histories of the class (kind 2)."""
    unsigned = np.ascontiguousarray(key).view(np.uint64)
    mixed = (unsigned >> np.uint64(BITS)) * np.uint64(SPREAD) + (unsigned & np.uint64((1 << BITS) - 1))
    return (mixed % np.uint64(buckets)).astype(np.int64) * KINDS + kind


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """Stable order of buckets; numpy sorts short numbers by their digits."""
    return np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max(initial=0)))), kind="stable")


def within(key: np.ndarray, buckets: int) -> np.ndarray:
    """Keys, less what their bucket tells of them; in a bucket, in the same order."""
    unsigned = np.ascontiguousarray(key).view(np.uint64)
    parts = np.uint64(-(-(1 << BITS) // buckets))
    return (unsigned >> np.uint64(BITS)) * parts + (unsigned & np.uint64((1 << BITS) - 1)) // np.uint64(buckets)


def restored(short: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """The keys of ``within``."""
    parts, count = np.uint64(-(-(1 << BITS) // buckets)), np.uint64(buckets)
    high = short // parts
    low = (short % parts) * count + (np.uint64(bucket // KINDS) + count - high * np.uint64(SPREAD) % count) % count
    return (high << np.uint64(BITS) | low).view(np.int64)


def pack(*numbers: np.ndarray) -> bytes:
    """Columns of eight-byte numbers, byte plane by byte plane: what they share lies together; compressed. The highest planes are left out if zero."""
    parts = []
    for x in numbers:
        x = np.ascontiguousarray(x)
        width = (int(x.view(np.uint64).max(initial=0)).bit_length() + 7) // 8
        parts += [bytes([width]), x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    raw = b"".join(parts)
    return len(numbers[0]).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    """The columns of ``pack``, unsigned."""
    n, size = (int.from_bytes(body[a : a + 8], "little") for a in (0, 8))
    raw, at, found = np.frombuffer(pa.decompress(body[16:], size, codec="zstd", asbytes=True), np.uint8), 0, []
    while at < size:
        width = int(raw[at])
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = raw[at + 1 : at + 1 + width * n].reshape(width, n).T
        found.append(x.view("<u8").ravel())
        at += 1 + width * n
    return found


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; their running sums are the numbers again."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def joined(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One hash of a word of the class and its neighbour, or itself (other = RARE)."""
    mixed = (key.astype(np.int64).view(np.uint64) * MIX) ^ other.astype(np.int64).view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX
    return mixed ^ (mixed >> np.uint64(32))


def squeeze_table(keys: np.ndarray, numbers: list[np.ndarray]) -> bytes:
    """Sorted hashes as differences and their numbers (counts; a history's sums too)."""
    return pack(steps(keys), *numbers)


def unsqueeze_table(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and sums (0 where there are none)."""
    keys, n, *sums = unpack(body)
    sums = [x.view("<f8") for x in sums] or [np.zeros(len(keys)), np.zeros(len(keys))]
    return np.cumsum(keys, dtype=np.uint64), n.view("<i8"), *sums


TABLE = "bucket long, body binary"


def packed_table(kind: int, buckets: int, rows: int = TABLE_ROWS):
    """mapInArrow function: rows of a table (key, other, n and a history's sums), packed by bucket, ``rows`` or a batch more at a time.

    Bigrams of symbols go by their keys, others by a hash of key and neighbour.
    """

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        key = table["key"].to_numpy()
        bucket, hashes = bucket_of(key, kind, buckets), joined(key, table["other"].to_numpy()) if kind else within(key, buckets)
        order = np.argsort(hashes)
        order = order[by_bucket(bucket[order])]
        bucket, hashes = bucket[order], hashes[order]
        numbers = [table[c].to_numpy()[order] for c in table.column_names[2:]]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(bucket))
        bodies = [squeeze_table(hashes[a:b], [x[a:b] for x in numbers]) for a, b in zip(cuts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= rows:
                yield packed(held)
                held, count = [], 0
        if count:
            yield packed(held)

    return run


def tokens_of(model: Model, piece: pa.RecordBatch, place: int) -> tuple[tuple[np.ndarray, ...], list[tuple[np.ndarray, ...]]]:
    """Numbers of every text (words, score, base, known) as far as the model has them, and per kind of bucket the tokens that need a table.

    ``place``: of the first text in its slice. Tokens: of symbols a key with the place; others word, neighbour and place.
    """
    code, counts, hashes = tokens(piece)
    n_docs = len(counts)
    key, text = bigram_keys(model, code, counts, hashes)
    at = np.minimum(np.searchsorted(model.head_keys, key), max(0, len(model.head_keys) - 1))
    head = model.head_keys[at] == key if len(model.head_keys) else np.zeros(len(key), bool)
    score = np.bincount(text[head], weights=model.head_log[at[head]], minlength=n_docs)
    history, symbol = key >> BITS, key & ((1 << BITS) - 1)
    common = symbol != RARE
    late = ~common & (history != RARE)
    score = score + np.bincount(text[late], weights=model.to_rare[history[late]], minlength=n_docs)
    plain, after = common & (history != RARE) & ~head, history == RARE
    base = np.bincount(text[common], weights=model.base(model.counts[symbol[common]]), minlength=n_docs)
    known = np.bincount(text[common & (model.counts[symbol] > 0)], minlength=n_docs)
    h, w, _ = named_pairs(model, code, counts, hashes)
    text += place
    looked_up = [(key[plain] << PLACE_BITS | text[plain],), (w[~common], h[~common], text[~common]), (h[after], w[after], text[after])]
    return (counts, score, base, known), looked_up


STREAM = "bucket long, slice long, body binary"
_STREAM = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("body", pa.binary())])


def packed_tokens(shared):
    """mapInArrow function: a slice's documents (bucket -1 - slice), and per bucket the tokens that need a table."""

    def parcels(found: list[tuple[np.ndarray, ...]], kind: int, buckets: int) -> Iterator[tuple[int, bytes]]:
        key, *more = map(np.concatenate, zip(*found))
        found.clear()
        if kind == 0:  # keys of symbols leave room for the text's place
            key.sort()
            first, end = runs(key), len(key)
            key, text, rest = key[first] >> PLACE_BITS, key[first] & (SLICE_ROWS - 1), []
        else:  # texts ascend already
            other, text = more
            order = np.lexsort((other, key))
            key, other, text = key[order], other[order], text[order]
            first, end = runs(key, other, text), len(key)
            key, text, rest = key[first], text[first], [other[first]]
        rest = [text, np.diff(first, append=end), *rest]
        bucket, short = bucket_of(key, kind, buckets), within(key, buckets)
        del key, more, first
        order = by_bucket(bucket)
        bucket = bucket[order]
        cuts = runs(bucket).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            at = order[a:b]
            yield int(bucket[a]), pack(steps(short[at]), *(x[at] for x in rest))

    def sent(number: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            schema=_STREAM,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = shared.value, RowIds()
        for whole in batches:
            for large in small_batches(whole, "text", SLICE_BYTES):
                for start in range(0, large.num_rows, SLICE_ROWS):
                    batch = large.slice(start, SLICE_ROWS)
                    number, n_docs = int(ids.take(1)[0]), 0
                    found, numbers = [[] for _ in range(KINDS)], []
                    for piece in small_batches(batch, "text", PIECE_BYTES):
                        texts, looked_up = tokens_of(model, piece, n_docs)
                        numbers.append(texts)
                        for kind in range(KINDS):
                            found[kind].append(looked_up[kind])
                        n_docs += piece.num_rows
                    counts, score, base, known = map(np.concatenate, zip(*numbers))
                    docs = pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(counts + 1), pa.array(score), pa.array(base), pa.array(known)],
                        names=["doc_id", "held_out", "n_tokens", "score", "base", "known"],
                    )
                    yield sent(number, [(-1 - number, to_bytes(docs))])
                    for kind in range(KINDS):
                        yield sent(number, list(parcels(found[kind], kind, model.buckets)))

    return run


def evaluated(shared):
    """cogroup function: a bucket's tokens and its part of the tables; sums per document, a row per slice."""

    def run(sent: pa.Table, tables: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in _STREAM.types], schema=_STREAM)
        bucket = sent["bucket"][0].as_py()
        if bucket < 0:
            return sent.select(["bucket", "slice", "body"]).cast(_STREAM)
        model, kind = shared.value, bucket % KINDS
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        keys, n, kept, p = map(np.concatenate, zip(empty, *map(unsqueeze_table, tables["body"].to_pylist())))
        order = np.argsort(keys)
        keys, n, kept, p = keys[order], n[order], kept[order], p[order]

        def found(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if not len(keys):
                return np.zeros(len(wanted), np.int64), np.zeros(len(wanted)), np.zeros(len(wanted))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            here = keys[at] == wanted
            return np.where(here, n[at], 0), np.where(here, kept[at], 0.0), np.where(here, p[at], 0.0)

        slices, bodies = [], []
        for number, body in zip(sent["slice"].to_pylist(), sent["body"].to_pylist()):
            short, place, times, *other = unpack(body)
            short, place, times = np.cumsum(short, dtype=np.uint64), place.view("<i8"), times.view("<i8")
            key = restored(short, bucket, model.buckets)
            docs = np.flatnonzero(np.bincount(place))
            total = lambda x: np.bincount(place, weights=x * times)[docs]
            if kind == 0:
                sums = [total(model.seen(key, found(short)[0]))]
            else:
                other = other[0].view("<i8")
                count, alone = found(joined(key, other))[0], found(joined(key, np.full(len(key), RARE)))
                if kind == 1:
                    word = alone[0]
                    sums = [total(model.after_any(other, count, word)), total(model.base(word)), total((word > 0).astype(float))]
                else:
                    sums = [total(model.after_word(other, count, *alone))]
            slices.append(number)
            bodies.append(pack(steps(docs), *sums))
        return pa.Table.from_arrays([pa.array([bucket] * len(slices), pa.int64()), pa.array(slices, pa.int64()), pa.array(bodies, pa.binary())], schema=_STREAM)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def gathered(parts: pa.Table) -> pa.Table:
    """applyInArrow function: a slice's documents with the sums of all buckets."""
    docs, sums = None, np.zeros((3, SLICE_ROWS))
    # in order of buckets, so that sums do not depend on the order of arrival
    for bucket, body in sorted(zip(parts["bucket"].to_pylist(), parts["body"].to_pylist()), key=lambda x: x[0]):
        if bucket < 0:
            docs = pa.ipc.open_stream(body).read_all()
        else:
            place, *more = unpack(body)
            place = np.cumsum(place.view("<i8"))
            for i, x in enumerate(more):  # the score; for words of the class the base and the known too
                sums[i, place] += x.view("<f8")
    n = docs.num_rows
    score, base, known = (docs[c].to_numpy() + sums[i, :n] for i, c in enumerate(("score", "base", "known")))
    return pa.Table.from_arrays(
        [docs["doc_id"], docs["held_out"], docs["n_tokens"].cast(pa.int64()), pa.array(np.rint(known).astype(np.int64)), pa.array(np.round(base, 6)), pa.array(np.round(score, 6))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
    )


def frequent(table: DataFrame, limit: int, least: int = 1):
    """The rows of the largest counts, at most ``limit``, as pandas: all above a cut in eighths of an octave.

    The cut comes from one number per level, so no task sends more than it has above the cut.
    """
    level = F.floor(F.log2("n") * 8)
    seen = table.where(F.col("n") >= least).groupBy(level.alias("level")).agg(F.count("*").alias("m"))
    cut, taken = None, 0
    for r in sorted(seen.collect(), key=lambda r: -r["level"]):
        taken += r["m"]
        if taken > limit:
            break
        cut = r["level"]
    if cut is None:
        return table.limit(0).toPandas()
    return table.where((F.col("n") >= least) & (level >= cut)).toPandas()


def fit_unigrams(unigram: DataFrame, ends: int, vocabulary: int) -> Model:
    """Vocabulary, totals and the class of rare words."""
    words_seen, kinds = unigram.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = frequent(unigram, vocabulary, 2)
    counts = np.zeros(FIRST + len(top), np.int64)
    counts[FIRST:] = top["n"]
    counts[END] = ends
    counts[RARE] = words_seen - counts[FIRST:].sum()
    keys = top["key"].to_numpy(np.int64)
    order = np.argsort(keys)
    spectrum = {r["n"]: r["count"] for r in unigram.where(F.col("n") <= GOOD_TURING + 1).groupBy("n").count().collect()}
    for r in np.arange(1, GOOD_TURING + 2):  # the class has the words that are not in the vocabulary
        spectrum[int(r)] = spectrum.get(int(r), 0) - int((top["n"] == r).sum())
    d = discounts(spectrum)
    freed = sum((1 - d[r]) * r * spectrum[r] for r in range(1, GOOD_TURING + 1))
    total = int(counts[RARE])
    if total and not freed:  # nothing to discount: half a count for the unknown word, off all alike
        d, freed = d * (1 - 0.5 / total), 0.5
    return Model(
        keys[order], FIRST + order, counts, int(words_seen + ends), int(kinds + (ends > 0)), total, d, float(np.log10(freed / total)) if total else 0.0
    )


def fit_bigrams(model: Model, bigram: DataFrame, head: int) -> None:
    """Discounts, history counts and backoff weights, from the bigram table; at most a row per history comes back."""
    spark = bigram.sparkSession
    k = len(model.counts)
    model.bigram_d = discounts({r["n"]: r["count"] for r in bigram.where(F.col("n") <= GOOD_TURING + 1).groupBy("n").count().collect()})
    p = (model.counts + 1.0) / (model.counts.sum() + k - 1)  # START is no outcome
    p[START] = 0.0
    p /= p.sum()
    with np.errstate(divide="ignore"):
        model.log_p = np.log10(p)
    import pandas as pd

    small = F.broadcast(spark.createDataFrame(pd.DataFrame({"w": np.arange(k), "p": p})))  # at most ``vocabulary`` rows
    d = F.element_at(F.array(*[F.lit(float(x)) for x in model.bigram_d[1:]]), F.least("n", F.lit(GOOD_TURING)).cast("int"))
    d = F.when(F.col("n") <= GOOD_TURING, d).otherwise(F.lit(1.0))
    split = bigram.select(F.shiftright("key", BITS).alias("h"), F.expr(f"key & {(1 << BITS) - 1}L").alias("w"), "n", (d * F.col("n")).alias("kept"))
    sums = split.join(small, "w").groupBy("h").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"), F.sum("p").alias("p")).toPandas()
    model.history = np.zeros(k, np.int64)
    model.seen_scale, model.log_alpha = np.zeros(k), np.zeros(k)
    h, n = sums["h"].to_numpy(np.int64), sums["n"].to_numpy(np.float64)
    model.history[h] = n.astype(np.int64)
    model.seen_scale[h], model.log_alpha[h] = backoff(n, sums["kept"].to_numpy(), sums["p"].to_numpy())
    history, symbol = F.shiftright("key", BITS), F.expr(f"key & {(1 << BITS) - 1}L")
    edge = bigram.where((history == RARE) | (symbol == RARE)).toPandas()  # at most two rows a symbol
    key, n, every = edge["key"].to_numpy(np.int64), edge["n"].to_numpy(np.int64), np.arange(k)
    to, after = np.zeros(k, np.int64), np.zeros(k, np.int64)
    first, second = key >> BITS, key & ((1 << BITS) - 1)
    to[first[second == RARE]], after[second[first == RARE]] = n[second == RARE], n[first == RARE]
    model.to_rare, model.after_rare = model.seen(every << BITS | RARE, to), model.seen(RARE << BITS | every, after)
    top = frequent(bigram.where((history != RARE) & (symbol != RARE)), head).sort_values("key")
    model.head_keys = top["key"].to_numpy(np.int64)
    model.head_log = model.seen(model.head_keys, top["n"].to_numpy(np.int64))


def fit_pairs(model: Model, pair: DataFrame, unigram: DataFrame) -> DataFrame:
    """Discounts and backoff sums of the pairs with words of the class. (h, n, kept, p) of every history; those of symbols come back."""
    import pandas as pd

    spark = pair.sparkSession
    model.pair_d = discounts({r["n"]: r["count"] for r in pair.where(F.col("n") <= GOOD_TURING + 1).groupBy("n").count().collect()})

    def kept(n: str, factors: np.ndarray):
        d = F.element_at(F.array(*[F.lit(float(x)) for x in factors[1:]]), F.least(n, F.lit(GOOD_TURING)).cast("int"))
        return F.when(F.col(n) <= GOOD_TURING, d).otherwise(F.lit(1.0)) * F.col(n)

    after = 10**model.after_rare
    small = F.broadcast(spark.createDataFrame(pd.DataFrame({"w": np.arange(len(after)), "p": after})))  # at most ``vocabulary`` rows
    share = kept("m", model.rare_d) / max(model.rare_total, 1)
    rare = pair.where(~is_symbol(F.col("w"))).join(unigram.select(F.col("key").alias("w"), F.col("n").alias("m")), "w")
    rare = rare.withColumn("p", share * F.when(is_symbol(F.col("h")), 1.0).otherwise(float(after[RARE]))).drop("m")
    both = pair.where(is_symbol(F.col("w"))).join(small, "w").unionByName(rare)
    sums = both.groupBy("h").agg(F.sum("n").alias("n"), F.sum(kept("n", model.pair_d)).alias("kept"), F.sum("p").alias("p"))
    sums = materialize(sums, "katz-histories", "zstd")
    own = sums.where(is_symbol(F.col("h"))).toPandas()  # at most ``vocabulary`` rows
    h, n = own["h"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
    model.pair_total, model.pair_scale, model.pair_alpha = np.zeros(len(after), np.int64), np.zeros(len(after)), np.zeros(len(after))
    model.pair_total[h] = n
    model.pair_scale[h], model.pair_alpha[h] = backoff(n, own["kept"].to_numpy(np.float64), own["p"].to_numpy(np.float64))
    return sums.where(~is_symbol(F.col("h")))


def katz_scores(
    docs: DataFrame,
    folds: int = 7,
    held_fold: int = 2,
    vocabulary: int = VOCABULARY,
    head: int = HEAD,
    bucket_tokens: int = BUCKET_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(fold(F.col("doc_id")), F.lit(folds)) == held_fold, F.lit(False))
    source = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held)
    counted = lambda f: source.mapInArrow(f, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    ends = source.where("not held_out").count()
    unigram = materialize(counted(unigrams), "katz-unigrams", "zstd")
    release_shuffles(spark)  # each table is written: what was sent to count it need not lie on disk beside the next
    model = fit_unigrams(unigram, ends, min(vocabulary, (1 << BITS) - FIRST))
    bigram = materialize(counted(bigrams(model)), "katz-bigrams", "zstd")
    release_shuffles(spark)
    fit_bigrams(model, bigram, head)
    pair = materialize(source.mapInArrow(pairs(model), "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n")), "katz-pairs", "zstd")
    release_shuffles(spark)
    histories = fit_pairs(model, pair, unigram)
    release_shuffles(spark)
    model.buckets = max(1, -(-model.total // bucket_tokens))
    shared = spark.sparkContext.broadcast(model)

    sent = source.mapInArrow(packed_tokens(shared), STREAM)

    def part(df: DataFrame, kind: int, key: str, other=None) -> DataFrame:
        """A table of a kind of bucket, packed: the hash of a key and its neighbour, the count, and a history's sums."""
        other = F.lit(RARE).cast("long") if other is None else F.col(other)
        sums = [c for c in ("kept", "p") if c in df.columns]
        return df.select(F.col(key).alias("key"), other.alias("other"), "n", *sums).mapInArrow(packed_table(kind, model.buckets), TABLE)

    symbols = bigram.where((F.shiftright("key", BITS) != RARE) & (F.expr(f"key & {(1 << BITS) - 1}L") != RARE))
    rare = unigram.join(_vocabulary(spark, model), "key", "left_anti")
    tables = part(symbols, 0, "key")
    for more in (
        part(rare, 1, "key"),
        part(pair.where(~is_symbol(F.col("w"))), 1, "w", "h"),
        part(histories, 2, "h"),
        part(pair.where(~is_symbol(F.col("h"))), 2, "h", "w"),
    ):
        tables = tables.unionByName(more)
    sums = sent.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(evaluated(shared), STREAM)
    return (
        sums.groupBy("slice")
        .applyInArrow(gathered, SCORES)
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
    )


def _vocabulary(spark, model: Model) -> DataFrame:
    import pandas as pd

    return F.broadcast(spark.createDataFrame(pd.DataFrame({"key": model.hashes.astype(np.int64)}), "key long"))  # at most ``vocabulary`` rows
