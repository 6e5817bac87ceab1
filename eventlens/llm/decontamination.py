"""Benchmark decontamination by CGK embedding, bit-sampling LSH, exact segments and edit verification.

Texts are sequences of words (lower case, punctuation at the ends taken off). The CGK embedding
walks along a sequence: step j writes the word under it and moves on if the j-th random bit of
that word says so. Two sequences at a small edit distance meet again after an edit and then
write the same, so edit distance becomes Hamming distance. A repetition is one such walk, with
random bits of its own, of which a few steps are sampled as the hash key.

Items of SHORT words or more are walked from every word of theirs, documents from every ``stride``-th word; a shared
key makes the document's window of the item's size, around the place where the item would lie, a
candidate. With the edits of an item spread at the allowed share, a window of WALK steps is
met whole by a repetition with probability about 0.8 ** (WALK / 2 + 1) = 0.26; an item of n words
has about n / stride - 2 windows, each tried by REPEATS walks. (tests measure the recall.)
Keys that come from fewer than PLACES different words are left out: other repetitions of the
window, and its neighbours, stand in.

A shorter item has too few such windows. It is cut into one segment more than it may have edits, so
that one of them lies in the document unchanged: the segments are looked up from every word of the
document, and no occurrence is missed.

Candidates pass a lossless count (at distance d at least n - d words must be shared) and then an
exact check: the least word edit distance of the item to any part of the window, by Myers' bit
vectors. A document is contaminated by an item of n words at (1 - threshold) * n edits or fewer.

The benchmark is the query set: it is read in blocks of bounded size, each sent to all
tasks, and every document is walked once per block. Nothing is shuffled, and no task holds more
than a slice of documents.

Defined cases: null and empty texts match nothing; items of fewer than ``min_words`` words (five,
the usual shingle) are no evidence and match nothing; an item that occurs several times in
a document gives one row, with the fewest edits, then the first place; repeated rows give rows
each; copies of an item under two ids give a row each; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import columns, ragged, small_batches, strings, words

WALK, SAMPLED, PLACES = 10, (1, 3, 5, 7, 9), 4  # steps of a walk, those that make a key, and different words that it must have seen
REPEATS, STRIDE = 5, 3
SHORT = 25  # items of fewer words are found by segments
PAIRS = 1 << 20  # candidates that are tested at a time
THRESHOLD, MIN_WORDS = 0.8, 5
BLOCK_BYTES = 16 << 20  # benchmark text in a block
MIX = np.uint64(0x9E3779B97F4A7C15)
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‘’«»…–—¿¡"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word that has more than punctuation, text after text, and words per text. Never 0."""
    import xxhash

    code, counts, names = words(pc.utf8_lower(texts))
    bare = pc.utf8_trim(names, characters=EDGES).to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in bare), np.uint64, len(bare))[code]
    real = h != 0
    if not real.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[real], minlength=len(counts)).astype(np.int64)
        h = h[real]
    return h, counts


def padded(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences in one array, WALK zeros after each; and where each starts."""
    starts = np.cumsum(counts + WALK) - counts - WALK
    out = np.zeros(int((counts + WALK).sum()), np.uint64)
    out[ragged(starts, counts)] = h
    return out, starts


def walk_keys(seq: np.ndarray, at: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, usable) of the walk from every place in ``at``."""
    bits = ((seq ^ np.uint64(repeat * 2 + 1)) * MIX >> np.uint64(40)).astype(np.uint32)
    place, key = at.copy(), np.zeros(len(at), np.uint64)
    moved, last = np.zeros(len(at), np.int8), None
    for j in range(WALK):
        if j in SAMPLED:
            key = (key ^ seq[place]) * MIX
            key ^= key >> np.uint64(29)
            if last is not None:
                moved += place != last
            last = place.copy()
        place += (bits[place] >> np.uint32(j)) & np.uint32(1)
    return key, moved >= PLACES - 1


def segments(size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, words) of the segments of items of ``size`` words: one more than the allowed edits."""
    n = np.minimum(allowed(size, threshold) + 1, size)
    item = np.repeat(np.arange(len(size)), n)
    number = ragged(np.zeros(len(size), np.int64), n)
    first, end = (number * size[item]) // n[item], ((number + 1) * size[item]) // n[item]
    return item, first, end - first


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of segments with one word more."""
    key = (key ^ word) * MIX
    return key ^ key >> np.uint64(29)


def index(key: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, with item and place of each, and which upper 20 bits occur."""
    order = np.argsort(key, kind="stable")
    heads = np.zeros(1 << 20, bool)
    heads[(key[order] >> np.uint64(44)).astype(np.int64)] = True
    return key[order], item[order], place[order], heads


@dataclass
class Items:
    """A block of benchmark items, the keys of the walks of long ones and of the segments of short ones."""

    ids: np.ndarray
    seqs: list[np.ndarray]
    #: per repetition: sorted keys, with item and place of each; and which upper 20 bits occur.
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: the same per number of words in a segment
    segments: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: sorted (item * distinct words + word) for the count, and the distinct words.
    vocabulary: np.ndarray
    members: np.ndarray
    least: np.ndarray  # words that must be shared


def build_items(ids: list[int], texts: list[str], threshold: float, min_words: int) -> Items | None:
    h, counts = word_hashes(pa.array(texts, pa.large_string()))
    cuts = np.cumsum(counts)
    seqs = [s for s in np.split(h, cuts[:-1])] if len(texts) else []
    keep = [i for i in range(len(seqs)) if len(seqs[i]) >= min_words]
    if not keep:
        return None
    ids_, seqs = np.array(ids, np.int64)[keep], [seqs[i] for i in keep]
    size = np.array([len(s) for s in seqs])
    flat, starts = padded(np.concatenate(seqs), size)
    at, item = ragged(starts, size), np.repeat(np.arange(len(seqs)), size)
    keys, parts = [], {}
    long = size[item] >= SHORT
    for r in range(REPEATS if long.any() else 0):
        key, ok = walk_keys(flat, at[long], r)
        keys.append(index(key[ok], item[long][ok], (at - np.repeat(starts, size))[long][ok]))
    short = np.flatnonzero(size < SHORT)
    owner, first, length = segments(size[short], threshold)
    owner = short[owner]
    key = np.zeros(len(owner), np.uint64)
    for n in range(1, int(length.max(initial=0)) + 1):
        reach = length >= n
        key[reach] = longer(key[reach], flat[starts[owner[reach]] + first[reach] + n - 1])
        if (length == n).any():
            parts[n] = index(key[length == n], owner[length == n], first[length == n])
    vocabulary = np.unique(np.concatenate(seqs))
    members = np.unique(item * len(vocabulary) + np.searchsorted(vocabulary, np.concatenate(seqs)))
    least = size - allowed(size, threshold)
    return Items(ids_, seqs, keys, parts, vocabulary, members, least)


def allowed(n, threshold: float):
    return np.floor((1 - threshold) * np.asarray(n) + 1e-9).astype(np.int64)


def matches(table: tuple, key: np.ndarray, doc: np.ndarray, offset: np.ndarray) -> Iterator[np.ndarray]:
    """(document, item, first word of the item) rows of equal keys, distinct up to a few words' shift, about PAIRS at a time."""
    keys, item, place, heads = table
    hit = np.flatnonzero(heads[(key >> np.uint64(44)).astype(np.int64)])
    low = np.searchsorted(keys, key[hit], "left")
    n = np.searchsorted(keys, key[hit], "right") - low
    hit, low, n = hit[n > 0], low[n > 0], n[n > 0]
    part = np.cumsum(n) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(hit)]
    for a, b in zip(cuts, cuts[1:]):
        which = np.repeat(hit[a:b], n[a:b])
        found = ragged(low[a:b], n[a:b])
        first = offset[which] - place[found]
        yield distinct(np.stack([doc[which], item[found], (first + 4) // 8], axis=1))


def distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def candidates(items: Items, seq: np.ndarray, starts: np.ndarray, counts: np.ndarray, stride: int) -> Iterator[np.ndarray]:
    """(document, item, first word of the item) rows by walks and by segments, in parts of bounded size."""
    per = -(-counts // stride)
    doc = np.repeat(np.arange(len(counts)), per)
    offset = ragged(np.zeros(len(counts), np.int64), per) * stride
    at = starts[doc] + offset
    for r, table in enumerate(items.keys):
        key, ok = walk_keys(seq, at, r)
        yield from matches(table, key[ok], doc[ok], offset[ok])
    if not items.segments:
        return
    doc = np.repeat(np.arange(len(counts)), counts)
    offset = ragged(np.zeros(len(counts), np.int64), counts)
    key = np.zeros(len(doc), np.uint64)
    for n in range(1, max(items.segments) + 1):
        inside = offset + n <= counts[doc]
        doc, offset, key = doc[inside], offset[inside], key[inside]
        key = longer(key, seq[starts[doc] + offset + n - 1])
        if n in items.segments:
            yield from matches(items.segments[n], key, doc, offset)


def least_distance(pattern: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(edits, end) of the part of ``text`` closest to ``pattern``, if within ``most`` edits: Myers' bit vectors."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, (min(m, most + 1), 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        xv = eq | vn
        xh = ((((eq & vp) + vp) ^ vp) | eq) & full
        hp = (vn | ~(xh | vp)) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full  # no cost for words in front
        vp = (hn | ~(xv | hp)) & full
        vn = hp & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


HITS = "doc_id long, item_id long, edits int, item_words int, similarity double, first_word long, last_word long, text_key long"
_HITS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("similarity", pa.float64()),
     ("first_word", pa.int64()), ("last_word", pa.int64()), ("text_key", pa.int64())]
)


def find_hits(items: Items, texts: pa.Array, threshold: float, stride: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, first word, end word) of every contaminated pair."""
    h, counts = word_hashes(texts)
    seq, starts = padded(h, counts)
    sizes = np.array([len(s) for s in items.seqs])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: set[tuple[int, int, int]] = set()
    for found in candidates(items, seq, starts, counts, stride):
        verify(items, seq, starts, counts, sizes, found, best, done)
    return [(d, i, *row) for (d, i), row in best.items()]


def verify(items: Items, seq: np.ndarray, starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, found: np.ndarray, best: dict, done: set) -> None:
    """Put the contaminated pairs of ``found`` into ``best``; ``done`` has the candidates that were verified."""
    doc, item, first = found[:, 0], found[:, 1], found[:, 2] * 8 - 4
    size = sizes[item]
    slack = size - items.least[item]
    low = np.clip(first - slack, 0, counts[doc])
    high = np.clip(first + 8 + size + slack, 0, counts[doc])
    # lossless: words of the window that the item has, at least as many as must be shared
    keep = np.zeros(len(found), bool)
    for a in range(0, len(found), 200_000):
        part = slice(a, a + 200_000)
        n = (high - low)[part]
        window = seq[ragged(starts[doc[part]] + low[part], n)]
        code = np.minimum(np.searchsorted(items.vocabulary, window), len(items.vocabulary) - 1)
        known = items.vocabulary[code] == window
        owner = np.repeat(np.arange(len(n)), n)
        pair = item[part][owner] * len(items.vocabulary) + code
        at = np.minimum(np.searchsorted(items.members, pair), len(items.members) - 1)
        shared = np.bincount(owner[known & (items.members[at] == pair)], minlength=len(n))
        keep[part] = shared >= items.least[item[part]]
    for k in np.flatnonzero(keep):
        d, i = int(doc[k]), int(item[k])
        if (d, i, int(first[k])) in done:
            continue
        done.add((d, i, int(first[k])))
        window = seq[starts[d] + low[k] : starts[d] + high[k]].tolist()
        pattern = items.seqs[i].tolist()
        hit = least_distance(pattern, window, int(slack[k]))
        if hit:
            edits, end = hit
            back = least_distance(pattern[::-1], window[end - 1 :: -1] if end else [], edits)
            start = end - back[1] if back else max(0, end - len(pattern))
            row = (edits, int(low[k]) + start, int(low[k]) + end)
            if row < best.get((d, i), (1 << 60, 0, 0)):
                best[d, i] = row


def benchmark_blocks(benchmark: DataFrame, threshold: float, min_words: int, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes`` of text; one block on the driver at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row["text"]:
            ids.append(-1 if row["item_id"] is None else row["item_id"])
            texts.append(row["text"])
            size += len(row["text"])
        if size >= block_bytes:
            if block := build_items(ids, texts, threshold, min_words):
                yield block
            ids, texts, size = [], [], 0
    if block := build_items(ids, texts, threshold, min_words):
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    min_words: int = MIN_WORDS,
    stride: int = STRIDE,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per contaminated (document row, item): ids, edits, similarity and the words it lies at."""
    spark = docs.sparkSession
    source = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    queries = columns(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = None
    for block in benchmark_blocks(queries, threshold, min_words, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for whole in batches:
                for batch in small_batches(whole, "text", 6 << 20):
                    rows = find_hits(items, strings(batch, "text"), threshold, stride)
                    if rows:
                        row, item, edits, first, end = (np.array(c, np.int64) for c in zip(*rows))
                        size = np.array([len(s) for s in items.seqs])[item]
                        keys = batch.take(pa.array(row))
                        yield pa.RecordBatch.from_arrays(
                            [keys.column("doc_id").cast(pa.int64()), pa.array(items.ids[item]), pa.array(edits.astype(np.int32)), pa.array(size.astype(np.int32)),
                             pa.array(np.round(1 - edits / size, 6)), pa.array(first), pa.array(end - 1), keys.column("text_key").cast(pa.int64())],
                            schema=_HITS,
                        )

        found = source.mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS) if out is None else out
