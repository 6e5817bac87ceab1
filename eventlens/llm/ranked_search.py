"""Ranked lexical search over posting lists that are cut into blocks by geometry, exact at any size.

Terms are coded by their document frequency, the most frequent first; a document is a vector of
impacts, a query one of weights, and the score is their inner product in whole numbers.

*Index.* Rows are dealt at random to segments of about ``SEGMENT`` postings. In a segment, each
term's posting list is clustered by document similarity (random projections of the vectors;
every posting joins its nearest pivot of the list) and cut into blocks of at most ``BLOCK``
documents. A block stores a summary: for every term, the greatest impact in its documents, rounded up. Only
terms at least as frequent as the list's are in it, for a document is meant to be found in the list of
the rarest query term that it holds. Vectors and blocks are written as one table.

*Search.* A query takes its lists from the rarest term on. It stops at the first list whose terms,
at their greatest impacts, stay below the score of its k-th best document so far; in a list it skips
the blocks whose summaries stay below that score; documents of the others are scored in full.
Summaries bound every score from above, so nothing that belongs to the best k is lost; equal
scores are never skipped. Segments give k documents each, and these are ranked together.

Queries are taken in blocks of about ``QUERY_BYTES`` of text. A block's terms go to all tasks and are
the index's vocabulary, so a pass over the documents serves one block, and its result is written
before the next one begins.

Defined cases: null and empty texts have no terms, so they are never found and count in no
statistic; repeated rows are documents of their own; repeated query rows are queries of their own;
null ids sort last among equal scores; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import RowIds, columns, ragged, small_batches, strings, text_of, words
from eventlens.session import materialize

K = 50
SEGMENT, BLOCK = 500_000, 256
#: Summaries store impacts (under 1,000,000) in units of so much, rounded up: one byte each, and still bounds.
UNIT = 8192
PIVOTS, SKETCH, SEED = 256, 32, 11
QUERY_BYTES = 16 << 20

#: ASCII letters and digits and all that is not ASCII make terms; only A-Z is lower-cased.
_BYTES = np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of every term, terms per text, distinct terms, of texts in buffers of their own."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None and data.size else data
    return words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, plain]))


VECTORS = "row long, doc_id long, n long, terms array<int>, tfs array<int>"


def _lists(values: np.ndarray, per: np.ndarray, kind: type = np.int32) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind, copy=False)))


def counted(vocabulary: pa.Array) -> Callable:
    """mapInArrow function: per document with a term, the number of its terms and the counts of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = RowIds()
        for whole in batches:
            for batch in small_batches(whole, "text"):
                code, n, names = terms(strings(batch, "text"))
                known = pc.index_in(names, vocabulary)
                at = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
                owner = np.repeat(np.arange(len(n)), n)
                pair, tf = np.unique((owner * len(vocabulary) + at)[at >= 0], return_counts=True)
                per = np.bincount(pair // max(1, len(vocabulary)), minlength=len(n))
                some = pa.array(n > 0)
                out = [pa.array(ids.take(len(n))), batch.column("doc_id"), pa.array(n), _lists(pair % max(1, len(vocabulary)), per), _lists(tf, per)]
                yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "n", "terms", "tfs"]).filter(some)

    return run


#: term -1: a document (its id, its place ``at``, its vector of codes and impacts);
#: else a block of that term's list (documents by place, its summary of codes and their greatest impacts in units).
INDEX = "seg long, term int, at int, doc_id long, members array<int>, codes array<int>, impacts array<int>, most array<tinyint>"
_INDEX = pa.schema([
    ("seg", pa.int64()), ("term", pa.int32()), ("at", pa.int32()), ("doc_id", pa.int64()),
    ("members", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())), ("most", pa.list_(pa.int8())),
])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the length of every list."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    per = pc.fill_null(pc.list_value_length(joined), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(joined).to_numpy(zero_copy_only=False).astype(np.int64), per


def _starts(per: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(per)])[:-1]


def sketches(codes: np.ndarray, weight: np.ndarray, per: np.ndarray, n_terms: int) -> np.ndarray:
    """Unit random projections of vectors: near ones have a great inner product."""
    axes = np.random.default_rng(SEED).standard_normal((n_terms, SKETCH)).astype(np.float32)
    out = np.zeros((len(per), SKETCH), np.float32)
    some = np.flatnonzero(per)
    starts = _starts(per)
    for i in range(0, len(some), 4096):
        part = some[i : i + 4096]
        at = slice(starts[part[0]], starts[part[-1]] + per[part[-1]])
        spread = axes[codes[at]] * weight[at, None].astype(np.float32)
        out[part] = np.add.reduceat(spread, starts[part] - starts[part[0]])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def clusters(near: np.ndarray, docs: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a list in order of their blocks, and the block of each: nearest pivot, cut at ``block``."""
    if len(docs) <= block:
        return docs, np.zeros(len(docs), np.int64)
    pivots = near[docs[:: max(block, -(-len(docs) // PIVOTS))]]
    found = [(s.argmax(1), s.max(1)) for s in (near[docs[i : i + 16384]] @ pivots.T for i in range(0, len(docs), 16384))]
    nearest, likeness = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((docs, -likeness, nearest))
    nearest = nearest[order]
    first = np.flatnonzero(np.diff(nearest, prepend=-1))
    place = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs))))
    return docs[order], np.cumsum(place % block == 0) - 1


def indexed(n_docs: int, n_terms_all: int, rank: np.ndarray, weight: np.ndarray, block: int = BLOCK) -> Callable:
    """applyInArrow function: the vectors and blocks of a segment. ``rank``: term to code; ``weight`` by code."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        seg = key[0].as_py()
        raw, per = _flat(table["terms"])
        tf, _ = _flat(table["tfs"])
        n = table["n"].to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(per)), per)
        order = np.lexsort((rank[raw], owner))  # every vector from its most frequent term on
        codes, tf = rank[raw][order], tf[order]
        m = 50 + (50 * n * n_docs) // max(1, n_terms_all)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
        starts = _starts(per)
        near = sketches(codes, weight[codes] * impact, per, len(rank))
        by_term = np.argsort(codes, kind="stable")
        lists = np.flatnonzero(np.diff(codes[by_term], prepend=-1))
        parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(lists, np.append(lists[1:], len(by_term))):
            term = int(codes[by_term[a]])
            docs, number = clusters(near, owner[by_term[a:b]], block)
            depth = np.empty(len(per), np.int64)
            depth[owner[by_term[a:b]]] = by_term[a:b] - starts[owner[by_term[a:b]]] + 1  # terms down to the list's
            at = ragged(starts[docs], depth[docs])
            pair = np.repeat(number, depth[docs]) * (term + 1) + codes[at]
            sort = np.argsort(pair)
            first = np.flatnonzero(np.diff(pair[sort], prepend=-1))
            top = np.maximum.reduceat(impact[at][sort], first)
            held = pair[sort][first]
            blocks = int(number[-1]) + 1
            units = (-(-top // UNIT)).astype(np.int8)
            parts.append((term, docs.astype(np.int32), np.bincount(number), (held % (term + 1)).astype(np.int32), units, np.bincount(held // (term + 1), minlength=blocks)))
        members = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        size = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        width = np.concatenate([p[5] for p in parts]) if parts else np.zeros(0, np.int64)
        none = np.zeros(len(per), np.int64)
        list_of = np.concatenate([np.full(len(p[2]), p[0]) for p in parts]) if parts else np.zeros(0, np.int64)
        of = lambda i: [p[i] for p in parts]
        ids = pa.concat_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), pa.nulls(len(size), pa.int64())])
        rows = len(per) + len(size)
        return pa.table([
            pa.array(np.full(rows, seg)), pa.array(np.concatenate([none - 1, list_of]).astype(np.int32)),
            pa.array(np.concatenate([np.arange(len(per)), np.arange(len(size))]).astype(np.int32)), ids,
            _lists(members, np.concatenate([none, size])), _lists(np.concatenate([codes.astype(np.int32), *of(3)]), np.concatenate([per, width])),
            _lists(impact, np.concatenate([per, 0 * width])), _lists(np.concatenate([np.zeros(0, np.int8), *of(4)]), np.concatenate([none, width]), np.int8),
        ], schema=_INDEX)

    return run


class Segment:
    """A segment's vectors and blocks, read from the index table."""

    def __init__(self, table: pa.Table, n_terms: int):
        docs = table.filter(pc.less(table["term"], 0)).sort_by("at")
        blocks = table.filter(pc.greater_equal(table["term"], 0)).sort_by([("term", "ascending"), ("at", "ascending")])
        self.ids = docs["doc_id"].combine_chunks()
        null = np.asarray(pc.is_null(self.ids))
        number = pc.fill_null(self.ids, 0).to_numpy(zero_copy_only=False)
        self.order = np.empty(len(number), np.int64)  # places in order of ids, null ids last
        self.order[np.lexsort((number, null))] = np.arange(len(number))
        self.codes, self.per = _flat(docs["codes"])
        self.impacts, _ = _flat(docs["impacts"])
        self.at = _starts(self.per)
        self.members, self.size = _flat(blocks["members"])
        self.begin = _starts(self.size)
        self.sum_codes, self.width = _flat(blocks["codes"])
        self.sum_impacts = _flat(blocks["most"])[0] * UNIT
        self.sum_at = _starts(self.width)
        term = blocks["term"].to_numpy().astype(np.int64)
        self.first = np.searchsorted(term, np.arange(n_terms + 1))  # blocks of term t: first[t] to first[t + 1]
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, self.codes, self.impacts)
        self.scored = 0  # documents scored in full, for tests and figures

    def best(self, codes: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of a query (codes ascending), best first."""
        dense = np.zeros(len(self.most), np.int64)
        dense[codes] = weight
        bound = np.cumsum(weight * self.most[codes])  # of documents whose rarest query term is the i-th
        seen = np.zeros(len(self.per), bool)
        place, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for i in range(len(codes) - 1, -1, -1):
            if bound[i] < least:
                break
            a, b = self.first[codes[i]], self.first[codes[i] + 1]
            if a == b:
                continue
            lo, hi = self.sum_at[a], self.sum_at[b - 1] + self.width[b - 1]
            most = np.add.reduceat(dense[self.sum_codes[lo:hi]] * self.sum_impacts[lo:hi], self.sum_at[a:b] - lo)
            rank = np.argsort(-most, kind="stable")
            step = 4
            while len(rank) and most[rank[0]] >= least:
                take, rank, step = rank[:step], rank[step:], step * 2
                take = take[most[take] >= least] + a
                docs = self.members[ragged(self.begin[take], self.size[take])]
                docs = np.unique(docs[~seen[docs]])
                if not len(docs):
                    continue
                seen[docs] = True
                self.scored += len(docs)
                at = ragged(self.at[docs], self.per[docs])
                found = np.add.reduceat(dense[self.codes[at]] * self.impacts[at], _starts(self.per[docs]))
                good = found >= least
                place, score = np.concatenate([place, docs[good]]), np.concatenate([score, found[good]])
                best = np.lexsort((self.order[place], -score))[:k]
                place, score = place[best], score[best]
                if len(score) == k:
                    least = max(1, int(score[-1]))
        return place, score


FOUND = "query long, doc_id long, score long"


def searched(queries: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int, k: int) -> Callable:
    """applyInArrow function: the k best documents of a segment for every query."""

    def run(table: pa.Table) -> pa.Table:
        segment = Segment(table, n_terms)
        out: list[list[np.ndarray]] = [[], [], []]
        for number, codes, weight in queries:
            place, score = segment.best(codes, weight, k)
            for kept, x in zip(out, (np.full(len(place), number), place, score)):
                kept.append(x)
        query, place, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table([pa.array(query), segment.ids.take(pa.array(place)), pa.array(score)], names=["query", "doc_id", "score"])

    return run


def _block_of_queries(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Vocabulary of queries, and their distinct (query, term) pairs in order of queries."""
    code, n, names = terms(strings(rows.combine_chunks().to_batches()[0], "text"))
    pair = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(names)) + code)
    return names, pair // max(1, len(names)), pair % max(1, len(names))


def index_documents(source: DataFrame, vocabulary: pa.Array, segment: int = SEGMENT, block: int = BLOCK):
    """Index of (doc_id, text) rows for a vocabulary: table, code of each term, weight by code; None without documents."""
    vectors = materialize(source.mapInArrow(counted(vocabulary), VECTORS), "search-vectors")
    stats = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"), F.sum(F.size("terms")).alias("postings")).first()
    if not stats["docs"]:
        return None
    df = np.zeros(len(vocabulary), np.int64)  # one number per term of the queries
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        df[row["t"]] = row["n"]
    by_df = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int64)
    rank[by_df] = np.arange(len(df))
    weight = np.floor(1000 * np.log((2 * stats["docs"] + 2) / (2 * df[by_df] + 1))).astype(np.int64)
    weight[df[by_df] == 0] = 0
    parts = -(-stats["postings"] // segment) or 1
    dealt = vectors.where(F.size("terms") > 0).withColumn("seg", F.pmod(F.xxhash64("row"), F.lit(parts)))
    fit = indexed(stats["docs"], stats["terms"], rank, weight, block)
    table = materialize(dealt.groupBy("seg").applyInArrow(fit, INDEX), "search-index")
    return table, rank, weight


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    segment: int = SEGMENT,
    block: int = BLOCK,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: for every query row its k best documents with a score above 0."""
    source = columns(docs, doc_id=doc_id, text=doc_text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = columns(queries, item_id=query_id, text=query_text).select(F.monotonically_increasing_id().alias("query"), "item_id", text_of("text").alias("text"))
    asked = materialize(asked, "search-queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // query_bytes) or 1)
    found = []
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).orderBy("query").toArrow()
        if not rows.num_rows:
            continue
        vocabulary, owner, term = _block_of_queries(rows)
        index = index_documents(source, vocabulary, segment, block) if len(vocabulary) else None
        if index is None:
            continue
        table, rank, weight = index
        numbers = rows["query"].to_numpy()
        cuts = np.searchsorted(owner, np.arange(len(numbers) + 1))
        coded = [(int(q), np.sort(rank[term[a:b]])) for q, a, b in zip(numbers, cuts, cuts[1:]) if b > a]
        run = searched([(q, c, weight[c]) for q, c in coded], len(rank), k)
        found.append(materialize(table.groupBy("seg").applyInArrow(run, FOUND), "search-found"))
    every = found[0] if found else asked.sparkSession.createDataFrame([], FOUND)
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
q AS (
  SELECT item_id, row_number() OVER () AS qr,
         unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark),
t AS (
  SELECT doc_id, r, n, term, count(*) AS tf
  FROM (SELECT doc_id, r, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, big_n),
x AS (
  SELECT t.doc_id, t.r, t.term, f.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))) AS part
  FROM t JOIN f USING (term), s),
h AS (SELECT item_id, qr, doc_id, r, sum(part)::BIGINT AS score FROM q JOIN x USING (term) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id, r) AS rank FROM h WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""
