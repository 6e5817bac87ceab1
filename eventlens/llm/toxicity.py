"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give every word a probability as a sequence of
characters between word borders, so a rare or new form of an expression is known by its parts.
A class's model discounts its own n-gram counts and backs off to an interpolated Kneser-Ney
model of the counts of both classes together. Where a class knows nothing of its own, both
models fall back to the same counts, and the word says nothing for either class.

Beside them stand two models of words as wholes, of the same kind: a class discounts its own word
counts and backs off to the counts of both classes together, so an expression that one class
alone uses tells much, and more with every text that uses it. A word's evidence is the sum of both
differences; a word that no labelled text holds has that of its characters.

A word counts once for every text, and at most once for every pair of words around it, so copies of a
text and runs of a word teach a model little more than one of them.

Most words of a toxic text are ordinary: the toxic likelihood of a word is a mixture, a small
share from the toxic model and the rest from the ordinary one, so plain words say nearly
nothing, in whatever language, and toxic expressions nearly all they can. A text's evidence
is the difference of its two log-likelihoods per symbol (characters and word ends). A logistic curve
makes it a score between 0 and 1; it is fitted on the evidence that each half of the labelled texts
has under models of the other half, while the models that score are fitted on all of them.

The models are fitted on a bounded sample of labelled texts: about ``per_class`` of each class
at most, those with small hashes of their doc_id. Scoring covers all rows and whole texts.

Defined cases: null and empty texts have evidence 0; a doc_id labelled twice is toxic if any
of its labels is; null labels and ids are not learned from; with fewer than two classes among
the labels the score is the share of toxic labels (0.5 without any); a null doc_id is not held
out; repeated rows are scored each for itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import RowIds, columns, hash_sample, ragged, small_batches, strings, words
from eventlens.session import materialize, release_shuffles

ORDER = 5  # characters of an n-gram at most
PER_CLASS = 3000
SHARE = 0.001  # of a toxic text's words that its own model makes; the ordinary model makes the others
STEADY = 100  # symbols of no evidence added to every text, so that a few symbols alone say little
START, END = "\x02", "\x03"
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(ORDER)]


def fold(col: Column) -> Column:
    """crc32 of a doc_id as text."""
    return F.crc32(col.cast("string").cast("binary"))


GRAMS = "label int, g long, suffix long, context long, size int, first boolean, n long"


def word_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Character n-grams up to ORDER, borders included, of words (label, word, n), as numbers: the hashes of
    the n-gram, of it without its first and without its last symbol, its size, and whether it begins a word."""
    for batch in batches:
        sums: Counter[tuple[int, str]] = Counter()
        for label, word, n in zip(batch["label"], batch["word"], batch["n"]):
            w = START + word + END
            for i in range(1, len(w)):
                for k in range(1, min(ORDER, i + 1) + 1):
                    sums[label, w[i + 1 - k : i + 1]] += n
        grams = [gram for _, gram in sums]
        yield pd.DataFrame({
            "label": np.array([label for label, _ in sums], np.int32), "g": gram_hash(grams).view(np.int64),
            "suffix": gram_hash([g[1:] for g in grams]).view(np.int64), "context": gram_hash([g[:-1] for g in grams]).view(np.int64),
            "size": np.array([len(g) for g in grams], np.int32), "first": np.array([g[0] == START for g in grams], bool), "n": np.array(list(sums.values()), np.int64),
        })


def word_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (label, half, word, h, context, doc) of lower-cased words; h: the word's hash, context: one of the words on both sides."""
    import xxhash

    ids = RowIds()
    for whole in batches:
        for batch in small_batches(whole, "text"):
            code, counts, names = words(pc.utf8_lower(strings(batch, "text")))
            if not len(code):
                continue
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_pylist()), np.uint64, len(names))[code]
            ends = np.cumsum(counts[counts > 0])
            before, after = np.roll(h, 1), np.roll(h, -1)
            before[np.concatenate([[0], ends[:-1]])] = 0
            after[ends - 1] = 0
            label, half = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32), counts) for c in ("label", "half"))
            doc = np.repeat(ids.take(len(counts)), counts)
            context = before * BASE + after
            keys = np.stack([doc.view(np.uint64), code.astype(np.uint64), context], axis=1)
            at = np.unique(keys, axis=0, return_index=True)[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[at]), pa.array(half[at]), names.take(pa.array(code[at])), pa.array(h[at].view(np.int64)), pa.array(context[at].view(np.int64)), pa.array(doc[at])],
                names=["label", "half", "word", "h", "context", "doc"],
            )


def gram_hash(grams: list[str]) -> np.ndarray:
    """Polynomial hash of strings over code points, the last character first, modulo 2**64."""
    out = np.zeros(len(grams), np.uint64)
    if not grams:
        return out
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(size)
    for k, power in enumerate(POWERS):
        has = size > k
        out[has] += (points[ends[has] - 1 - k] + np.uint64(1)) * power
    return out


@dataclass
class Evidence:
    """Log-probability differences of the classes: per n-gram, and per context of other symbols. Sorted by hash."""

    grams: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    whole: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))  # by word

    def words(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(evidence, symbols) of words; a symbol's context are the ORDER - 1 symbols before it, or all back to the word's start."""
        text = [START + w + END for w in names]
        size = np.fromiter(map(len, text), np.int64, len(text))
        points = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        at = ragged(np.cumsum(size) - size + 1, size - 1)  # all symbols but the start
        depth = np.minimum(ragged(np.ones(len(size), np.int64), size - 1), ORDER - 1)
        context = np.zeros(len(at), np.uint64)
        for k, power in enumerate(POWERS[: ORDER - 1]):
            has = depth > k
            context[has] += points[at[has] - 1 - k] * power
        found, value = look_up(*self.grams, context * BASE + points[at])
        rest = np.flatnonzero(~found)
        known, back = look_up(*self.contexts, context[rest])
        value = np.where(found, value, 0.0)
        value[rest[known]] = back[known]
        parts = np.bincount(np.repeat(np.arange(len(size)), size - 1), weights=value, minlength=len(size))
        if not len(self.whole[0]):
            return parts, size - 1
        import xxhash

        known, own = look_up(*self.whole, np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)))
        return parts + np.where(known, own, 0.0), size - 1


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def discounts(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def kneser_ney(grams: pd.DataFrame) -> Evidence:
    """The two models of n-grams (g, suffix, context, size, first, n0, n1), as differences toxic - ordinary of log probabilities.

    Over both classes together: interpolated Kneser-Ney of all orders. Each class: its own
    counts of the longest n-grams, discounted, and the rest of the mass after the shared model.
    """
    column = lambda c: grams[c].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(column("g"))
    g, suffix, context = (column(c)[order] for c in ("g", "suffix", "context"))
    size, first = grams["size"].to_numpy()[order], grams["first"].to_numpy(bool)[order]
    raw = grams[["n0", "n1"]].to_numpy(np.float64)[order]
    place = np.minimum(np.searchsorted(g, suffix), len(g) - 1)  # every n-gram's suffix is one too, but for single symbols
    contexts, code = np.unique(context, return_inverse=True)
    # lower orders count distinct characters in front; at the start of a word, where there are none, occurrences
    shared = np.bincount(place[size > 1], minlength=len(g)).astype(np.float64)
    top = (size == ORDER) | first
    shared[top] = raw[top].sum(1)
    prob = np.zeros(len(g))
    alphabet = max(1, int((size == 1).sum()))
    for k in range(1, ORDER + 1):
        own = np.flatnonzero(size == k)
        u, c = shared[own], code[own]
        discount = discounts(u)
        total = np.bincount(c, weights=u, minlength=len(contexts))[c]
        kinds = np.bincount(c, minlength=len(contexts))[c]
        below = 1.0 / alphabet if k == 1 else prob[place[own]]
        prob[own] = np.maximum(u - discount, 0) / total + discount * kinds / total * below

    own = np.flatnonzero(top)
    c, logs, backs = code[own], [], []
    for label in (0, 1):
        u = raw[own, label]
        discount = discounts(u)
        total = np.bincount(c, weights=u, minlength=len(contexts))
        kinds = np.bincount(c, weights=u > 0, minlength=len(contexts))
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(u - discount, 0) / np.maximum(total, 1)[c] + back[c] * prob[own]))
        backs.append(np.log(back))
    used = np.unique(c)
    return Evidence((g[own], logs[1] - logs[0]), (contexts[used], (backs[1] - backs[0])[used]))


def whole_words(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word models of counts (word, class 0/1), as differences toxic - ordinary of log probabilities, sorted by hash.

    A class's counts are discounted, and the mass that this frees goes by the counts of both classes.
    """
    both = counts.sum(1) / max(1.0, counts.sum())
    logs = []
    for label in (0, 1):
        u = counts[:, label].astype(np.float64)
        total, discount = max(1.0, u.sum()), discounts(u)
        free = discount * (u > 0).sum() / total if u.sum() else 1.0
        logs.append(np.log(np.maximum(u - discount, 0) / total + free * both))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], (logs[1] - logs[0])[order]


def text_evidence(model: Evidence, texts: pa.Array, cache: dict[str, tuple[float, int]], most: int = 200_000) -> np.ndarray:
    """Evidence per symbol of every text; cache: what distinct words gave, bounded."""
    code, counts, names = words(pc.utf8_lower(texts))
    listed = names.to_pylist()
    new = [w for w in listed if w not in cache]
    if len(cache) + len(new) > most:
        cache.clear()
        new = listed
    for a in range(0, len(new), 40_000):
        value, size = model.words(new[a : a + 40_000])
        value = np.log1p(SHARE * np.expm1(np.clip(value, -30, 30)))
        cache.update(zip(new[a : a + 40_000], zip(value.tolist(), size.tolist())))
    both = np.array([cache[w] for w in listed], np.float64).reshape(-1, 2)
    upto = np.concatenate([np.zeros((1, 2)), np.cumsum(both[code], axis=0)])
    ends = np.cumsum(counts)
    sums = upto[ends] - upto[ends - counts]
    return sums[:, 0] / (sums[:, 1] + STEADY)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5) -> tuple[float, float, float]:
    """(a, b, scale): score = 1 / (1 + exp(-(a x / scale + b))), by Newton steps."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.diag([1.0, 0.01]) + 1e-9 * np.eye(2), z.T @ (y - p) - ridge * len(x) * np.array([w[0], 0]))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), scale


def fit(docs: DataFrame, learn: DataFrame, per_class: int = PER_CLASS) -> tuple[Evidence | None, tuple[float, float, float]]:
    """Models and curve from learn (doc_id, label 0/1), a bounded sample of it."""
    ordered = learn.withColumn("h", F.xxhash64("doc_id"))
    sample = None
    for label in (0, 1):
        part = hash_sample(ordered.where(F.col("label") == label), "doc_id", per_class, 4)
        sample = part if sample is None else sample.unionByName(part)
    known = sample.toPandas()  # about 2 * per_class ids at most
    share = float(known["label"].mean()) if len(known) else 0.5
    flat = (0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share == 1 else -30.0), 1.0)
    if known["label"].nunique() < 2:
        return None, flat
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame(known[["doc_id", "label", "h"]]))  # bounded by per_class
    texts = docs.join(keys, "doc_id").select("label", "text", F.pmod(F.col("h"), F.lit(2)).cast("int").alias("half"))
    schema = "label int, half int, word string, h long, context long, doc long"
    found = materialize(texts.mapInArrow(word_contexts, schema).distinct(), "toxicity-words")  # of the sample's texts

    def fitted(use: DataFrame) -> Evidence | None:
        seen = F.least(F.countDistinct("context"), F.countDistinct("doc"))
        own = materialize(use.groupBy("label", "word", "h").agg(seen.alias("n")), "toxicity-counts")
        of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
        grams = own.mapInPandas(word_grams, GRAMS).groupBy("g", "suffix", "context", "size", "first").agg(of(0).alias("n0"), of(1).alias("n1"))
        # numbers, a row per n-gram of at most 2 * per_class texts; moved, not copied
        counts = grams.toArrow().to_pandas(self_destruct=True, split_blocks=True)
        if not len(counts) or not (counts[["n0", "n1"]].sum() > 0).all():
            return None
        model = kneser_ney(counts)
        words_seen = own.groupBy("h").agg(of(0).alias("n0"), of(1).alias("n1")).toPandas()  # numbers, a row per word of these texts
        model.whole = whole_words(words_seen["h"].to_numpy(np.int64), words_seen[["n0", "n1"]].to_numpy(np.float64))
        del counts, words_seen
        pa.default_memory_pool().release_unused()
        release_shuffles(spark)  # three models are fitted one after the other: what the last one took is given back
        return model

    def measured(half: int) -> pd.DataFrame:
        """(label, x) of a half's texts under models of the other half."""
        model = fitted(found.where(F.col("half") != half))
        if model is None:
            return pd.DataFrame({"label": [], "x": []})
        shared = spark.sparkContext.broadcast(model)

        def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache: dict[str, tuple[float, int]] = {}
            for whole in batches:
                for batch in small_batches(whole, "text", 10 << 20):
                    x = text_evidence(shared.value, strings(batch, "text"), cache)
                    yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(x)], names=["label", "x"])

        out = texts.where(F.col("half") == half).select("label", "text").mapInArrow(evidence, "label int, x double").toPandas()
        shared.destroy()
        return out

    seen = pd.concat([measured(0), measured(1)])
    model = fitted(found)
    if model is None or seen["label"].nunique() < 2:
        return None, flat
    return model, fit_curve(seen["x"].to_numpy(np.float64), seen["label"].to_numpy(np.float64))


SCORES = "doc_id long, held_out boolean, score double, predicted int, evidence double"


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    folds: int = 3,
    held_fold: int = 1,
    cut: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score >= cut), evidence per symbol."""
    learn = columns(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    learn = learn.where(F.pmod(fold(F.col("doc_id")), F.lit(folds)) != held_fold)
    learn = learn.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    source = columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model, (a, b, scale) = fit(source, learn, per_class)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[float, int]] = {}
        for whole in batches:
            for batch in small_batches(whole, "text", 10 << 20):
                x = text_evidence(shared.value, strings(batch, "text"), cache) if shared.value else np.zeros(batch.num_rows)
                score = np.round(1 / (1 + np.exp(-np.clip(a * x / scale + b, -30, 30))), 9)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(np.round(x, 9))],
                    names=["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    held = F.coalesce(F.pmod(fold(F.col("doc_id")), F.lit(folds)) == held_fold, F.lit(False))
    return source.withColumn("held_out", held).mapInArrow(run, SCORES)
