"""Language model, toxicity and quality: exact sums, normalisation, held-out accuracy, awkward rows."""

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from eventlens.llm import katz, quality, toxicity

rng = random.Random(5)
WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "sta") for b in ("n", "ra", "ti", "sso", "")]


def sentence(n, vocabulary=WORDS):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus():
    texts = [sentence(rng.randint(1, 60)) for _ in range(120)]
    return texts + ["", None, "Ba BA ba", "new unseen words", "x " * 3000, texts[0], "ÄÖ ß nbsp sep\x0bvt"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(corpus())], "doc_id long, text string, score string").repartition(4)


def lowered(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


@pytest.mark.parametrize("how", [{}, {"vocabulary": 10, "head": 3, "bucket_tokens": 500}])
def test_katz_counts_and_base(docs, how):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, t in texts.items() if not held[i] for w in [*lowered(t), None])
    total, kinds = sum(count.values()), len(count)
    rows = katz.katz_scores(docs, **how).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = [*lowered(texts[r["doc_id"]]), None]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(count[w] > 0 for w in own), total)
        assert abs(r["base_score"] - base) < 1e-5 * len(own)
        assert -math.inf < r["score"] < 0
    kept = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)


def test_katz_does_not_depend_on_layout(docs):
    one = {(r["doc_id"], r["score"]) for r in katz.katz_scores(docs, vocabulary=12, head=0, bucket_tokens=300).collect()}
    two = {(r["doc_id"], r["score"]) for r in katz.katz_scores(docs.repartition(1), vocabulary=12, head=50).collect()}
    assert all(abs(dict(one)[k] - v) < 1e-5 for k, v in two)


def test_katz_is_normalised(spark, docs):
    """After any history, the probabilities of all symbols sum to one, and so do the shares of the class."""
    from pyspark.sql import functions as F

    source = docs.select("doc_id", "text", F.lit(False).alias("held_out"))
    counted = lambda f: source.mapInArrow(f, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    unigram = counted(katz.unigrams)
    model = katz.fit_unigrams(unigram, source.count(), 12)
    bigram = counted(katz.bigrams(model))
    katz.fit_bigrams(model, bigram, 5)
    n = {r["key"]: r["n"] for r in bigram.collect()}
    outcomes = [w for w in range(len(model.counts)) if w != katz.START]
    for h in range(len(model.counts)):
        key = np.array([h << katz.BITS | w for w in outcomes])
        p = 10 ** model.seen(key, np.array([n.get(int(k), 0) for k in key]))
        assert abs(p.sum() - 1) < 1e-9, h
    rare = [r["n"] for r in unigram.collect() if model.symbols_of(np.array([r["key"]]))[0] == katz.RARE]
    assert abs((10 ** model.rare(np.array(rare))).sum() + 10 ** model.rare_unknown - 1) < 1e-9


def test_katz_counts_bigrams_of_words_outside_the_vocabulary(spark):
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2][:60]
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    texts = [(i, "the of the of the of " + ("qa qb" if k % 2 else "qc qd") + " the") for k, i in enumerate(train)]
    docs = spark.createDataFrame([*texts, (held[0], "qa qb"), (held[1], "qa qd")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in katz.katz_scores(docs, vocabulary=2).collect()}
    assert score[held[0]] > score[held[1]] + 1


@pytest.mark.parametrize("vocabulary", [0, 12])
def test_katz_against_a_slow_model(spark, docs, vocabulary):
    """Every bigram counts, in or outside the vocabulary; after any history the probabilities sum to one."""
    import xxhash

    texts = {r["doc_id"]: lowered(r["text"]) for r in docs.collect()}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in t)
    unigram = spark.createDataFrame([(xxhash.xxh3_64_intdigest(w) - (xxhash.xxh3_64_intdigest(w) >> 63 << 64), n) for w, n in count.items()], "key long, n long")
    model = katz.fit_unigrams(unigram, len(train), vocabulary)
    source = docs.where(~F.col("doc_id").isin([i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2])).select("text", F.lit(False).alias("held_out"))
    katz.fit_bigrams(model, source.mapInArrow(katz.bigrams(model), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), 5)
    symbol = {w: int(model.symbols_of(np.array([xxhash.xxh3_64_intdigest(w)], np.uint64).view(np.int64))[0]) for t in texts.values() for w in t}
    symbol |= {None: katz.END, "": katz.START, "unknown": katz.RARE}
    bigram, classes = Counter(), Counter()
    for t in train:
        for h, w in zip(["", *t], [*t, None]):
            bigram[h, w] += 1
            classes[symbol[h], symbol[w]] += 1
    outside = {k: n for k, n in bigram.items() if katz.RARE in (symbol[k[0]], symbol[k[1]])}
    d = katz.discounts(Counter(outside.values()))
    kept = lambda n: n * (d[n] if n <= katz.GOOD_TURING else 1)
    share = lambda w: float(10 ** model.rare(np.array([count[w]]))[0])
    of_class = lambda h, w: float(10 ** model.seen(np.array([h << katz.BITS | w]), np.array([classes[h, w]]))[0])

    def p(h, w):
        if katz.RARE not in (symbol[h], symbol[w]):
            return of_class(symbol[h], symbol[w])
        rare = symbol[h] == katz.RARE
        lower = (lambda v: of_class(katz.RARE, symbol[v]) * (share(v) if symbol[v] == katz.RARE else 1)) if rare else share
        own = {v: n for (g, v), n in outside.items() if g == h}
        total, here = sum(own.values()), 1 if rare else of_class(symbol[h], katz.RARE)
        if not own:
            return here * lower(w)
        left = 1 - sum(map(kept, own.values())) / total
        least = max(left, 0.5 / (total + 1))
        if w in own:
            return here * kept(own[w]) / total * (1 - least) / (1 - left)
        return here * least / (1 - sum(map(lower, own))) * lower(w)

    for h in ["", "ba", "x", "nbsp", "unseen", *list(count)[:6]]:
        assert abs(sum(p(h, w) for w in [*count, None, "unknown"]) - 1) < 1e-9, h
    for r in katz.katz_scores(docs, vocabulary=vocabulary, head=5, bucket_tokens=500).collect():
        t = texts[r["doc_id"]]
        assert abs(r["score"] - sum(math.log10(p(h, w)) for h, w in zip(["", *t], [*t, None]))) < 1e-5 * (len(t) + 1)


def test_katz_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in katz.katz_scores(docs).collect()} == {(0, 0, 0.0)}
    assert katz.katz_scores(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    texts, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = sentence(80).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grubb" + rng.choice(["el", "ish", "o", "ard", "ling", "y", "ack", "um"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(500, None, 0), (501, "", 0), (None, "ba ban", 0), (0, texts[0], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    marks = spark.createDataFrame([(i, y, None) for i, y in enumerate(labels)] + [(None, 1, None), (7, None, None)], "doc_id long, toxic int, text string")
    found = toxicity.toxicity_scores(docs, marks).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 500 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(r["held_out"] for r in held) and len(held) > 100
    right = [r["predicted"] == labels[r["doc_id"]] for r in held]
    assert sum(right) / len(right) > 0.95


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.toxicity_scores(docs, marks).collect())
    assert {r["score"] for r in toxicity.toxicity_scores(docs, marks.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.limit(0), marks).count() == 0


def test_quality_drops_junk_and_keeps_prose(spark):
    texts, good = [], []
    for i in range(400):
        junk = i % 5 == 0
        words = sentence(60).split()
        texts.append(" ".join(w.upper() + "!!" if i % 2 else f"{w}%%%" for w in words) if junk else " ".join(words).capitalize() + ".")
        good.append(not junk)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(400, None, 0), (401, "", 0), (None, texts[1], 0)], "doc_id long, text string, key int")
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality.importance_resample(docs, labels).collect()
    assert len(found) == 403
    by_id = {r["doc_id"]: r["selected"] for r in found if r["doc_id"] is not None and r["doc_id"] < 400}
    assert sum(by_id[i] for i in range(400) if good[i]) >= 0.98 * sum(good)
    assert sum(by_id[i] for i in range(400) if not good[i]) <= 4
    assert quality.importance_resample(docs, labels.limit(0)).where("selected").count() == 403
    assert quality.importance_resample(docs.limit(0), labels).count() == 0
    assert quality.importance_resample(docs, labels, k=17).where("selected").count() == 17


def test_the_cut_counts_every_labelled_row(spark):
    # more rows than were drawn for it before; many equal weights
    draw = np.random.default_rng(4)
    good = draw.random(60_000) < 0.3
    weights = np.round(draw.normal(good * 1.0, 1.0), 3)
    df = spark.createDataFrame([(float(w), bool(g)) for w, g in zip(weights, good)], "log_weight double, good boolean").repartition(5)
    listed = np.unique(weights)
    below = np.searchsorted(np.sort(weights[good]), listed), np.searchsorted(np.sort(weights[~good]), listed)
    cost = 3.0 * (below[0] / good.sum()) + (1.0 - below[1] / (~good).sum())
    at = int(np.argmin(cost))
    assert at > 0 and quality.best_cut(df, 3.0) == (listed[at - 1] + listed[at]) / 2
    assert quality.best_cut(df.unionByName(df.limit(1).select(F.lit(99.0).alias("log_weight"), F.lit(False).alias("good"))), 1e-9) == np.inf
    assert quality.best_cut(df.where("good"), 3.0) == quality.best_cut(df.limit(0), 3.0) == -np.inf
    assert quality.best_cut(df.withColumn("log_weight", F.lit(0.0)), 3.0) == -np.inf


def test_kth_largest_with_ties(spark):
    values = [float(rng.randrange(50)) for _ in range(3000)]
    frame = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 700, 2999, 3000):
        value, above = quality.kth_largest(frame, k, bins=8, small=20)
        assert value == sorted(values, reverse=True)[k - 1] and above == sum(v > value for v in values)


def test_gumbel_top_k_draws_by_weight(spark):
    """Among rows of weight 3 and 1, the first draw is in that proportion."""
    frame = spark.range(20000).select((quality.F.col("id") / 2).cast("long").alias("pair"), (quality.F.col("id") % 2).alias("heavy"))
    keyed = frame.withColumn("key", quality.F.log(quality.F.lit(1.0) + 2 * quality.F.col("heavy")) + quality.gumbel("pair", "heavy"))
    won = keyed.groupBy("pair").agg(quality.F.max_by("heavy", "key").alias("w")).agg(quality.F.avg("w")).first()[0]
    assert abs(won - 0.75) < 0.02


def test_whole_word_models_against_a_slow_one():
    """Kneser-Ney over words by hand: discounted class counts, the freed mass by the counts of both classes."""
    rng = np.random.default_rng(1)
    counts = np.concatenate([rng.integers(0, 6, (40, 2)), [[0, 7], [9, 0], [1, 0], [0, 1]]]).astype(float)
    counts = counts[counts.sum(1) > 0]
    h = rng.integers(-(2**62), 2**62, len(counts))
    keys, values = toxicity.whole_words(h, counts)
    got = dict(zip(keys.view(np.int64).tolist(), values))
    probability = []
    for label in (0, 1):
        own = [c[label] for c in counts]
        n1, n2 = own.count(1), own.count(2)
        d = n1 / (n1 + 2 * n2)
        free = d * sum(x > 0 for x in own) / sum(own)
        probability.append([max(x - d, 0) / sum(own) + free * sum(c) / counts.sum() for x, c in zip(own, counts)])
        assert sum(probability[-1]) == pytest.approx(1)  # a distribution over the words that both classes know
    for key, ordinary, toxic in zip(h.tolist(), *probability):
        assert got[key] == pytest.approx(np.log(toxic / ordinary))


def test_words_count_once_per_text_and_context():
    import pyarrow as pa

    texts = ["spam one spam two spam", "spam one spam two spam", "a spam b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 1, 0], pa.int32()), pa.array([0, 1, 0], pa.int32())], names=["text", "label", "half"])
    rows = pa.Table.from_batches(list(toxicity.word_contexts(iter([batch])))).to_pandas()
    spam = rows[(rows["word"] == "spam") & (rows["label"] == 1)]
    assert min(spam["doc"].nunique(), spam["context"].nunique()) == 2 and len(spam) == 6


def test_toxicity_of_a_very_long_text_and_repeated_rows(spark):
    rows = [(i, ("vile nasty " if i % 2 else "kind gentle ") + " ".join(f"w{(i * 7 + j) % 50}" for j in range(20))) for i in range(120)]
    docs = spark.createDataFrame(rows + [(500, "kind words " * 200_000), (1, rows[1][1])], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, marks).collect()
    assert len(got) == 122 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[500] < 0.5 and min(by[i] for i in range(1, 120, 2)) > max(by[i] for i in range(0, 120, 2))


def test_character_models_against_a_slow_one():
    """Kneser-Ney over characters by dictionaries of strings, on a few words."""
    import pandas as pd

    rng = random.Random(5)
    rows = [(label, "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))), rng.randint(1, 4)) for label in (0, 1) for _ in range(60)]
    table = pd.DataFrame(rows, columns=["label", "word", "n"]).drop_duplicates(["label", "word"])
    long = pd.concat(list(toxicity.word_grams(iter([table]))))
    for label in (0, 1):
        long[f"n{label}"] = long["n"].where(long["label"] == label, 0)
    model = toxicity.kneser_ney(long.groupby(["g", "suffix", "context", "size", "first"])[["n0", "n1"]].sum().reset_index())
    order, own = toxicity.ORDER, [Counter(), Counter()]
    for label, word, n in table.itertuples(index=False):
        w = toxicity.START + word + toxicity.END
        for i in range(1, len(w)):
            for k in range(1, min(order, i + 1) + 1):
                own[label][w[i + 1 - k : i + 1]] += n
    grams = set(own[0]) | set(own[1])
    top = {g for g in grams if len(g) == order or g[0] == toxicity.START}
    shared = {g: own[0][g] + own[1][g] if g in top else len({h[0] for h in grams if h[1:] == g}) for g in grams}

    def discount(values):
        n1, n2 = values.count(1), values.count(2)
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    d = {k: discount([shared[g] for g in grams if len(g) == k]) for k in range(1, order + 1)}

    def prob(g):
        if not g:
            return 1 / sum(len(x) == 1 for x in grams)
        same = [shared[x] for x in grams if x[:-1] == g[:-1] and len(x) == len(g)]
        return (max(shared.get(g, 0) - d[len(g)], 0) + d[len(g)] * len(same) * prob(g[1:])) / sum(same) if same else prob(g[1:])

    own_d = [discount([own[label][g] for g in top]) for label in (0, 1)]

    def log(label, g):
        same = [own[label][x] for x in top if x[:-1] == g[:-1] and own[label][x]]
        if not same:
            return math.log(prob(g))
        return math.log((max(own[label][g] - own_d[label], 0) + own_d[label] * len(same) * prob(g)) / sum(same))

    keys = toxicity.gram_hash(sorted(top))
    found, value = toxicity.look_up(*model.grams, keys)
    assert found.all()
    for g, x in zip(sorted(top), value):
        assert x == pytest.approx(log(1, g) - log(0, g), abs=1e-9), g


def test_katz_tables_are_sent_packed_by_bucket():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    key = rng.integers(-(2**63), 2**63 - 1, 9000)
    other, n, kept, p = rng.integers(0, 1 << 20, 9000), rng.integers(1, 2**40, 9000), rng.random(9000), rng.random(9000)
    batch = lambda a, b, **more: pa.RecordBatch.from_pydict({"key": key[a:b], "other": other[a:b], "n": n[a:b], **{c: x[a:b] for c, x in more.items()}})
    for more in ({}, {"kept": kept, "p": p}):
        sent = list(katz.packed_table(2, 4, rows=5000)([batch(a, a + 1000, **more) for a in range(0, 9000, 1000)]))
        assert [b.num_rows for b in sent] == [4, 4]  # a row per bucket and 5,000 rows, not one per row
        got = {}
        for bucket, body in ((k, v) for b in sent for k, v in zip(b["bucket"].to_pylist(), b["body"].to_pylist())):
            got |= {h: (bucket, *x) for h, *x in zip(*(c.tolist() for c in katz.unsqueeze_table(body)))}
        sums = (kept, p) if more else (np.zeros(9000), np.zeros(9000))
        want = zip(katz.bucket_of(key, 2, 4).tolist(), n.tolist(), *(x.tolist() for x in sums))
        assert got == dict(zip(katz.joined(key, other).tolist(), want))


@pytest.mark.parametrize("buckets", [1, 3, 1000])
def test_katz_keys_lose_only_what_their_bucket_tells(buckets):
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 1 << 2 * katz.BITS, 5000)
    hashes = rng.integers(-(2**63), 2**63 - 1, 5000)
    for kind, key in ((0, symbols), (1, hashes), (2, np.array([-1, -(2**63), 2**63 - 1, 0]))):
        bucket, short = katz.bucket_of(key, kind, buckets), katz.within(key, buckets)
        for b in np.unique(bucket).tolist():
            assert (katz.restored(short[bucket == b], b, buckets) == key[bucket == b]).all()
    numbers = [symbols, hashes, rng.random(5000), np.zeros(5000)]
    assert all((x.view(y.dtype) == y).all() for x, y in zip(katz.unpack(katz.pack(*numbers)), numbers, strict=True))


def test_katz_sends_few_bytes_between_slices_and_buckets():
    rng, k, buckets, docs = np.random.default_rng(6), 20_000 + katz.FIRST, 4, 400
    names = [f"w{i}" for i in range(k - katz.FIRST)]
    texts = [" ".join(names[i] for i in rng.integers(0, len(names), 300)) for _ in range(docs)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(docs)), "text": texts, "held_out": [False] * docs})
    hashes = katz.tokens(pa.RecordBatch.from_pydict({"text": [" ".join(names)]}))[2]
    order, ones = np.argsort(hashes), np.ones(6)
    log_p, alpha = -rng.random(k), -rng.random(k)
    model = katz.Model(
        hashes[order], katz.FIRST + order, np.ones(k, np.int64), k, k, 0, ones, 0.0, buckets, bigram_d=ones, log_p=log_p, history=np.arange(1, k + 1), seen_scale=np.zeros(k),
        log_alpha=alpha, head_keys=np.zeros(0, np.int64), head_log=np.zeros(0), to_rare=np.zeros(k), after_rare=np.zeros(k),
    )
    shared = SimpleNamespace(value=model)
    key, text = katz.bigram_keys(model, *katz.tokens(batch))
    counted, n = np.unique(key, return_counts=True)
    known = rng.random(len(counted)) < 0.5
    rows = pa.RecordBatch.from_arrays([pa.array(counted[known]), pa.array(np.zeros(known.sum(), np.int64)), pa.array(n[known])], names=["key", "other", "n"])
    table = pa.Table.from_batches(list(katz.packed_table(0, buckets)([rows])))
    sent = pa.Table.from_batches(list(katz.packed_tokens(shared)([batch])))
    size = lambda t: sum(len(x) for x in t["body"].to_pylist())
    score, entries, replied, asked = np.zeros(docs), 0, 0, 0
    for b in range(0, katz.KINDS * buckets, katz.KINDS):
        of = lambda t: t.filter(pc.equal(t["bucket"], b))  # noqa: B023, E731
        reply = katz.evaluated(shared)(of(sent), of(table))
        asked, replied = asked + size(of(sent)), replied + size(reply)
        for body in reply["body"].to_pylist():
            place, sums = katz.unpack(body)
            entries += len(place)
            score[np.cumsum(place.view("<i8"))] += sums.view("<f8")
    want = model.seen(key, np.where(known, n, 0)[np.searchsorted(counted, key)])
    assert np.allclose(score, np.bincount(text, weights=want, minlength=docs))
    assert size(table) < 3 * known.sum()  # bytes a bigram; 6.87 as hashes
    assert asked < 3.6 * len(key)  # bytes a token; 3.67 with whole keys
    assert replied < 8 * entries  # bytes a sum of a document; 27.5 with places and columns of zeros as they are


def test_katz_splits_a_slice_piece_by_piece(monkeypatch):
    rng, docs = np.random.default_rng(7), 1500
    names = np.array([f"w{i}" for i in range(20_000)])
    texts = [None, "", *(" ".join(names[rng.integers(0, 20_000, 1200)]) for _ in range(docs - 2))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(docs)), "text": texts, "held_out": [i % 7 == 2 for i in range(docs)]})
    hashes = katz.tokens(pa.RecordBatch.from_pydict({"text": [" ".join(names)]}))[2][:5000]
    order, k = np.argsort(hashes), 5000 + katz.FIRST
    model = katz.Model(hashes[order], katz.FIRST + order, np.arange(k), 10**6, k, 9, np.ones(6), 0.0, 3, to_rare=-rng.random(k))
    model.head_keys = np.unique(katz.bigram_keys(model, *katz.tokens(batch))[0])[::50]
    model.head_log = -rng.random(len(model.head_keys))
    split, words = [], katz.words
    monkeypatch.setattr(katz, "words", lambda x: split.append(sum(map(len, x.to_pylist()))) or words(x))

    def made() -> list:
        tables = [pa.Table.from_batches(list(f(iter([batch])))) for f in (katz.unigrams, katz.bigrams(model), katz.pairs(model))]
        tables = [t.sort_by([(c, "ascending") for c in t.column_names]).to_pydict() for t in tables]
        return [*tables, *pa.Table.from_batches(list(katz.packed_tokens(SimpleNamespace(value=model))([batch]))).to_pylist()]

    usual = made()
    assert sum(split) > 4 * (8 << 20) and max(split) < 5 << 20  # the four passes; no slice is split into words whole
    for limit in (200_000, 1 << 30):
        monkeypatch.setattr(katz, "PIECE_BYTES", limit)
        assert made() == usual
    counts = Counter(" ".join(x or "" for i, x in enumerate(texts) if i % 7 != 2).split())
    code, _, hashes = katz.tokens(pa.RecordBatch.from_pydict({"text": [" ".join(counts)]}))
    assert dict(zip(usual[0]["key"], usual[0]["n"])) == dict(zip(hashes[code].tolist(), counts.values()))
