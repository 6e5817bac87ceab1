import time

import numpy as np

from eventlens.operators import topics


def test_titles(spark):
    data = [("small", f"flood water rising {i}") for i in range(9)]
    data += [("stop", "the and of it") for _ in range(10)]
    data += [("big", "flood water flood rescue water flood zebra") for _ in range(10)]
    data += [("tie", "beta alpha gamma delta") for _ in range(10)]
    df = spark.createDataFrame(data, "ev string, clean_text string")
    got = {r.ev: r.event_title for r in topics.title_events(df, "ev", "clean_text").collect()}
    assert got["small"] == "Small Event"
    assert got["stop"] == "Generic Event"
    assert got["big"] == "Flood Water Zebra"  # 30, 20, then ties (10 each) by term descending
    assert got["tie"] == "Gamma Delta Beta"


def matrix_coherence(docs, max_terms=3000):
    toks = [[t for t in d.split(" ") if len(t) >= 2 and t not in ("the", "and")] for d in docs]
    tf = {}
    for ts in toks:
        for t in ts:
            tf[t] = tf.get(t, 0) + 1
    vocab = sorted(tf, key=lambda t: (-tf[t], t))[:max_terms]
    idx = {t: i for i, t in enumerate(vocab)}
    x = np.zeros((len(docs), len(vocab)))
    for r, ts in enumerate(toks):
        for t in ts:
            if t in idx:
                x[r, idx[t]] = 1
    c = x.T @ x
    return float(np.mean(c / (c.sum(axis=1, keepdims=True) + 1e-9)))


def test_coherence_linear_form_equals_matrix(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}x" for i in range(40)]
    docs = [" ".join(rng.choice(words, size=rng.integers(1, 12))) for _ in range(25)]
    data = [("e", i, d) for i, d in enumerate(docs)] + [("tiny", 100 + i, "aa bb") for i in range(9)]
    df = spark.createDataFrame(data, "ev string, doc long, clean_text string")
    got = {r.ev: r.coherence for r in topics.topic_coherence(df, "ev", "doc", "clean_text").collect()}
    assert set(got) == {"e"}  # events under ten rows are skipped
    assert abs(got["e"] - matrix_coherence(docs)) < 1e-12
    capped = {r.ev: r.coherence for r in topics.topic_coherence(df, "ev", "doc", "clean_text", max_terms=7).collect()}
    assert abs(capped["e"] - matrix_coherence(docs, 7)) < 1e-12


def test_coherence_of_long_documents_is_linear(spark):
    # the work per document grew with the square of its terms
    docs = [" ".join(f"t{i}x{j}" for j in range(20_000)) for i in range(10)]
    df = spark.createDataFrame([("e", i, d) for i, d in enumerate(docs)], "ev string, doc long, clean_text string")
    start = time.monotonic()
    got = topics.topic_coherence(df, "ev", "doc", "clean_text").first()
    assert time.monotonic() - start < 60
    assert abs(got.coherence - 1 / 200_000) < 1e-12  # all terms in one document each: V rows that sum to 1


def test_capped_coherence_joins_large_vocabularies_and_repeated_documents(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i}x" for i in range(40)]
    docs = [" ".join(rng.choice(words, size=rng.integers(1, 12))) for _ in range(25)]
    rows = [(e, i, d) for e in ("e", "f") for i, d in enumerate(docs)]
    twice = spark.createDataFrame([*rows, ("f", 3, "w1x w2x"), ("f", None, "w1x"), ("f", None, "w3x w1x"), ("e", 50, None)], "ev string, doc long, clean_text string")
    sent = {r.ev: r.coherence for r in topics.topic_coherence(twice, "ev", "doc", "clean_text", max_terms=7).collect()}
    monkeypatch.setattr(topics, "VOCAB_ROWS", 3)
    joined = {r.ev: r.coherence for r in topics.topic_coherence(twice, "ev", "doc", "clean_text", max_terms=7).collect()}
    assert abs(sent["e"] - matrix_coherence(docs, 7)) < 1e-12
    assert sent.keys() == joined.keys() and all(abs(sent[k] - joined[k]) < 1e-12 for k in sent)
