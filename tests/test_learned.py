"""What is learned from a corpus: word vectors and the reranker."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import bm25, fuse, proximity, semantic


def topics(n=240, seed=2):
    """Documents of four topics; a topic's words never meet all at once, so only company tells that they belong together."""
    rnd = random.Random(seed)
    words = {t: [f"{t}{k}" for k in range(40)] for t in "abcd"}
    common = [f"the{k}" for k in range(10)]
    out = []
    for i in range(n):
        t = "abcd"[i % 4]
        own = rnd.sample(words[t], 12)
        out.append((i, t, " ".join(rnd.choice(own) if rnd.random() < 0.6 else rnd.choice(common) for _ in range(80))))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(topics(), "doc_id long, topic string, text string")


def test_pair_counts_and_associations(spark):
    texts = ["a b c a", "b b", "", None, "A x c"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    vocab = ["a", "b", "c"]
    want = Counter()
    for t in texts:
        w = (t or "").lower().split()
        for i, x in enumerate(w):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j and x in vocab and w[j] in vocab:
                    want[vocab.index(x), vocab.index(w[j])] += 1
    pairs = semantic.pair_counts(docs, vocab, window=2, hold=3)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(want)
    total, sums = sum(want.values()), Counter()
    for (x, _), n in want.items():
        sums[x] += n
    v = {k: math.log(n * total / (sums[k[0]] * sums[k[1]])) for k, n in want.items()}
    got = {(r["a"], r["b"]): r["v"] for r in semantic.associations(pairs).collect()}
    assert got == pytest.approx({k: x for k, x in v.items() if x > 0})


def test_factors_equal_the_eigenvectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) @ np.diag([9, 7, 5, 3, 2, 1])
    m = x @ x.T
    m[np.abs(m) < 1] = 0
    rows = [(i, j, float(m[i, j])) for i in range(40) for j in range(40) if m[i, j]]
    matrix = spark.createDataFrame(rows, "a int, b int, v double").repartition(3)
    block = rng.normal(size=(40, 5))
    assert np.allclose(semantic.product(matrix, block), m @ block)
    got = semantic.factors(matrix, 40, 4, rounds=6)
    values = np.sort(np.linalg.eigvalsh(m))[::-1][:4]
    assert np.allclose((got * got).sum(0), values, rtol=1e-3)


def test_halves_of_a_text_are_near(spark, corpus, tmp_path):
    """Halves of one document, of which neither was seen as a pair, against halves of other topics: a margin of 0.5."""
    learned = semantic.fit(corpus.where("doc_id % 3 > 0"), str(tmp_path / "m"), dim=16, most=500)
    held = [(r["topic"], r["a"], r["b"]) for r in corpus.where("doc_id % 3 = 0").select("topic", *[h.alias(n) for h, n in zip(semantic.halves(F.col("text")), "ab", strict=True)]).collect()]
    a, b = learned.embed([x for _, x, _ in held]), learned.embed([x for _, _, x in held])
    s, topic = a @ b.T, np.array([t for t, *_ in held])
    own, other = np.diag(s).mean(), s[topic[:, None] != topic[None, :]].mean()
    assert own - other > 0.5
    # words that never stand in one text, but in like company, are near
    v = learned.vectors / np.linalg.norm(learned.vectors, axis=1, keepdims=True)
    w = [learned.at[x] for x in ("a1", "a2", "b1")]
    assert v[w[0]] @ v[w[1]] > v[w[0]] @ v[w[2]] + 0.3
    assert learned.embed(["", "unknown words", "a1"])[:2].any() == False  # noqa: E712
    assert np.allclose((learned.embed(["a1 a2", "b3"]) ** 2).sum(1), 1, atol=1e-5)
    empty = semantic.fit(corpus.limit(0), str(tmp_path / "e"))
    assert empty.embed(["x"]).shape == (1, 64)


def brute_features(query, text):
    asked, words = proximity.words_of(query), proximity.words_of(text)
    kinds, n = set(asked), len(words)
    pairs = set(zip(asked, asked[1:], strict=False))
    density = max((len(kinds & set(words[i:j])) / len(kinds) * len(kinds & set(words[i:j])) / (j - i) for i in range(n) for j in range(i + 1, n + 1)), default=0)
    run = max((k for k in range(len(asked) + 1) for i in range(len(asked) - k + 1) if any(words[j : j + k] == asked[i : i + k] for j in range(n - k + 1))), default=0)
    return [len(kinds & set(words)) / len(kinds), len(pairs & set(zip(words, words[1:], strict=False))) / max(1, len(pairs)), density, run / len(asked), math.log(n)]


def test_features_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        query, text = (" ".join(rnd.choices("abcdefgh", k=rnd.randint(1, m))) for m in (5, 14))
        got = proximity.features(query, [text], [2])[0]
        want = brute_features(query, text)
        assert [got[0], got[1], got[4], got[5], got[6]] == pytest.approx([want[0], want[1], want[3], want[4], 0.5])
        assert got[3] <= want[2] + 1e-12 and (want[2] == 0 or got[3] > 0)  # windows that begin and end with a word of the query
    assert proximity.features("", ["a"], [1])[0].tolist() == [0] * 6 + [1] and proximity.features("a", [None, ""], [1, 2])[:, :6].any() == False  # noqa: E712


def test_the_reranker_beats_the_fused_order(spark):
    """Passages of texts whose words are all common: counts hardly tell the right text, order does."""
    rnd = random.Random(3)
    chunks = spark.createDataFrame([(f"c{i:04d}", " ".join(rnd.choice("abcdefghijklmnopqrst") * 2 for _ in range(60))) for i in range(300)], "chunk_id string, text string")

    def rows(salt):
        asked = proximity.passages(chunks, 120, 5, salt)
        found = bm25.search(bm25.build(chunks, queries=asked), asked, 40)
        return proximity.judged(asked, found.select("query_id", "chunk_id", "rank"), chunks)

    model = proximity.learn(rows(11))
    held = proximity.reranked(rows(12), model).persist()
    before, after = proximity.gain(held, "rank"), proximity.gain(held, "new_rank")
    assert held.where("right").count() > 20 and after > before + 0.2 and after > 0.8
    query = held.where("right and rank > 5").first()
    hits = held.where(F.col("query_id") == query["query_id"]).select("chunk_id", "text", "rank")
    best = fuse.rerank(hits, query["query"], 1, model).first()
    assert best["chunk_id"] == query["chunk_id"] and best["rerank_error"] is None


@pytest.mark.parametrize("mode", ["library", "paper"])
def test_a_set_of_queries_needs_no_postings(spark, corpus, mode):
    """The hits that the shuffled postings give, with null and empty texts, unknown words, words said twice and more hits than matches."""
    more = spark.createDataFrame([(900, None), (901, ""), (902, "a1 a1 the1 once"), (903, "A1")], "doc_id long, text string")
    docs = corpus.select("doc_id", "text").unionByName(more).withColumnRenamed("doc_id", "chunk_id").repartition(3)
    asked = spark.createDataFrame([(1, "a1 the1 a1 the2"), (2, "unknown words"), (3, "once"), (4, ""), (5, None), (6, "b3 c4 unknown")], "query_id int, text string")
    for n in (3, 400):
        want = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in bm25.search(bm25.build(docs, queries=asked), asked, n, mode).collect()}
        for hold in (1, 1 << 22):
            found = bm25.batch_top(docs, asked, n, mode, hold=hold)
            assert found.columns == ["query_id", "chunk_id", "score", "rank"]
            got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found.collect()}
            assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and want
            assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()}, abs=2e-9)
    assert bm25.batch_top(docs, asked.where("query_id = 2"), 3, mode).collect() == []
