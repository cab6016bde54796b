"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, spelling
from tests.llm.test_operators import ODD, docs_of, low, with_clashes


def brute_words(rows) -> Counter:
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", low(text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 5:
                words[run] += 1
    return Counter({w: n for w, n in words.items() if n >= 3})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(words: Counter) -> set:
    by_length: dict = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    form, near = {}, {}
    for w, n in words.items():
        close = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)]
        near[w] = len(close)
        best = min(close, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words[form[w]] if form[w] is not None else None))
    return out


def rows_of(df) -> set:
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_query_against_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(docs))
    got = queries.op12_spelling(spark, small).collect()
    assert len(got) == len(want) and rows_of(queries.op12_spelling(spark, small)) == want
    assert sum(form is not None for _, form, *_ in want) > 50


MADE = [("abcdef", 50), ("abcde", 20), ("abcdeg", 9), ("abcdeh", 4), ("xabcde", 20), ("aaaaaa", 12), ("aaaaa", 5), ("aaaaaaa", 6), ("élans", 8), ("elans", 4), ("Élans", 8), ("ÿÿÿÿÿ", 3), ("ÀÀÀÀÀ÷×", 3), ("long" * 700, 7), ("long" * 700 + "x", 3), ("long" * 350 + "q" + "long" * 350, 3)]


@pytest.mark.parametrize("shard", [1 << 22, 4])
def test_made_words(spark, shard):
    """Ties, chains, repeated letters, letters beyond ASCII, long words; and shards of few words."""
    texts = [" ".join([w] * n) for w, n in MADE]
    words = brute_words([(None, t) for t in texts])
    docs = docs_of(spark, texts).withColumn("doc_id", F.lit(None).cast("long"))
    got = spelling.variants(docs, shard=shard)
    assert rows_of(got) == brute_variants(words)
    assert len(words) > 10


def test_candidates_are_distinct_and_complete():
    """Every neighbour of a word over the letters, each once."""
    letters = np.array(sorted(map(ord, "abé")), np.uint32)
    for word in ("a", "ab", "aab", "ébba"):
        want = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "abé"} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in "abé"}
        want -= {word, ""}
        known = spelling.Known(spelling.Flat(sorted(want)).hashes)
        for step in (1, 1 << 14):
            got = [s for _, s in spelling.Flat([word]).found(letters, known, step)]
            assert sorted(got) == sorted(want)


def test_odd_rows(spark):
    df = with_clashes(docs_of(spark, ODD))
    df = df.unionByName(df.where("doc_id = 9")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows_of(spelling.variants(df)) == brute_variants(brute_words(rows))
    assert spelling.variants(docs_of(spark, [])).collect() == []
    assert spelling.variants(docs_of(spark, [None, "", "- -"])).collect() == []
