"""Morphemes: the lexicon's counts and the best path against brute force, on Korean."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstone.operators import bm25, morphemes

NOUNS = "학교 사람 나라 도서관 자동차 컴퓨터 바다 구름 음악 친구 시간 선생님 문서 검색".split()
PARTICLES = "이 가 은 는 을 를 에서 에게 으로 와 도 만".split()


def corpus(spark, n=400):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(NOUNS) + rnd.choice(["", *PARTICLES]) for _ in range(20))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def brute_best(lex, word):
    """The cheapest of all ways to cut and tag a word."""
    found = []
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        pieces = [word[a:b] for a, b in itertools.pairwise(at)]
        for tags in itertools.product("SE", repeat=len(pieces)):
            if tags[0] == "E" or any(t == "E" and p not in lex.endings for p, t in zip(pieces, tags, strict=True)):
                continue
            cost = sum(lex.endings[p] if t == "E" else lex.stems.get(p, lex.unknown + lex.letter * len(p)) for p, t in zip(pieces, tags, strict=True)) + lex.join * (tags.count("S") - 1)
            found.append((round(cost, 6), list(zip(pieces, tags, strict=True))))
    return min(c for c, _ in found), found


def cost_of(lex, path):
    return round(sum(lex.endings[p] if t == "E" else lex.stems.get(p, lex.unknown + lex.letter * len(p)) for p, t in path) + lex.join * (sum(t == "S" for _, t in path) - 1), 6)


def test_sides_against_brute_force(spark):
    df, rows = corpus(spark, 30)
    words = Counter(w for _, t in rows for w in t.split())
    want: dict = {}
    for w, n in words.items():
        for k in range(max(1, len(w) - 4), len(w) + 1):
            for key in (("S", w[:k]), ("E", w[k:])):
                if key[1]:
                    want.setdefault(key, []).append(n)
    got = {(r["tag"], r["form"]): (r["types"], r["n"], r["entropy"]) for r in morphemes.sides(morphemes.word_counts(df)).collect()}
    assert set(got) == set(want)
    for k, ns in want.items():
        h = -sum(n / sum(ns) * math.log(n / sum(ns)) for n in ns)
        assert got[k][:2] == (len(ns), sum(ns)) and got[k][2] == pytest.approx(h, abs=1e-9)


def test_korean_particles_go(spark):
    df, rows = corpus(spark)
    lex = morphemes.learn(df)
    assert {p for p in PARTICLES if len(p) == 1} <= set(lex.endings) and set(NOUNS) <= set(lex.stems)
    right = total = 0
    for n in NOUNS:
        for p in ["", *PARTICLES]:
            right += lex.split(n + p) == [n]
            total += 1
    assert right / total > 0.95
    split = morphemes.splitter(lex)
    got = {r["doc_id"]: r["w"] for r in df.select("doc_id", split(F.col("text")).alias("w")).collect()}
    for i, text in rows[:50]:
        assert got[i] == [p for w in text.split() for p, tag in lex.best(w) if tag == "S"]
    # a word is found in whatever form it is asked for
    index = bm25.build(df, id_col="doc_id", split=split)
    asked = spark.createDataFrame([(1, "도서관에서"), (2, "도서관")], "query_id int, text string")
    found = bm25.search(index, asked, 10)
    assert [r["chunk_id"] for r in found.where("query_id = 1").orderBy("rank").collect()] == [r["chunk_id"] for r in found.where("query_id = 2").orderBy("rank").collect()]


def test_best_path_against_brute_force(spark):
    df, _ = corpus(spark, 100)
    learned = morphemes.learn(df)
    rnd = random.Random(2)
    words = [rnd.choice(NOUNS) + rnd.choice(["", *PARTICLES]) + rnd.choice(["", "도", "만"]) for _ in range(40)] + ["가", "모르는", "친구친구를", "xyz"]
    for lex in (learned, morphemes.Lexicon({"a": 1.0, "ab": 1.5, "b": 2.0}, {"b": 1.0, "c": 0.5}, 3.0, 1.0, 1.0)):
        for w in [*words, "abc", "abab", "cab", "aabbc"]:
            if len(w) <= 7:
                path = lex.best(w)
                assert "".join(p for p, _ in path) == w
                assert cost_of(lex, path) == brute_best(lex, w)[0], w
    assert learned.best("") == [] and learned.split("12, 30!") == ["12,", "30!"]


def test_words_met_outlive_a_task():
    """A lexicon that comes again into a process, as with a next task, knows what it has cut there; another one does not."""
    import pickle

    sent = pickle.dumps(morphemes.Lexicon({"haus": 1.0}, {"es": 1.0}))
    first = pickle.loads(sent)
    assert first.split("hauses") == ["haus"]
    again, other = pickle.loads(sent), pickle.loads(pickle.dumps(morphemes.Lexicon({"hau": 1.0}, {"ses": 1.0})))
    assert again._known == {"hauses": ["haus"]} and other._known == {} and other.split("hauses") == ["hau"]


def test_many_words_are_cut_as_each_alone(spark):
    """Words of all lengths through the lattice together: known and unknown ones, equal costs, letters beyond 16 bits."""
    df, _ = corpus(spark, 100)
    rnd = random.Random(8)
    tied = morphemes.Lexicon({"a": 1.0, "ab": 5.0, "b": 1.0, "ba": 2.0, "𐐨b": 0.5}, {"b": 1.0, "ab": 4.0, "c": 0.25}, 3.0, 1.0, 1.0)
    for lex, letters in ((morphemes.learn(df), "".join(NOUNS + PARTICLES)), (tied, "abc𐐨"), (morphemes.Lexicon({}, {}), "ab")):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 24))) for _ in range(3000)} | {rnd.choice(NOUNS) + rnd.choice(PARTICLES) for _ in range(50)})
        want = [[p for p, tag in lex.best(w) if tag == "S"] for w in words]
        assert lex.stems_of(words) == want
        assert lex.split_all(["", " ".join(words), f"{words[0]} 12, {'a' * 25}"]) == [[], [p for ps in want for p in ps], [*want[0], "12,", "a" * 25]]


def test_texts_are_read_once_for_a_lexicon(spark):
    df, rows = corpus(spark, 60)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    lex = morphemes.learn(df.mapInPandas(count, df.schema))
    assert read.value == len(rows) and lex == morphemes.learn(df)


def test_splitter_equals_split_on_odd_texts(spark):
    """Pieces between blanks are split once: nulls, other white space, letters whose small form hangs on their neighbours, groups cut anywhere."""
    df, rows = corpus(spark, 100)
    lex = morphemes.learn(df)
    odd = [None, "", "   ", " \u0085", "\x1c", "a  b\tc D", "ΑΣ ΣΑΣ, ΣΑΣ-ΣΑΣ", "İstanbul \x1c x", "x" * 30 + " 12.5,y", "학교에서 학교에서"] + [t for _, t in rows[:20]]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, text string").repartition(1)
    want = {i: None if t is None else lex.split(t) or t.split() for i, t in enumerate(odd)}
    for hold in (1, 40, 1 << 23):
        assert {r["i"]: r["w"] for r in df.select("i", morphemes.splitter(lex, hold)(F.col("text")).alias("w")).collect()} == want
