"""Tokens of two tokenizers, aligned, against a brute-force version on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlstone.llm import alignment, queries
from marlstone.llm.textbytes import utf8_column
from tests.llm.test_operators import ODD, docs_of, with_clashes


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.ByteLevel(public_tokenizers.path(alignment.A_FILE)), alignment.Pieces(public_tokenizers.path(alignment.B_FILE))


def brute(texts, a, b):
    """Of each text (ids of A, of B, groups, links, digest), None without tokens; and the links' counts."""
    out, counts = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids = a.tokenizer.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
        spelled = [[t.bytes[k] for k in i] for t, i in zip((a, b), ids, strict=True)]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelled]
        both, groups, links, at = sorted(set(ends[0]) & set(ends[1])), [], [], [0, 0]
        for stop in both:
            own = [[], []]
            for side in (0, 1):
                while at[side] < len(ids[side]) and ends[side][at[side]] <= stop:
                    own[side].append(ids[side][at[side]])
                    at[side] += 1
            groups.append("|".join(",".join(map(str, g)) for g in own))
            links.append((own[0][-1], own[1][-1]))
        counts.update(links)
        out.append((len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts


def rows_of(found, counts):
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(counts[p] == highest[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_against_brute_force(spark, small, tokenizers):
    docs = queries.table(spark, small, "documents").orderBy("doc_id").collect()
    want = rows_of(*brute([r["text"] for r in docs], *tokenizers))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_alignment(spark, small).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(docs, want, strict=True)}


WHITE = [" ", "  ", "a ", "a\n", " a", "\n", "a\n\nb", "a \n b\t\tc  ", "▁x y", "x  y　 z  q <|endoftext|> <s> </s> <unk> <0x0A>", "한국어 텍스트 입니다\n둘째", "é café \u0085 x\x00 y", "\x1c a\x1d b \x0b c\x0c d", "'s 've 're x's\n's", "a   b    c\n\n\n d", "1234 5678\n99 %%% $$$", "😀 😀😀 x😀 y", "ﬁ ½ ①  x", "Привет мир\nкак дела", "\r\na\r\nb\r c", "a" * 3000, "ab " * 2000 + " "]


def test_pieces_are_encoded_as_whole_texts(tokenizers):
    """Any white space, and text that looks special, anywhere: pieces give what the tokenizers give for whole texts."""
    rnd = random.Random(3)
    parts = ["a", "b", " ", "\n", "\t", " ", "é", " ", "한", "😀", "'s", "1", "　", "_", " the", "\r", "ж", " ", "\u0085", "​", "\x00", "<s>"]
    texts = [*ODD, *WHITE, *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(400)), "▁ q"]
    found, counts = brute(texts, *tokenizers)
    assert sum(f is None for f in found) < 10 and found[-1] is None
    aligner = alignment.Aligner(*tokenizers, most=50)
    data, offsets = utf8_column(pa.array(texts, pa.string()))
    for step in (7, 1 << 17):
        n, sha, ids, times = aligner.take(data, offsets, np.array([t is None for t in texts]), step)
        for k, f in enumerate(found):
            want = ((0, 0, 0), "", Counter()) if f is None else (f[:3], f[4], Counter(x * 32768 + y for x, y in f[3]))
            assert (tuple(n[:, k].tolist()), sha[k], Counter(dict(zip(ids[k].tolist(), times[k].tolist(), strict=True)))) == want, texts[k]


def test_odd_rows(spark, tokenizers):
    texts = [*ODD, *WHITE, "▁"]
    df = with_clashes(docs_of(spark, texts))
    df = df.unionByName(df.where("doc_id = 9")).unionByName(df.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    all_rows = [(k, t) for k, t in enumerate(texts)] + [(9, texts[9]), (None, texts[8])]
    want = rows_of(*brute([t for _, t in all_rows], *tokenizers))
    got = [(r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.align(df).collect()]
    assert sorted(got, key=repr) == sorted(((k, *w) for (k, _), w in zip(all_rows, want, strict=True)), key=repr)
    assert alignment.align(docs_of(spark, [])).collect() == []
    assert alignment.align(docs_of(spark, [None, ""])).select("n_a", "count_sum", "groups_sha256").collect() == [(0, 0, "")] * 2


def test_linked_pairs_are_bounded_by_the_vocabularies(tokenizers):
    a, b = tokenizers
    assert alignment.linkable([b"ab", b"b"], [b"b", b"xab", b"c"]) == 4
    assert alignment.linkable(a.bytes, b.bytes) < 1 << 19
