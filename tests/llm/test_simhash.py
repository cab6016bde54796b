"""SimHash classes against all pairs of texts, and on odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marlstone.llm import queries, simhash
from tests.llm.test_operators import ODD, TOKEN, docs_of, low, with_clashes


def brute_print(text, width=3):
    words = [w.encode() for w in TOKEN.findall(low(text or ""))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints: list, radius=3) -> list:
    """The least place of each place's component."""
    label = list(range(len(prints)))
    x = np.array(prints, np.uint64)
    for k in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[k]) <= radius).tolist():
            a, b = label[k], label[j]
            if a != b:
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label


def test_query_against_brute_force(spark, small):
    rows = queries.table(spark, small, "documents").orderBy("doc_id").collect()
    prints = [brute_print(r["text"]) for r in rows]
    label = brute_classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op11_simhash(spark, small).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", rows[k]["doc_id"]) for r, p, k in zip(rows, prints, label, strict=True)}
    assert len(set(label)) < len(rows)


def test_odd_rows(spark):
    df = with_clashes(docs_of(spark, [*ODD, "a b c d", "A  B\nc\x0bd", "a b", "b a"]))
    df = df.unionByName(df.where("doc_id = 9")).unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    texts = [*ODD, "a b c d", "A  B\nc\x0bd", "a b", "b a", ODD[9]]
    found = simhash.classes(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"]) for r in found if r["doc_id"] is not None) == sorted((False, k if k < len(texts) - 1 else 9, f"{brute_print(t):016x}") for k, t in enumerate(texts))
    of = {r["doc_id"]: r["component_id"] for r in found}
    assert {k for k, c in of.items() if c == 0} >= {0, 1, 2} and of[10] == of[9] == 9 and of[len(ODD)] == of[len(ODD) + 1]
    assert of[None] == 3  # in the class of the same text, which it does not name
    assert simhash.classes(docs_of(spark, [])).collect() == []
    alone = simhash.classes(docs_of(spark, ["x y z"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert [(r["doc_id"], r["component_id"]) for r in alone] == [(None, None)]


def test_just_half_is_no_majority(spark):
    words = ["p", "q", "r", "s"]  # two shingles: a bit that one of them has is 0
    both = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in (0, 1)]
    assert simhash.classes(docs_of(spark, [" ".join(words)])).first()["fingerprint"] == f"{both[0] & both[1]:016x}"


@pytest.mark.parametrize(("parts", "tile"), [(1, 64), (2, 50), (4, 4096), (8, 7), (None, 30)])
def test_no_link_is_lost(spark, parts, tile):
    """Chains of three bits a step, pairs of three and four bits, and noise, in tiles of several sizes."""
    rnd = random.Random(parts or 0)
    prints = {0, (1 << 64) - 1, 7, 0xF0}
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            prints.add(x)
            for bit in rnd.sample(range(64), rnd.randint(2, 5)):
                x ^= 1 << bit
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, tile, parts).collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in edges)
    at = {p: k for k, p in enumerate(signed)}
    label = list(range(len(prints)))
    for a, b in edges:
        x, y = label[at[a]], label[at[b]]
        label = [min(x, y) if v in (x, y) else v for v in label]
    assert label == brute_classes(prints)


def test_links_of_a_tile_pair_are_a_forest():
    x = np.arange(300, dtype=np.uint64) % np.uint64(8) + (np.arange(300, dtype=np.uint64) << np.uint64(40))
    a, b = simhash.forest(x, x, 64, 1000)
    assert len(a) == len(x) + len(x) - 1  # all within reach: one tree over both sides


def test_offsets():
    assert simhash.offsets_within(1, 3) == [0, 1, 2, 3]
    assert [len(simhash.offsets_within(p, 3)) for p in (2, 4, 8)] == [13, 65, 417]
    assert [simhash.parts_for(n, 4096) for n in (10**4, 3 * 10**5, 10**7, 10**9)] == [1, 2, 4, 8]
