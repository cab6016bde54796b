"""Surrogates: a plain Python version finds the same entities, and the query's replacements keep them apart and together."""

from __future__ import annotations

import ipaddress
from collections import defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

from marlstone.llm import pii, queries
from tests.llm.test_operators import docs_of

FINDERS = {k: regex.compile(p) for k, p in pii.PATTERNS.items()}
FIND = regex.compile(pii.ANY)


def kind_and_form(entity: str) -> tuple[str, str]:
    kind = next(k for k, p in FINDERS.items() if p.fullmatch(entity))
    if kind in ("card", "phone", "ssn"):
        return kind, "".join(c for c in entity if c.isdigit())
    if kind == "iban":
        return kind, entity.replace(" ", "")
    if kind == "ipv6":
        return kind, ipaddress.ip_address(entity).exploded
    return kind, " ".join(entity.lower().split()[1:]) if kind == "name" else entity.lower()


def bare(kind: str, made: str) -> str:
    """What a surrogate says, whatever its layout."""
    return "".join(c for c in made if c.isdigit()) if kind in ("card", "phone", "ssn") else ipaddress.ip_address(made).exploded if kind == "ipv6" else made.replace(" ", "").lower()


def held_against(pairs) -> dict:
    """Of (text, new text, number replaced): the surrogate of each entity, told from the places between the entities."""
    made = defaultdict(set)
    for text, new, n in pairs:
        entities = [m[0] for m in FIND.finditer(text or "")]
        assert n == len(entities)
        if not entities:
            assert new == text
            continue
        between = FIND.split(text)
        found = regex.fullmatch("(.+?)".join(map(regex.escape, between)), new, regex.DOTALL)
        assert found, (text[:200], new[:200])
        for e, m in zip(entities, found.groups(), strict=True):
            kind, form = kind_and_form(e)
            made[kind, form].add(bare(kind, m))
    for (kind, form), values in made.items():
        assert len(values) == 1, (kind, form, values)
    for kind in {k for k, _ in made}:
        own = {f: min(v) for (k, f), v in made.items() if k == kind}
        assert len(set(own.values())) == len(own)  # distinct ones stay distinct
        assert not {bare(kind, f) for f in own} & set(own.values())  # and none is another's
    return made


def test_query_against_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, small, "documents").collect()}
    rows = queries.op10_pii(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    made = held_against([(texts[r["doc_id"]], r["text"], r["n_replaced"]) for r in rows])
    assert len({k for k, _ in made}) >= 3


def test_generated_texts(spark):
    """Every kind in several notations, repeated across texts."""
    rng = np.random.default_rng(4)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    v6 = [f"2001:db8:{k:x}::{k + 1:x}" for k in range(12)] + ["::1", "2001:db8::", "fe80::1", "::8a2e:370:7334"]
    said = [v6, [f"10.{k}.3.{k + 4}" for k in range(20)], [f"User{k}@Mail{k % 3}.example.org" for k in range(20)], [f"{k:03d}-55-{k:04d}" for k in range(20)], [f"+1 555 01{k} {k:04d}" for k in range(10, 30)], [f"4{k:03d} 1111 2222 {k:04d}" for k in range(20)], [f"{k:032x}" for k in range(10, 30)]]

    def written(e):
        how = int(rng.integers(3))
        if ":" in e:
            a = ipaddress.ip_address(e)
            return [e, a.exploded, ":".join(f"{int(g, 16):X}" for g in a.exploded.split(":"))][how]
        if "@" in e:
            return [e, e.lower(), e.upper()][how]
        return e.replace(" ", "") if e[0] == "4" and how else e

    texts = [" and ".join(written(pick(pick(said))) + "," * int(rng.integers(2)) + " then" for _ in range(8)) for _ in range(120)]
    rows = pii.replace(docs_of(spark, texts), "k", counts=True).collect()
    made = held_against([(texts[r["doc_id"]], r["text"], r["n_replaced"]) for r in rows])
    assert {k for k, _ in made} == {"ipv6", "ip", "email", "ssn", "phone", "card", "key"} and len([1 for k, _ in made if k == "ipv6"]) == len(v6)


def one(spark, *texts):
    return [r["text"] for r in pii.replace(docs_of(spark, list(texts)), "k").orderBy("doc_id").collect()]


def test_names_end_where_they_end(spark):
    a, b, c, d, e = one(
        spark,
        "Mr. Smith Monday went; Mr. Smith Friday came.",
        "Dr. Who The doctor. Mrs. May came in May. MRS. MAY, IN MAY.",
        "MR. JOHN SMITH and Mr John  Smith, then SMITH and Smith and John  Smith.",
        "Mr. A. Smith On Tuesday, Mr J. R. Smith, Herr Müller Montag",
        "fe80:0:0:0:0:0:0:1 is fe80::1, and FE80::1; std::vector a::b 12:30:45 ::",
    )
    m = regex.fullmatch(r"Mr\. (\w+) Monday went; Mr\. (\w+) Friday came\.", a)
    assert m and m[1] == m[2] != "Smith"
    m = regex.fullmatch(r"Dr\. (\w+) The doctor\. Mrs\. (\w+) came in May\. MRS\. (\w+), IN MAY\.", b)
    assert m and m[3] == m[2].upper() != "MAY"
    m = regex.fullmatch(r"MR\. (\w+ \w+) and Mr (\w+ \w+), then (\w+) and (\w+) and (\w+ \w+)\.", c)
    assert m and m[1] == m[2].upper() and m[2] == m[5] and m[3] == m[1].split()[1] and m[4] == m[2].split()[1] and "mith" not in c.lower()
    m = regex.fullmatch(r"Mr\. (.+) On Tuesday, Mr (.+), Herr (\w+) Montag", d)
    assert m and m[1].split()[-1] == m[2].split()[-1] and "Smith" not in d and m[3] != "Müller"
    m = regex.fullmatch(r"(\S+) is (\S+), and (\S+); std::vector a::b 12:30:45 ::", e)
    assert m and ipaddress.ip_address(m[1]) == ipaddress.ip_address(m[2]) == ipaddress.ip_address(m[3]) != ipaddress.ip_address("fe80::1")
    assert "::" not in m[1] and "::" in m[2] and m[3] == m[2].upper()


def test_surnames_have_no_end(spark):
    """More surnames of a script than it has words of four syllables."""
    n = 60_000
    found = spark.range(n).select(F.lit("surname").alias("kind"), F.concat(F.lit("ж"), F.translate(F.col("id").cast("string"), "0123456789", "абвгдежзик")).alias("form"), F.lit("f cyrillic").alias("style"))
    made = pii.dictionary(found, "k")
    assert made.count() == n == made.select(F.lower("made")).distinct().count() > 15**4
    assert made.where(F.length("made") > 8).count() > 0
    crowd = found.limit(40).withColumn("kind", F.lit("given"))
    assert pii.dictionary(crowd, "k").select("made").distinct().count() == 40
