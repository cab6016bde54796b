"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.llm import decontam, langid, lbl, neardup, packing, pii, quality, queries, shared, textbytes, toxicity, urlfilter, warc
from tests.compare import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def low(t: str) -> str:
    return t.translate({i: i + 32 for i in range(65, 91)})


def docs_of(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, (t, g) in enumerate(zip(texts, langs, strict=True))], DOCS)


@pytest.fixture(scope="module")
def corpus(spark, small):
    return {r["doc_id"]: r for r in queries.table(spark, small, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, name):
    same(queries.QUERIES[name](spark, small), queries.ORACLE_SQL[name], small)


ODD = ["", None, "   ", "x", "é" * 5, "word " * 30_000, "a\nb\nb\nb", "\x00\x01", "日本語 テキスト", "Same text here now ok", "Same text here now ok"]


def with_clashes(df):
    """Columns named as the operators name theirs."""
    names = ["score", "text2", "decontam", "langid", "quality", "_text", "rid", "kept", "n_replaced", "_rid", "class_id", "label", "_row", "_new", "_d0", "_e0", "_lang", "_letters", "_kept", "n"]
    return df.withColumns({n: F.lit("mine") for n in names})


@pytest.mark.parametrize("name", ["op1_langid", "op3_neardup", "op4_decontam", "op6_toxicity", "op7_lbl", "op8_packing", "op9_quality", "op10_pii"])
def test_odd_and_empty_tables(spark, tmp_path, name):
    for k, texts in enumerate((ODD, [])):
        d = str(tmp_path / str(k))
        df = with_clashes(docs_of(spark, texts, [None if i % 3 == 0 else "en" for i in range(len(texts))]))
        if texts:
            df = df.unionByName(df.where("doc_id = 9")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
        df.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(0, "same text here now ok"), (1, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([(0, 1, 1), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        rows = queries.QUERIES[name](spark, d).collect()
        n = len(texts) + 2 if texts else 0
        if name == "op8_packing":
            assert len({(r["doc_id"]) for r in rows}) == (len(texts) + 1 if texts else 0)
        else:
            assert len(rows) == n


@pytest.mark.parametrize("name", ["op2_warc", "op5_urlfilter"])
def test_odd_and_empty_pages(spark, tmp_path, name):
    rows = [(1, "http://A.example.NET/en/x?y", "h" * 200), (2, None, None), (3, "no scheme", ""), (4, "x://", "h" * 200), (4, "http://h/\n a", "h" * 200), (None, "http://n.net", "h" * 200), (6, "http://cheap-pills.example.net:80/", "é" * 20_000), (7, "a://b.org/fr/://net/", "WARC/1.1\r\n\r\n0\r\n\r\n" * 20)]
    for k, part in enumerate((rows, [])):
        d = str(tmp_path / str(k))
        spark.createDataFrame(part, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("host", F.lit(1)).write.parquet(f"{d}/pages.parquet")
        got = queries.QUERIES[name](spark, d).collect()
        assert len(got) == len(part)
    by = defaultdict(list)
    for r in queries.QUERIES[name](spark, str(tmp_path / "0")).collect():
        by[r["page_id"]].append(r)
    if name == "op2_warc":
        assert by[1][0]["record_type"] == "response" and {r["refers_to"] for r in by[4] + by[None]} == {1}
        for i, _, h in rows:
            assert {(r["payload_bytes"], r["payload_digest"]) for r in by[i]} == {(len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())}
    else:
        assert by[1][0]["rule"] == "example.net/en/" and by[1][0]["verdict"] == "allow"
        assert (by[2][0]["host"], by[3][0]["host"], by[2][0]["verdict"]) == ("", "", "allow")
        assert by[7][0]["host"] == "b.org" and by[7][0]["path"] == "/fr/://net/" and by[7][0]["rule"] == "org/fr/"


# ---- shared


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n.日", max_size=20), max_size=8))
def test_spans_and_hashes(texts):
    spans = textbytes.Spans(*textbytes.of_texts(texts), textbytes.NOT_SPACE)
    words = [w for t in texts for w in TOKEN.findall(t)]
    assert len(spans) == len(words) and spans.counts.tolist() == [len(TOKEN.findall(t)) for t in texts]
    h = spans.hashes().tolist()
    assert len(set(h)) == len(set(words)) and dict(zip(words, h, strict=True)) == dict(zip(words[::-1], h[::-1], strict=True))


def test_hash_depends_on_order():
    data, offsets = textbytes.of_texts(["ab ba abc acb"])
    assert len(set(textbytes.Spans(data, offsets, textbytes.NOT_SPACE).hashes().tolist())) == 4


def test_row_slices_are_whole_rows():
    offsets = np.array([0, 5, 5, 100, 101, 102])
    assert [x for a, b in textbytes.row_slices(offsets, 10) for x in range(a, b)] == list(range(5))


# ---- 1


def test_langid_accuracy_and_fold(spark, small, corpus):
    rows = queries.op1_langid(spark, small).collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {i for i in corpus if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == corpus[r["doc_id"]]["lang"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    crf = langid.Crf(["a", "b", "c"], rng.normal(0, 1, (1 << 12, 3)).astype(np.float32), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3), 12)
    texts = ["ab cd ef gh", "", "xyz", "hello big wide"]
    spans = textbytes.Spans(*textbytes.of_texts(texts), textbytes.LETTERS)
    emit = crf.emissions(spans)
    post, alpha, sent = crf.marginals(spans, emit)
    import itertools

    for d in range(len(texts)):
        e = emit[spans.first[d] : spans.first[d + 1]]
        total, want, pair = 0.0, np.zeros_like(e), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=len(e)):
            if len(path):
                w = math.exp(crf.start[path[0]] + sum(e[t][y] for t, y in enumerate(path)) + sum(crf.trans[a][b] for a, b in zip(path, path[1:], strict=False)))
                total += w
                for t, y in enumerate(path):
                    want[t][y] += w
                if len(path) > 1:
                    pair[path[0]][path[1]] += w
        if len(e):
            assert np.allclose(want / total, post[spans.first[d] : spans.first[d + 1]], atol=1e-4)
        if len(e) > 1:
            k = spans.first[d]
            both = alpha[k][:, None] * np.exp(crf.trans) * sent[k + 1][None, :]
            assert np.allclose(pair / total, both / both.sum(), atol=1e-4)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_unlearned_languages_and_gibberish_go(spark, corpus, n):
    by = defaultdict(list)
    for r in sorted(corpus.values(), key=lambda r: r["doc_id"]):
        if r["text"] and len(r["text"].split()) >= 60:
            by[r["lang"]].append(r["text"])
    names = sorted(by)
    known, other = [(g, t) for g in names[:n] for t in by[g]], by[names[3]][:10]
    rng = np.random.default_rng(2)
    noise = [" ".join("".join(rng.choice(list("qxzjkvwhcbpfy"), 6)) for _ in range(80)) for _ in range(10)]
    model = langid.train([t for _, t in known], [g for g, _ in known])
    made = langid.label(docs_of(spark, [t for _, t in known] + other + noise), model)
    found = {r["doc_id"]: r["langid"] for r in made.select("doc_id", "langid").collect()}
    assert all(r["lang"] in names[:n] and r["score"] > 0 for r in found.values())  # a learned language all the same
    assert np.mean([not found[i]["foreign"] for i in range(len(known))]) > 0.97
    assert sum(found[len(known) + i]["foreign"] for i in range(20)) >= 19


def test_any_letter_gets_a_learned_language(spark, corpus):
    by = defaultdict(list)
    for r in corpus.values():
        by[r["lang"]].append(r["text"])
    model = langid.train([t for g in by for t in by[g][:20]], [g for g in by for _ in by[g][:20]])
    texts = ["Hello", "A.\nAll rights reserved.", "x", "日本", "ж 1", "", None, " 1, 2!", "\u0301", "١٢"]
    rows = [r for _, r in sorted((r["doc_id"], r) for r in langid.predict(docs_of(spark, texts), model).collect())]
    assert [r["lang_pred"] in by for r in rows] == [True] * 5 + [False] * 5
    assert {(r["lang_pred"], r["score"]) for r in rows[5:]} == {("und", 0.0)}


def test_langid_labels_switched_text(corpus):
    by = defaultdict(list)
    for r in corpus.values():
        by[r["lang"]].append(r["text"])
    crf = langid.train([t for g in ("en", "fr") for t in by[g][:20]], [g for g in ("en", "fr") for _ in by[g][:20]])
    a, b = by["en"][21].split()[:40], by["fr"][21].split()[:40]
    spans = textbytes.Spans(*textbytes.of_texts([" ".join(a + b)]), textbytes.LETTERS)
    label = crf.marginals(spans)[0].argmax(1)
    n = len(textbytes.Spans(*textbytes.of_texts([" ".join(a)]), textbytes.LETTERS))
    assert (label[:n] == 0).mean() > 0.9 and (label[n:] == 1).mean() > 0.9


def test_langid_learns_languages_of_long_texts_alone_and_every_language(spark):
    rng = np.random.default_rng(6)
    say = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    texts = [say("abcdefg", 40) for _ in range(20)] + [say("qrstuvw", 5000) for _ in range(20)]
    rows = langid.predict(docs_of(spark, texts, ["short"] * 20 + ["long"] * 20)).collect()
    assert all(r["lang_pred"] == ("short" if r["doc_id"] < 20 else "long") for r in rows)
    names = [f"l{k:03d}" for k in range(203)]
    crf = langid.fit(docs_of(spark, [f"w{n} x{n}" for n in names] * 3, names * 3), modulus=1, held=1, bits=10, epochs=1)
    assert crf.labels == names


# ---- 2


def test_language_query_against_brute_force(spark, small, corpus):
    """Forward-backward a word at a time, in logarithms, over each whole text; shares, label and fold of the query."""
    docs = queries.table(spark, small, "documents")
    model = langid.fit(docs)
    rows = {r["doc_id"]: r for r in queries.op1_langid(spark, small).collect()}
    assert set(rows) == set(corpus)
    add = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for i in sorted(corpus):
        spans = textbytes.Spans(*textbytes.of_texts([corpus[i]["text"] or ""]), textbytes.LETTERS)
        r = rows[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not any(c.isalpha() for c in corpus[i]["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        e = model.emissions(spans).astype(np.float64)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = model.start + e[0]
        for k in range(1, len(e)):
            alpha[k] = add(alpha[k - 1][:, None] + model.trans, 0) + e[k]
        for k in range(len(e) - 2, -1, -1):
            beta[k] = add(model.trans + (e[k + 1] + beta[k + 1])[None, :], 1)
        post = alpha + beta
        share = np.exp(post - add(post, 1)[:, None]).mean(0)
        assert r["score"] == pytest.approx(share.max(), abs=2e-3)
        assert r["lang_pred"] == model.labels[share.argmax()] or np.sort(share)[-1] - np.sort(share)[-2] < 2e-3


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunk_framing_round_trip(payload, chunk):
    assert warc.unframe(warc.frame(payload, chunk)) == payload
    assert warc.unhttp(warc.HTTP_HEAD + warc.frame(payload, chunk)) == payload


def test_framing_with_extensions_and_damage():
    assert warc.unframe(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unframe(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_of_a_member_a_record_with_misleading_payloads(spark, tmp_path):
    """Payloads that look like records, ids with line ends, several members and files; what is cut short is refused."""
    import gzip

    odd = [b"", b"x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", b"\r\n\r\nWARC/\r\n\r\nWARC/", bytes(range(256)) * 400, b"end\r\n\r\n"]

    def record(k, body):
        return b"WARC/1.%d\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k % 2, k, len(body), body)

    whole = [record(k, b) for k, b in enumerate(odd)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(whole[::-1])))
    (tmp_path / "plain.warc").write_bytes(b"".join(whole))
    got = sorted((r["origin"], bytes(r["block"])) for r in warc.parse_archives(spark, str(tmp_path)).collect())
    assert got == sorted((f"<r{k}>", b) for k, b in enumerate(odd) for _ in range(3))
    many = [b"\r\n" * (k % 9) + b"x" * (k % 211) + b"\r\n" * (k % 7) for k in range(6000)]  # line ends at every place of the reader's buffers
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.warc.gz").write_bytes(gzip.compress(b"".join(record(k, b) for k, b in enumerate(many))))
    got = {r["origin"]: bytes(r["block"]) for r in warc.parse_archives(spark, str(tmp_path / "many")).collect()}
    assert got == {f"<r{k}>": b for k, b in enumerate(many)}
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(whole[3][:-900]))
    with pytest.raises(Exception, match="cut short"):
        warc.parse_archives(spark, str(tmp_path)).collect()


def test_archives_keep_any_id(spark):
    rows = [("a\r\nWARC-Type: x", "http://a/ b", "p" * 200), ("ü:é", "http://b/", "p" * 200), (None, None, "q"), ("", "http://c/", "r\r\n\r\nWARC/1.1\r\n" * 40_000)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got["ü:é"]["refers_to"] == rows[0][0] and got[""]["payload_bytes"] == len(rows[3][2])



def test_segments(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "".join(map(str, range(i * 700)))) for i in range(6)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.plan_records(pages), path, segment_bytes=1000, chunk_bytes=300, records_per_file=3)
    parsed = warc.parse_archives(spark, path).cache()
    assert parsed.where("segment > 1 and record_type = 'continuation'").count() > 5
    assert parsed.where("total is not null").count() == parsed.where("segment = 1").count()
    back = {int(r["page_id"]): bytes(r["payload"]).decode() for r in warc.read_archives(spark, path).collect()}
    assert back == {r["page_id"]: r["html"] for r in pages.collect()}


def test_lost_segment_is_told(spark, tmp_path):
    heads = "WARC-Type: {}\r\nWARC-Record-ID: {}\r\nContent-Length: 3\r\nWARC-Segment-Number: {}\r\n"
    one = "WARC/1.1\r\n" + heads.format("response", "<a>", 1) + "\r\nabc\r\n\r\n"
    three = "WARC/1.1\r\n" + heads.format("continuation", "<c>", 3) + "WARC-Segment-Origin-ID: <a>\r\nWARC-Segment-Total-Length: 9\r\n\r\nghi\r\n\r\n"
    two = three.replace("<c>", "<b>").replace("Number: 3", "Number: 2").replace("WARC-Segment-Total-Length: 9\r\n", "").replace("ghi", "def")
    (tmp_path / "x.warc").write_bytes((three + one).encode())
    with pytest.raises(Exception, match="segments missing"):
        warc.read_archives(spark, str(tmp_path)).collect()
    (tmp_path / "y.warc").write_bytes(two.encode())
    block = warc.parse_archives(spark, str(tmp_path)).count()
    assert block == 3 and bytes(warc.read_archives(spark, str(tmp_path)).first()["payload"]) == b""  # no HTTP body in nine letters


# ---- 3


def bag(text, width=5):
    w = WORD.findall(low(text or ""))
    return Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else Counter()


def brute_classes(texts: dict) -> dict:
    bags, has = {i: bag(t) for i, t in texts.items()}, defaultdict(list)
    for i, b in bags.items():
        for s in b:
            has[s].append(i)
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(x, y) for ids in has.values() for x in ids for y in ids if x < y}:
        if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in bags}


def test_classes_equal_all_pairs(spark, small, corpus):
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_neardup(spark, small).collect()}
    assert got == brute_classes({i: r["text"] for i, r in corpus.items()})


def test_chains_and_multisets(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 300)]
    texts, now = [" ".join(base)], list(base)
    for k in range(12):  # each a few words from the one before
        now = list(now)
        for j in rng.integers(0, 300, 4):
            now[j] = f"n{k}{j}"
        texts.append(" ".join(now))
    texts += ["alpha beta gamma delta eps zeta " * 20, "alpha beta gamma delta eps zeta " * 19, "alpha beta gamma delta eps zeta " * 5, "two words", "Two, words!", "", None]
    df = docs_of(spark, texts)
    want = brute_classes(dict(enumerate(texts)))
    for options in ({}, {"few": 1, "block": 3}):
        assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df, **options).collect()} == want
    kept = neardup.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_documents_that_share_a_phrase(spark):
    """A phrase repeated makes all of them alike, some by less than the threshold."""
    rng = np.random.default_rng(4)
    texts = ["so it is " * int(rng.integers(40, 200)) + " ".join(f"u{i}x{k}" for k in range(int(rng.integers(20, 60)))) for i in range(60)]
    want = brute_classes(dict(enumerate(texts)))
    assert 1 < len(set(want.values())) < 60
    for options in ({}, {"few": 2, "block": 8}):
        assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(spark, texts), **options).collect()} == want


def test_overlap_matrix_equals_overlap():
    texts = ["a b c d e f g", "a b c d e f h", "x", "a b c d e " * 5, ""]
    x, y = np.array([0, 3, 4]), np.array([1, 2])
    m = neardup.overlap_matrix(texts, x, y)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            assert m[i, j] == pytest.approx(neardup.overlap([texts[p]], [texts[q]])[0])


def test_signatures_are_unbiased():
    a = [f"w{i}" for i in range(200)]
    pair = [" ".join(a + a[:100]), " ".join(a[:150] + a[:50] * 3)]
    spans = textbytes.Spans(*textbytes.of_texts(pair), textbytes.ALNUM)
    doc, key, weight = neardup.bags(spans)
    rates = []
    for salt in range(25):
        s = neardup.signatures(doc, textbytes.mix(key + np.uint64(salt)), weight, 2, 160)
        rates.append((s[0] == s[1]).mean())
    assert abs(np.mean(rates) - neardup.overlap([pair[0]], [pair[1]])[0]) < 0.03


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert got == parent


# ---- 4


def test_decontam_shards_spans_and_documents(spark):
    passage = [f"p{i}" for i in range(14)]
    texts = ["A b " + " ".join(passage).upper() + " c", " ".join(passage[:9]), "short ITEM. here", None, "clean words"]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, "short item"), (3, None), (10, " ".join(passage[2:]))], "item_id long, text string")
    df = docs_of(spark, texts)
    whole = decontam.report(df, items).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"]) for r in whole] == [(17, 14, 2), (9, 0, 0), (3, 2, 1), (0, 0, 0), (2, 0, 0)]
    assert whole[0]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest() and whole[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontam.report(df, items, shard_bytes=20).orderBy("doc_id").collect() == whole
    assert [r["doc_id"] for r in decontam.decontaminate(df, items).orderBy("doc_id").collect()] == [1, 3, 4]
    cut = [r["text"] for r in decontam.decontaminate(df, items, "spans").orderBy("doc_id").collect()]
    assert cut == ["A b  c", texts[1], ". here", None, "clean words"]


def test_decontam_repeated_items_equal_the_sql(spark, tmp_path):
    d = str(tmp_path)
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(1, passage), (1, passage), (2, "short item"), (2, "other words"), (2, "short item")]
    docs_of(spark, [passage + " short item", "other words, short item", "clean"]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, bench = queries.table(spark, d, "documents"), queries.table(spark, d, "benchmark")
    one = decontam.report(docs, bench).orderBy("doc_id").collect()
    assert [r["n_items"] for r in one] == [2, 1, 0]
    assert decontam.report(docs, bench, shard_bytes=20).orderBy("doc_id").collect() == one
    same(decontam.report(docs, bench), queries.ORACLE_SQL["op4_decontam"], d)


# ---- 5


def test_cascade_is_exact(spark):
    keys = [(f"k{i}", i % 3 == 0) for i in range(3000)]
    for bits in (2, 12):
        cascade = urlfilter.build(spark.createDataFrame(keys, "key string, listed boolean"), bits_per_key=bits, k=2)
        assert all((k in cascade) == v for k, v in keys)
        assert bits == 12 or len(cascade.levels) > 2
        assert cascade.bytes() == sum(map(len, cascade.levels)) == len(b"".join(x.tobytes() for x in cascade.levels))
    with pytest.raises(urlfilter.TooLarge):
        urlfilter.build(spark.createDataFrame(keys, "key string, listed boolean"), max_bytes=64)
    assert not urlfilter.Cascade([], 2).listed((np.zeros(3, np.uint64),) * 2).any()


def test_keys_without_a_closing_slash_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/y")], "page_id long, url string")
    for rules, key in (({"a.com": "block"}, "b.com/"), ({"a.com/x": "block"}, "b.com/"), ({"a.com/": "block"}, "b.com"), ({}, "b.com/x")):
        with pytest.raises(ValueError, match="host/"):
            urlfilter.judge(pages, rules, spark.createDataFrame([(key,)], "key string"))
    twice = spark.createDataFrame([("a.com/x/",), ("a.com/x/",), (None,)], "key string")
    assert urlfilter.judge(pages.union(pages), {}, twice).select("verdict").collect() == [("block",)] * 2


def test_block_list_gives_both_verdicts(spark):
    """Folders with and without rules, listed and not; thousands of keys, most of no page."""
    d = "/root/testdata/sf0.1"
    rows = queries.op5_urlfilter(spark, d)
    verdicts = {r["verdict"]: r["count"] for r in rows.where("rule is null").groupBy("verdict").count().collect()}
    assert verdicts["block"] > 100 and verdicts["allow"] > 100
    assert queries.block_list(queries.table(spark, d, "pages")).count() > 2500


def test_shards_agree(spark, small):
    pages = queries.table(spark, small, "pages")
    blocked = queries.block_list(pages)
    one = sorted(urlfilter.judge(pages, queries.RULES, blocked).collect(), key=lambda r: r["page_id"])
    many = sorted(urlfilter.judge(pages, queries.RULES, blocked, max_bytes=200).collect(), key=lambda r: r["page_id"])
    assert one == many


# ---- 6


def test_toxicity_score_against_brute_force(spark):
    """Each text's score by a dictionary of its words and word beginnings; repeated labels, nulls, empty and repeated texts."""
    bad = [f"vile{c}rant awful{c} nasty words here" for c in "abcdefghij"]
    good = [f"calm {c}lake under green hills and {c}{c} quiet birds" for c in "abcdefghijklmnopqrstuvwxyz"]
    texts = [(bad[i % 10] + " " if i % 3 == 0 else "") + good[i % 26] + (" vilest" * (i % 5) if i % 3 == 0 else "") for i in range(160)] + [None, "", "12 34", "VILEARANT " * 5]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(0, 160, 2) for _ in range(1 + i % 3)] + [(1, 0, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id = 4"))
    model = toxicity.fit(docs, labels)
    assert len(model.keys)
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(texts) + 1
    weight = {int(k): w for k, w in zip(model.keys, model.weights, strict=True)}

    def key(word, k):
        found = toxicity.keys_of(textbytes.Spans(*textbytes.of_texts([word]), textbytes.LETTERS))
        return int(found[0][0][0]) if k is None else int(found[1 + toxicity.PREFIXES.index(k)][0][0])

    for r in rows:
        words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", texts[r["doc_id"]] or "")
        seen = Counter(key(w, k) for w in words for k in (None, *toxicity.PREFIXES) if k is None or len(w.encode()) > k)
        margin = model.bias + model.length * math.log1p(len(words)) + sum(weight[f][:min(n, 3)].sum() for f, n in seen.items() if f in weight)
        want = 1 / (1 + math.exp(-max(-40, min(40, margin))))
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (want >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    toxic = {i for i in range(160) if i % 3 == 0}
    assert min(r["score"] for r in rows if r["doc_id"] in toxic) > max(r["score"] for r in rows if r["doc_id"] < 160 and r["doc_id"] not in toxic)


def test_toxicity_descends_its_risk():
    """The corrected risk of the fit, by its formula, is below that of no model, and the prior moves it."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    plain = [" ".join(word() for _ in range(30)) for _ in range(300)]
    bad = [t + " rotten filth" * int(rng.integers(1, 4)) for t in plain[:60]]

    def risk(model, prior):
        p, u = (np.array([model.margin(textbytes.Spans(*textbytes.of_texts([t]), textbytes.LETTERS))[0] for t in x]) for x in (bad, plain[60:] + bad[:30]))
        return prior * np.logaddexp(0, -p).mean() + max(0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    fitted = toxicity.train(bad, plain[60:] + bad[:30], 0.1)
    nothing = toxicity.Classifier(np.zeros(0, np.uint64), np.zeros((0, toxicity.LEVELS)), 0.0, 0.0)
    assert risk(fitted, 0.1) < 0.5 * risk(nothing, 0.1)
    none = toxicity.train([], plain, 0.1)
    assert none.margin(textbytes.Spans(*textbytes.of_texts(["filth"]), textbytes.LETTERS))[0] < 0


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op6_toxicity(spark, d).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in queries.table(spark, d, "labels").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in rows.items())
    pos = [rows[i]["score"] for i, t in marks.items() if t == 1]
    neg = [rows[i]["score"] for i, t in marks.items() if t == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.8


# ---- 7


def test_lm_base_and_normalisation(spark, small, corpus):
    rows = {r["doc_id"]: r for r in queries.op7_lbl(spark, small).collect()}
    tokens = {i: [*TOKEN.findall(low(r["text"] or "")), None] for i, r in corpus.items()}
    count = Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(count[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), abs=1e-6)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_tail_is_joined(spark, small):
    docs = queries.table(spark, small, "documents")
    whole = {r["doc_id"]: r for r in lbl.score(docs).collect()}
    cold = {r["doc_id"]: r for r in lbl.score(docs, hot=1500).collect()}
    for i, r in whole.items():
        assert cold[i]["n_known"] == r["n_known"] and cold[i]["base_score"] == pytest.approx(r["base_score"], abs=1e-6)


def test_lm_tables_are_log_probabilities():
    rng = np.random.default_rng(0)
    m = lbl.LogBilinear(np.zeros(5, np.uint64), rng.normal(0, 1, (7, 4)), rng.normal(0, 1, 7), rng.normal(0, 1, (7, 4)), rng.normal(0, 1, (7, 4)))
    s1, s2, z = m.tables()
    p = np.exp(s1[:, None, :] + s2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(2), 1, atol=1e-5)


def test_lm_learns_from_all_texts(spark, small, monkeypatch):
    """Class vectors see every training token; the classes grow with the corpus."""
    seen, plain = [], lbl.learn_all

    def spied(*args):
        seen.append(plain(*args))
        return seen[-1]

    monkeypatch.setattr(lbl, "learn_all", spied)
    docs = queries.table(spark, small, "documents")
    few = lbl.score(docs, sample_docs=1).collect()  # a start of next to nothing
    assert seen[0].seen == few[0]["train_tokens"]
    held = [r for r in few if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lbl.growth(1 << 22, 1 << 22) == 1 and lbl.growth(1 << 30, 1 << 22) == 4


@pytest.mark.parametrize("hot", [1 << 18, 700])
def test_lm_score_against_brute_force(spark, small, corpus, monkeypatch, hot):
    """Every token's probability by plain softmaxes over classes and over the words of a class; all words' sum to 1."""
    seen, plain = [], lbl.fit

    def spied(*args, **options):
        seen.append(plain(*args, **options))
        return seen[-1]

    monkeypatch.setattr(lbl, "fit", spied)
    rows = {r["doc_id"]: r for r in lbl.score(queries.table(spark, small, "documents"), hot=hot, classes=130, size=40).collect()}
    (m,) = seen
    tokens = {i: TOKEN.findall(low(r["text"] or "")) for i, r in corpus.items()}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(t for i in learn for t in tokens[i])
    hashes = lambda ws: textbytes.Spans(*textbytes.of_texts([" ".join(ws)]), textbytes.NOT_SPACE).hashes()
    words = {int(h): k for k, h in enumerate(m.words.hashes)}
    place = {w: words.get(int(h)) for ws in [list({*count, *(w for ts in tokens.values() for w in ts)})] for w, h in zip(ws, hashes(ws), strict=True)}
    outside = {w: c for w, c in count.items() if place[w] is None}
    rest = sum(outside.values()) + len(outside) + 1
    assert len(m.words.hashes) <= hot and (hot < 1000) == bool(outside) and m.words.many().any()

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def chances(a, b):
        h = (m.p1[a] + m.p2[b]).astype(np.float64)
        return h, softmax(m.q @ h + m.b)

    def chance(w, a, b):
        h, by_class = chances(a, b)
        if w is None:
            return by_class[lbl.STOP]
        k = place[w]
        if k is None:
            return by_class[lbl.REST] * (count[w] + 1) / rest
        c = m.words.classes[k]
        i, j = m.words.begin[c], m.words.begin[c + 1]
        return by_class[c] * softmax(m.words.vectors[i:j].astype(np.float64) @ h + m.words.bias[i:j])[m.words.place[k] - i]

    cls = lambda w: lbl.REST if place[w] is None else int(m.words.classes[place[w]])
    for i in sorted(corpus)[:12]:
        a = b = lbl.STOP
        want = 0.0
        for w in [*tokens[i], None]:
            want += math.log10(chance(w, a, b))
            a, b = (cls(w) if w is not None else lbl.STOP), a
        assert rows[i]["score"] == pytest.approx(want, rel=1e-4)
        assert rows[i]["n_model"] == 1 + sum(place[w] is not None for w in tokens[i])
    a, b = cls(max(count, key=count.get)), lbl.STOP
    assert sum(chance(w, a, b) for w in [*count, None]) + chances(a, b)[1][lbl.REST] / rest == pytest.approx(1 if outside else 1 + chances(a, b)[1][lbl.REST] / rest - chances(a, b)[1][lbl.REST], abs=1e-3)


def test_lm_words_within_classes_learn_from_all_texts(spark, small, monkeypatch):
    """With a sample of one text every word of a class of several is moved, and told by its neighbours in all texts."""
    seen, plain, near = [], lbl.learn_words, lbl.near_all

    def spied(docs, words, *args):
        seen.append((words, *plain(docs, words, *args)))
        return seen[-1][1:]

    def summed(docs, hashes, singles):
        own = lbl._Near(len(hashes), singles)
        for r in docs.collect():
            at, hit = lbl.found(hashes, textbytes.Spans(*textbytes.of_texts([r["text"] or ""]), textbytes.NOT_SPACE).hashes(textbytes.LOWER))
            own.add(np.concatenate(([-1], np.where(hit, at, -1), [-1])))
        out = near(docs, hashes, singles)
        assert (out == own.points.T).all() and out.any()
        return out

    monkeypatch.setattr(lbl, "learn_words", spied)
    monkeypatch.setattr(lbl, "near_all", summed)
    lbl.score(queries.table(spark, small, "documents"), sample_docs=1, classes=130, size=40).count()
    ((words, vectors, moved),) = seen
    several = np.repeat(words.many(), np.diff(words.begin))
    assert several.any() and (moved[several] > 0).all() and vectors[several].any(1).all() and not vectors[~several].any()


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(0)
    for hashes in (rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), np.arange(500, dtype=np.uint64), np.array([0, 1 << 63, (1 << 64) - 1], np.uint64), np.zeros(0, np.uint64)):
        hashes = np.unique(hashes)
        x = np.concatenate([hashes, hashes[:2000] + np.uint64(1), rng.integers(0, 1 << 63, 3000).astype(np.uint64)])
        at, hit = lbl.found(hashes, x)
        assert hit.tolist() == np.isin(x, hashes).tolist() and (hashes[at[hit]] == x[hit]).all() and (not len(hashes) or at.max() < len(hashes))


def test_word_vectors_learn_in_their_own_width():
    """A step's arrays are as wide as the vectors; twice as wide they cost twice the time."""
    wide, plain = set(), np.exp
    counts, classes = np.arange(1, 41), np.repeat([2, 3], 20)
    words = lbl.Words.of(np.arange(40, dtype=np.uint64), counts, classes, 4, 8)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(np, "exp", lambda x, *a, **k: (wide.add((np.asarray(x).dtype, np.ndim(x))), plain(x, *a, **k))[1])
        rng = np.random.default_rng(0)
        context, moved = rng.normal(0, 1, (300, 8)).astype(np.float32), np.zeros(40)
        place = rng.integers(0, 40, 300)
        words.learn(place, classes[place], lambda rows: context[rows], np.full((40, 8), 1e-2, np.float32), moved, rng)
    assert (np.dtype(np.float64), 2) not in wide and words.vectors.any(1).all()
    assert moved.sum() == pytest.approx(300 * 9)  # each token, and its eight noise words


def test_like_words_share_a_class():
    """Words of two tongues, told apart by the single words next to them; no class exceeds twice the size."""
    rng = np.random.default_rng(0)
    streams = []
    for k in range(400):
        base = 10 + 200 * (k % 2)
        streams.append(np.array([x for _ in range(20) for x in (5 * (k % 2) + int(rng.integers(5)), base + int(rng.integers(200)))]))
    group = lbl.alike(streams, 500, np.arange(10), 50)
    assert (group[:10] == -1).all() and (group[10:] >= 0).all() and np.bincount(group[10:]).max() <= 100
    assert not set(group[10:210]) & set(group[210:410])


def test_word_counter_is_bounded_and_exact():
    counter = lbl._Counter(most=50)
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(40)]
    out = Counter()
    for t in texts:
        for b in counter.take(*textbytes.of_texts([t]), None):
            for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[h] += n
    for b in counter.finish():
        for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            out[h] += n
    assert out.pop(lbl.END) == 40 and sorted(out.values()) == sorted(Counter(w for t in texts for w in t.split()).values())


# ---- 8


def test_packing_round_trip(spark, small, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op8_packing(spark, small).collect()
    pieces, places, total = defaultdict(list), defaultdict(list), 0
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, doc in corpus.items():
        ids = [*t.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[i]) == want
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(places) <= math.ceil(total / 2048) * 1.05 + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_packer_is_bounded_best_fit(lengths, places):
    packer, free, made = packing.Packer(20, places), {}, 0
    for n in lengths:
        number, offset = packer.put(n)
        fits = {k: v for k, v in free.items() if v >= n}
        if fits:
            assert free[number] == min(fits.values())
            assert offset == 20 - free[number]
            left = free.pop(number) - n
        else:
            assert (number, offset) == (made, 0)
            made += 1
            if len(free) == places:
                fullest = min(free.values())
                gone = [k for k, v in free.items() if v == fullest and k not in packer.stacks[v]]
                assert len(gone) == 1
                free.pop(gone[0])
            left = 20 - n
        if left:
            free[number] = left
        assert len(free) <= places and packer.open == len(free)


def test_word_cache_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, coder = Tokenizer.from_file(path), packing.WordEncoder(path, most=10)
    texts = ["", "I'll don't X'S", "a<|endoftext|>b c", "ΟΔΥΣΣΕΥΣ Σ", "é ́a", "x y z", "12 a1", "日本語 テ", "\x1cfoo", "İst", "ab" * 3000]
    for _ in range(2):
        flat, counts = coder.encode(*textbytes.of_texts(texts))
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_new_words_go_to_the_tokenizer_in_portions():
    """What the tokenizer makes of a text is many times as large, so a slice full of new words is not one call."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path, sizes = public_tokenizers.path("word_bpe_49k.json"), []
    coder, plain = packing.WordEncoder(path), Tokenizer.from_file(path)

    class Spied:
        def encode_batch_fast(self, texts, **options):
            sizes.append(sum(map(len, texts)))
            return plain.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return plain.encode(text, **options)

    coder.tokenizer = Spied()
    texts = [" ".join(f"w{i}x{k}" for k in range(3000)) + " a<|endoftext|>b" for i in range(12)]
    flat, counts = coder.encode(*textbytes.of_texts(texts))
    assert flat.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids] and counts.sum() == len(flat)
    assert sum(map(len, texts)) > 1 << 18 and max(sizes) <= 1 << 17



# ---- 9


def brute_rules(text):
    words = TOKEN.findall(text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    mark = [False] * len(words)
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            mark[k : k + 8] = [True] * 8
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if TOKEN.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, sum(mark)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é日", max_size=60), max_size=5))
def test_base_rules(texts):
    got = quality.base_rules(*textbytes.of_texts(texts)) if texts else []
    assert list(zip(*[x.tolist() for x in got], strict=True)) == [brute_rules(t) for t in texts]


def test_quality_query(spark, small, corpus):
    rows = {r["doc_id"]: r for r in queries.op9_quality(spark, small).collect()}
    for i, doc in corpus.items():
        r, want = rows[i], brute_rules(doc["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_spelling_sums_to_one():
    data, offsets = textbytes.of_texts(["the cat sat on the mat, the cat ran", "a dog ran on"])
    spans = textbytes.Spans(data, offsets, textbytes.NOT_SPACE)
    codes, n = np.unique(quality.spelling_codes(data, spans.starts, spans.ends)[0], return_counts=True)
    model = quality.Spelling.fit(codes, n)
    for context in (int(codes[3]) >> 6, int(codes[10]) >> 6, 63 | 62 << 6 | 61 << 12):
        assert np.isclose((10.0 ** model.score((context << 6) + np.arange(64))).sum(), 1, atol=1e-9)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=50))
def test_numbers_pack(x):
    assert quality.unpack_numbers(quality.pack_numbers(np.array(x, np.uint64))).tolist() == x


def less_discount(counts):
    n = [0, *(sum(c == i for c in counts) for i in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] else 0.5 for i in (1, 2, 3)}
    return lambda c: c - d[min(c, 3)] if c else 0.0


def brute_perplexity(texts):
    """Perplexity a token, by dictionaries of words; with each text's probability of every word after each of its own."""
    split = [TOKEN.findall(low(t or "")) for t in texts]
    numbered = {w for w, c in Counter(w for ws in split for w in ws).items() if c >= 3}
    lines = [["<s>", "<s>", *(w if w in numbered else "?" for w in ws), "</s>"] for ws in split]
    triples = {t for x in lines for t in zip(x, x[1:], x[2:], strict=False)}
    left, ends, around = Counter((v, w) for _, v, w in triples), Counter(), Counter(v for _, v, _ in triples)
    for _, w in left:
        ends[w] += 1
    vocabulary = {w for w in numbered if ends[w] >= 2} | {"</s>", "?"}
    ends["?"] += sum(ends[w] for w in numbered - vocabulary)
    ends = {w: ends[w] for w in vocabulary}
    total, give = max(1, sum(ends.values())), less_discount(list(ends.values()))
    spare = 1 - sum(map(give, ends.values())) / total
    word = {w: give(c) / total + spare / len(ends) for w, c in ends.items()}
    give2 = less_discount(list(left.values()))
    stored = {(v, w): give2(n) / around[v] for (v, w), n in left.items() if n > 1 and v in vocabulary and w in vocabulary}
    back = Counter()
    for (v, _), x in stored.items():
        back[v] += x
    p = lambda v, w: stored.get((v, w), 0.0) + (1 - back[v]) * word[w]
    grams = Counter()
    spelled = lambda w: [0, 0, 0, *quality.CLASSES[list(w.encode())].tolist(), 0]
    for ws in split:
        for w in ws:
            if w not in numbered:
                c = spelled(w)
                grams.update(zip(c, c[1:], c[2:], c[3:], strict=False))
    spelling, counts = [], grams
    for k in range(4, 0, -1):
        spelling.append(counts)
        counts = Counter(g[1:] for g in counts) if k > 1 else counts

    def letter(context, c):
        out = 1 / 64
        for k in range(1, 5):
            level, ctx = spelling[4 - k], tuple(context[4 - k :])
            rows = {g: n for g, n in level.items() if g[:-1] == ctx}
            if rows:
                cut = less_discount(list(level.values()))
                out = cut(rows.get((*ctx, c), 0)) / sum(rows.values()) + (1 - sum(map(cut, rows.values())) / sum(rows.values())) * out
        return out

    result = []
    for ws in split:
        logp, v = 0.0, "<s>"
        for w in [*ws, None]:
            known = "</s>" if w is None else w if w in vocabulary else "?"
            logp += math.log10(p(v, known))
            if known == "?":
                c = spelled(w)
                logp += sum(math.log10(letter(tuple(c[i - 3 : i]), c[i])) for i in range(3, len(c)))
            v = known
        result.append(10 ** (-logp / (len(ws) + 1)) if ws else None)
    for v in vocabulary | {"<s>"}:
        assert sum(p(v, w) for w in vocabulary) == pytest.approx(1)
    return result


def sentences(rng, n):
    """Texts of a grammar, so that the order of words matters."""
    who, does, what = ("the cat", "a dog", "one bird", "my aunt"), ("sees", "likes", "eats"), ("red fish", "old bread", "the moon", "warm milk")
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    return [" ".join(f"{pick(who)} {pick(does)} {pick(what)} ." for _ in range(int(rng.integers(8, 20)))) for _ in range(n)]


def test_perplexity_and_verdict_against_brute_force(spark):
    """Whole model and bands: two languages, copies, junk, nulls, empty and repeated rows."""
    rng = np.random.default_rng(5)
    plain = sentences(rng, 60)
    junk = [" ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 9)) for _ in range(40)) for _ in range(3)]
    texts = [*plain, *plain[:1] * 5, *junk, *(t.upper() for t in sentences(rng, 12)), None, "", "too few words", " \n"]
    langs = ["en"] * 68 + [None] * 12 + ["en"] * 4
    rows = {r["doc_id"]: r for r in quality.judge(docs_of(spark, texts, langs)).collect()}
    want = brute_perplexity(texts)
    passed = {}
    for i, (t, x) in enumerate(zip(texts, want, strict=True)):
        n, *_, repeat = brute_rules(t)
        failed = n < 20 or 100 * repeat > 30 * n
        assert rows[i]["base_failed"] == failed and (rows[i]["perplexity"] is None) == (x is None)
        if x is not None:
            assert rows[i]["perplexity"] == pytest.approx(x, rel=1e-4)
        if not failed:
            passed.setdefault(langs[i], []).append(math.log(x))
    for i, (t, x) in enumerate(zip(texts, want, strict=True)):
        kept = False
        if not rows[i]["base_failed"]:
            own = sorted(passed[langs[i]])
            q1, q3 = (own[math.ceil(len(own) * q) - 1] for q in (0.25, 0.75))
            reach, give = 3 * max(q3 - q1, 0.01), 4 / math.sqrt(len(TOKEN.findall(t)))
            kept = q1 - reach - give <= math.log(x) <= q3 + reach + give
        assert rows[i]["kept"] == kept, i
    assert not any(rows[i]["kept"] for i in range(65, 68)) and all(rows[i]["kept"] or rows[i]["base_failed"] for i in range(60))


def test_word_order_matters(spark):
    rng = np.random.default_rng(6)
    texts = sentences(rng, 200)
    mixed = [" ".join(rng.permutation(t.split())) for t in texts]
    model = quality.train(docs_of(spark, texts))
    measured = [model.texts(textbytes.Spans(*textbytes.of_texts(x), textbytes.NOT_SPACE)) / np.array([len(t.split()) + 1 for t in x]) for x in (texts, mixed)]
    assert (measured[0] - measured[1]).mean() > 10 * measured[0].std()


def test_copies_do_not_lower_perplexity(spark):
    rng = np.random.default_rng(7)
    texts = sentences(rng, 30)
    odd = "strange words stand here once alone and never come back to any other text at all"
    few, often = (quality.train(docs_of(spark, [*texts, *[odd] * k])) for k in (3, 400))
    spans = textbytes.Spans(*textbytes.of_texts([*texts[:5], odd]), textbytes.NOT_SPACE)
    assert few.texts(spans).tolist() == often.texts(spans).tolist()


def test_counter_blocks_are_bounded_and_exact():
    """Many flushes give the pairs and neighbours that one pass gives."""
    texts = [" ".join(f"w{(i * j * j) % 41}" for j in range(50)) for i in range(60)]
    data, offsets = textbytes.of_texts(texts)
    h = np.unique(textbytes.Spans(data, offsets, textbytes.NOT_SPACE).hashes(textbytes.LOWER))[::2]
    found = []
    for most, bits in ((40, 2), (1 << 20, 0)):
        counter, rows = quality._Counter(h, 3 + np.arange(len(h)), bits, most), []
        for i in range(len(texts)):
            rows += counter.take(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i], None) or ()
        rows += counter.finish()
        blocks = defaultdict(list)
        for b in rows:
            for r in b.to_pylist():
                blocks[r["kind"], r["block"]].append(r)
        total = Counter()
        for group in blocks.values():
            for r in quality._count_group(pa.Table.from_pylist(group, schema=rows[0].schema)).to_pylist():
                total[r["kind"], r["code"]] += r["n"]
        found.append({k: n for k, n in total.items() if n})
    assert found[0] == found[1]


# ---- 10


def test_names_keep_their_parts(spark):
    """One surname has one surrogate under any title, given name and document, one given name one; different ones differ;
    nothing of the real names is left; numbers in any notation agree."""
    rng = np.random.default_rng(8)
    given, last = [f"Gv{chr(97 + i)}n" for i in range(20)] + ["Jean-Luc", "Ana Maria"], [f"Lst{chr(97 + i)}{chr(97 + j)}r" for i in range(6) for j in range(6)] + ["O'Neill", "Smith-Jones"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    facts, texts = [], []
    for _ in range(150):
        g, a, b = pick(given), pick(last), pick(last)
        facts.append((g, a, b))
        texts.append(f"Mr. {g} {a} came; Dr {b} and Mrs. {a} left. {g} {a} waved, {a}'s hat fell. From 2001:db8::{int(rng.integers(1, 9))}a1:7 or 2001:DB8:0:0:1:2:3:4.")
    rows = pii.replace(docs_of(spark, texts), "k", counts=True).orderBy("doc_id").collect()
    people, names, v6 = defaultdict(set), defaultdict(set), defaultdict(set)
    for (g, a, b), r, t in zip(facts, rows, texts, strict=True):
        m = re.fullmatch(r"Mr\. (.+) (\w+) came; Dr (\w+) and Mrs\. (\w+) left\. (.+) (\w+) waved, (\w+)'s hat fell\. From ([0-9a-f:]+) or ([0-9A-F:]+)\.", r["text"])
        assert m, r["text"]
        assert m[2] == m[4] == m[6] == m[7] and m[1] == m[5] and r["n_replaced"] == 7
        people[a].add(m[2])
        people[b].add(m[3])
        names[g].add(m[1])
        assert m[1].split()[0] in pii.GIVEN["m", "latin"]
        v6[re.search(r"2001:db8::\w+:7", t)[0]].add(m[8])
        v6["whole"].add(m[9])
    for found, real in ((people, last), (names, given), (v6, v6)):
        assert all(len(x) == 1 for x in found.values())
        assert len({min(x) for x in found.values()}) == len(found)
        assert not {y for x in found.values() for y in x} & set(real)


def test_surrogates(spark):
    texts = [
        "Write to Ann.Lee7@mail.example.com or ANN.LEE7@MAIL.EXAMPLE.COM.",
        "Call +1 (017) 555-7713, +1 017 555 7713; card 4111 1111 1111 1111 and 4111111111111111, not 12345.",
        "from 10.20.30.40 version 1.2.3 token=9b0b3c6a43eb78aa99cbd7049c572391524f37a8 999.1.1.1",
        "Mr. John Smith met Frau Anna Braun and Mr. John Smith; Господин Иван Петров",
        "nothing here 2024 a@b",
        None,
        "",
        "x" * 100_000 + " 123-45-6789",
        "DE89370400440532013000 and DE89 3704 0044 0532 0130 00",
        "+49 30 1234567, 555.123.4567, 378282246310005 and 3782 822463 10005; 2024-01-02 10:11:12, 1,234,567, 3.14159, 192.168",
    ]
    df = with_clashes(docs_of(spark, texts))
    out = pii.replace(df, "k", counts=True)
    assert out.columns[: len(df.columns)] == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    new = {i: r["text"] for i, r in rows.items()}
    m = re.fullmatch(r"Write to (\S+@\S+\.example\.com) or (\S+)\.", new[0])
    assert m and m[2] == m[1].upper() and "ann.lee" not in new[0].lower()
    m = re.fullmatch(r"Call (\+1 \(\d{3}\) \d{3}-\d{4}), (\+1 \d{3} \d{3} \d{4}); card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}), not 12345\.", new[1])
    digits = [re.sub(r"\D", "", x) for x in m.groups()]
    assert digits[0] == digits[1] and digits[2] == digits[3] and digits[2] != "4111111111111111"
    odd = [int(c) for c in digits[2]]
    assert sum(sum(divmod(2 * c, 10)) if k % 2 == 0 else c for k, c in enumerate(odd)) % 10 == 0  # still a valid number
    m = re.fullmatch(r"from (\d+\.\d+\.\d+\.\d+) version 1\.2\.3 token=([0-9a-f]{40}) 999\.1\.1\.1", new[2])
    assert m and m[1] != "10.20.30.40" and m[2] != "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    m = re.fullmatch(r"Mr\. (\w+ \w+) met Frau (\w+ \w+) and Mr\. (\w+ \w+); Господин ([А-Яа-яё]+ [А-Яа-яё]+)", new[3])
    assert m and m[1] == m[3] and m[1].split()[0] in pii.GIVEN["m", "latin"] and m[2].split()[0] in pii.GIVEN["f", "latin"] and m[4].split()[0] in pii.GIVEN["m", "cyrillic"]
    assert new[4] == texts[4] and new[5] is None and new[6] == "" and "123-45-6789" not in new[7] and len(new[7]) == len(texts[7])
    a, b = re.fullmatch(r"(DE\S+) and (DE.+)", new[8]).groups()
    assert a == b.replace(" ", "") and a != "DE89370400440532013000"
    m = re.fullmatch(r"\+(\d\d \d\d \d{7}), (\d{3}\.\d{3}\.\d{4}), (\d{15}) and (\d{4} \d{6} \d{5}); 2024-01-02 10:11:12, 1,234,567, 3\.14159, 192\.168", new[9])
    assert m and m[1] != "49 30 1234567" and m[2] != "555.123.4567" and m[3] == m[4].replace(" ", "") != "378282246310005"


def test_whole_names_and_later_mentions(spark):
    key = "9a" * 300
    texts = [
        "Mr Jean-Luc Picard and Ms McDonald met Mrs O'Brien. Jean-Luc Picard said: Picard's ship, Picardy.",
        "Señor Juan Carlos Garcia Lopez; Señor Juan Carlos Garcia Diaz; Herr Ludwig von Beethoven; Mr J. R. Smith's car; Mr. Kim left.",
        f"token={key}",
    ]
    rows = {r["doc_id"]: r for r in pii.replace(docs_of(spark, texts), "k", counts=True).collect()}
    new = {i: r["text"] for i, r in rows.items()}
    m = re.fullmatch(r"Mr (\w+ \w+) and Ms (\w+) met Mrs (\w+)\. (\w+ \w+) said: (\w+)'s ship, Picardy\.", new[0])
    assert m and m[1] == m[4] and m[5] == m[1].split()[-1] and rows[0]["n_replaced"] == 5
    m = re.fullmatch(r"Señor (\w+ \w+ \w+); Señor (\w+ \w+ \w+); Herr (\w+(?: \w+)+); Mr (\w+(?: \w+)+)'s car; Mr\. (\w+) left\.", new[1])
    assert m and m[1] != m[2]
    assert not re.search(r"Picard\b|Luc|Donald|Brien|Garcia|Lopez|Diaz|Beethoven|Smith|Kim", new[0] + new[1])
    assert re.fullmatch(r"token=[0-9a-f]{600}", new[2]) and key not in new[2]


def test_surrogates_stay_distinct(spark, monkeypatch):
    ids = [f"{a}.{b}.{c}.7" for a in range(1, 11) for b in range(1, 11) for c in range(1, 11)]
    found = spark.createDataFrame([("ip", x, "") for x in ids], "kind string, form string, style string")
    plain = pii.surrogate

    def crowded(kind, form, style, key, attempt):  # few values at first
        made = plain(kind, form, style, key, attempt)
        return F.when(attempt < 2, F.concat_ws(".", F.split(made, r"\.")[0], F.lit("1.1.7"))).otherwise(made)

    monkeypatch.setattr(pii, "surrogate", crowded)
    made = [r["made"] for r in pii.dictionary(found, "k").collect()]
    assert len(made) == len(set(made)) == len(ids) and not set(made) & set(ids)


def test_surrogates_depend_on_the_key(spark):
    df = docs_of(spark, ["mail bob@corp.example.com"])
    a, b = (pii.replace(df, k).first()["text"] for k in ("k1", "k2"))
    assert a != b and a == pii.replace(df, "k1").first()["text"]


# ---- pipeline


def test_pipeline_equals_brute_force(spark, small, corpus):
    import corpus_pipeline as p

    rows = queries.pipeline(spark, small).collect()
    docs = queries.table(spark, small, "documents")
    pred = {r["doc_id"]: r["langid"] for r in langid.label(docs, langid.fit(docs)).collect()}
    kept = {i: r["text"] for i, r in corpus.items() if pred[i]["lang"] != "und" and not pred[i]["foreign"] and pred[i]["score"] >= 0.3}
    named = brute_classes(kept)
    kept = {i: t for i, t in kept.items() if named[i] == i}
    windows = set()
    for r in queries.table(spark, small, "benchmark").collect():
        w = WORD.findall(low(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def clean(t):
        w = WORD.findall(low(t))
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    kept = {i for i, t in kept.items() if clean(t)}
    assert {r["doc_id"] for r in rows} == kept
    assert [n for n, _ in p.STAGES] == ["language", "deduplicate", "decontaminate", "surrogates", "pack"]


def test_stages_keep_columns(spark, small):
    import corpus_pipeline as p

    docs = queries.table(spark, small, "documents")
    for _, stage in p.STAGES[:-1]:
        out = shared.written(stage(spark, docs, small), "stage")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(0, "same text here now ok")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for texts in (ODD, []):
        df = with_clashes(docs_of(spark, texts, [None if i % 3 == 0 else "en" for i in range(len(texts))]))
        if texts:
            df = df.unionByName(df.where("doc_id = 3")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns, name
            rows = out.collect()
            if name == "deduplicate" and texts:
                assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
            if name == "decontaminate" and texts:
                assert {r["doc_id"] for r in rows} == {0, 1, 2, 3, 4, 5, 6, 7, 8, None}
        p.STAGES[-1][1](spark, df, str(tmp_path)).collect()


def test_a_head_of_many_partners_is_salted(spark):
    """More partners than a group has, and long ones: every link is found, and no row holds the head's text a partner."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words)] + [" ".join([*words, f"x{k}"]) for k in range(150)] + ["other words here " * 9] * 2
    nodes = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 152)] + [(152, 151)], "a long, b long")
    want = {(k, 0) for k in range(1, 151)} | {(152, 151)}
    for members, size in ((64, 8 << 20), (10, 8 << 20), (64, 2000), (1000, 8 << 20)):
        got = neardup._verify(pairs, nodes, 0.8, 5, members, size).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
        assert all(r["similarity"] == pytest.approx(1.0 if r["b"] else 56 / 57) for r in got)


def test_toxicity_shares_count_all_texts(spark):
    """Shares of words and beginnings among all rows, by a dictionary, though the descent sees a few of them."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["vile", "rotten", "calmness", "lake", "hills"], int(rng.integers(0, 9)))) for _ in range(300)] + [None, ""]
    keys = toxicity.candidates(["vile rotten", "vile rotten filth", "rotten vile", "lakes"])
    got = [dict(zip(k.tolist(), s.tolist(), strict=True)) for k, s in toxicity.shares(docs_of(spark, texts).select("text").repartition(3), keys)]
    for level in range(toxicity.LEVELS):
        want = Counter()
        for t in texts:
            spans = textbytes.Spans(*textbytes.of_texts([t or ""]), textbytes.LETTERS)
            times = Counter(int(k) for ks, _ in toxicity.keys_of(spans) for k in ks)
            want.update(k for k in keys.tolist() if times[k] > level)
        assert got[level] == pytest.approx({k: n / len(texts) for k, n in want.items()})
    assert len(keys) >= 2


def test_a_pair_of_just_the_threshold_is_linked(spark):
    """Four shingles of five in common are 0.8 and linked, three of four are not; the smaller id names the class either way round."""
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words[:9]), " ".join(words[:8]), " ".join(words[20:28]), " ".join(words[20:27])]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in neardup.classes(docs_of(spark, texts)).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1), 3: (3, 1)}


def test_a_score_of_just_the_threshold_is_predicted(spark):
    low_, high = (toxicity.Classifier(np.zeros(0, np.uint64), np.zeros((0, toxicity.LEVELS)), b, 0.0) for b in (math.nextafter(0.0, -1.0), 0.0))
    docs, labels = docs_of(spark, ["a", "", None]), spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity.score(docs, labels, high, threshold=0.5).collect()} == {(0.5, 1)}
    lower = toxicity.Classifier(low_.keys, low_.weights, -1e-6, 0.0)
    assert {r["predicted"] for r in toxicity.score(docs, labels, lower, threshold=0.5).collect()} == {0}
