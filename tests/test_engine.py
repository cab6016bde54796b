import os
import time

import pytest
from pyspark.sql import functions as F

from marlstone import config
from marlstone.api import Engine, as_json
from marlstone.functions import text as X
from marlstone.operators import bm25, fuse, metadata, tables, vector
from marlstone.operators.embed import HashEmbedder
from marlstone.operators.snapshot import Snapshot
from marlstone.plans.indexing import Indexer
from marlstone.plans.retriever import Retriever
from marlstone.schema import TRACKER


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("name", "ext"), [("report.pdf", "pdf"), ("README", ""), (".gitignore", "gitignore"), ("archive.tar.gz", "gz"), ("a/b/REPORT.PDF", "pdf"), ("x.", "")])
def test_extension(spark, name, ext):
    assert one(spark, X.file_extension(F.lit(name))) == ext


def test_tokens_split_at_unicode_space(spark):
    assert one(spark, X.tokens(F.lit("a　b\x1cc d."))) == ["a", "b", "c", "d."]


def test_content_hash_prints_floats_as_python(spark):
    import hashlib

    assert one(spark, X.content_hash(F.lit("p"), F.lit(1711929598.25))) == hashlib.sha256(b"p:1711929598.25").hexdigest()


def test_metadata(spark):
    page = "제목 : 연구 보고서\n담당자：홍길동 \n작성일: 2024년 3월 5일\n본문 2020-01-01"
    assert one(spark, metadata.title_of(F.lit(page))) == "연구 보고서"
    assert one(spark, metadata.author_of(F.lit(page))) == "홍길동"
    assert one(spark, metadata.date_of(F.lit(page))) == "2024-03-05"
    assert one(spark, metadata.doc_type_of(F.lit(page))) == "보고서"
    assert one(spark, metadata.date_of(F.lit("2024-13-40 and 2024-01-02"))) == ""
    assert one(spark, metadata.date_of(F.lit("작성일: soon\n2021.2.3"))) == "2021-02-03"
    assert one(spark, metadata.title_of(F.lit("대외비 문서\nabc\n  A fine title \n"))) == "A fine title"
    assert one(spark, metadata.title_of(F.lit("x" * 101))) == ""


def test_prefix(spark):
    def made(*a):
        return one(spark, metadata.context_prefix(*[F.lit(x) for x in a]))

    assert made("T" * 60, "A", "2024-05-06", "2020-01-01", "f.txt", "d/f.txt") == f"[2024-05 | {'T' * 50} | A | f.txt] "
    assert made("", "", "", "", "f.txt", "a/b/f.txt") == "[a/b | f.txt] "
    assert made("", "", "", "", "f.txt", "f.txt") == "[f.txt] "
    assert made("", "", "", "", "", "") == ""
    assert made("", "", "D:2024050", "", "f", "") == "[D:20240 | f] "


def test_bm25_forms(spark):
    docs = spark.createDataFrame([("a", "x x y"), ("b", "y z"), ("c", "w"), ("d", "")], "chunk_id string, text string")
    index = bm25.build(docs)
    asked = spark.createDataFrame([(1, "x x q"), (2, "nothing")], "query_id int, text string")
    library = bm25.search(index, asked).orderBy("rank").collect()
    assert [r["chunk_id"] for r in library] == ["a", "b", "c", "d"]
    import math

    idf, tf, dl, avg = math.log(5 / 1), 2, 3, 6 / 4
    gain = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert library[0]["score"] == pytest.approx(2 * idf * (1 + gain), abs=1e-8)
    assert library[1]["score"] == pytest.approx(2 * idf, abs=1e-8)
    paper = bm25.search(index, asked, delta_mode="paper").collect()
    assert [(r["chunk_id"], r["query_id"]) for r in paper] == [("a", 1)]
    more = bm25.add(index, spark.createDataFrame([("e", "x")], "chunk_id string, text string"))
    whole = bm25.build(docs.union(spark.createDataFrame([("e", "x")], "chunk_id string, text string")))
    assert [r["score"] for r in bm25.search(more, asked).orderBy("rank").collect()] == [r["score"] for r in bm25.search(whole, asked).orderBy("rank").collect()]


def test_bm25_saved(spark, tmp_path):
    index = bm25.build(spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, text string"))
    bm25.save(index, str(tmp_path / "i"), "f1")
    assert bm25.load(spark, str(tmp_path / "i"), "f2") is None and bm25.load(spark, str(tmp_path / "none"), "f1") is None
    assert bm25.load(spark, str(tmp_path / "i"), "f1").n == 2


def test_vectors(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0], "pdf"), ("b", [-1.0, 0.0], "txt"), ("c", [0.0, 0.0], "txt"), ("d", [1.0, 0.0], "txt")], "chunk_id string, embedding array<float>, file_type string")
    top = vector.top(store, [2.0, 0.0], 3).collect()
    assert [(r["chunk_id"], r["score"]) for r in top] == [("a", 1.0), ("d", 1.0), ("c", 0.0)]
    assert [r["chunk_id"] for r in vector.top(store, [1.0, 0.0], 9, vector.predicate({"file_type": "txt"})).collect()] == ["d", "c", "b"]
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id int, embedding array<float>")
    got = vector.batch_top(store, asked, 2, block=2).collect()
    for i in range(5):
        want = [r["chunk_id"] for r in vector.top(store, [1.0, float(i)], 2).collect()]
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want
    with pytest.raises(ValueError):
        vector.predicate({"colour": "red"})


def test_rrf(spark):
    left = spark.createDataFrame([("a", 0.9, 1), ("b", 0.8, 2)], "chunk_id string, score double, rank int")
    right = spark.createDataFrame([("c", 7.0, 1), ("b", 6.0, 2)], "chunk_id string, score double, rank int")
    rows = fuse.rrf(left, right, by=None).collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("b", 0.8), ("a", 0.9), ("c", 7.0)]
    assert rows[0]["rrf_score"] == pytest.approx(2 / 62)


def test_rerank_failure_keeps_order(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("b", "yy", 2)], "chunk_id string, text string, rank int")
    assert [r["chunk_id"] for r in fuse.rerank(hits, "q", 2, lambda q, t: [len(x) for x in t]).collect()] == ["b", "a"]

    def broken(q, t):
        raise RuntimeError

    assert [r["chunk_id"] for r in fuse.rerank(hits, "q", 2, broken).collect()] == ["a", "b"]


def test_tracker(spark):
    rows = [("a", 1.0, "h", "t", True, None, None), ("b", 1.0, "h", "t", False, "bad", None), ("c", 1.0, "h", "t", False, None, None)]
    tracked = spark.createDataFrame(rows, TRACKER)
    assert tuple(tables.tracker_stats(tracked).first()) == (3, 1, 1, 1)
    errors = spark.createDataFrame([("a", "oops"), ("n", "new")], "file_path string, error_msg string")
    after = {r["file_path"]: r for r in tables.record_errors(tracked, errors).collect()}
    assert after["a"]["is_indexed"] and after["a"]["error_msg"] == "oops" and after["a"]["file_mtime"] == 1.0
    assert not after["n"]["is_indexed"] and after["n"]["file_mtime"] == 0.0 and after["n"]["content_hash"] == ""


def test_snapshot(spark, tmp_path):
    def row(name, mtime):
        return spark.createDataFrame([(name, mtime, "h", "t", True, None, None)], TRACKER)

    s = Snapshot(spark, str(tmp_path / "t"), TRACKER, buckets=64)
    assert s.read().count() == 0
    s.write(row("a", 1.0).union(row("b", 1.0)))
    before = s.current()
    s.change(row("a", 2.0), lambda old: tables.upsert(old, row("a", 2.0), "file_path"))
    after = s.current()
    assert {(r["file_path"], r["file_mtime"]) for r in s.read().collect()} == {("a", 2.0), ("b", 1.0)}
    assert len(after) == 2 and len(set(before.items()) & set(after.items())) == 1  # b's bucket was not written again
    s.change(row("b", 0.0), lambda old: old.where("file_path <> 'b'"))
    assert [r["file_path"] for r in s.read().collect()] == ["a"] and len(s.current()) == 1


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "one.txt").write_text("제목: First paper\n작성자: Ann\nApples and pears grow here. " * 3, encoding="utf-8")
    (root / "sub" / "two.html").write_text("<title>Second</title><p>Bananas are yellow fruit</p>")
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / ".git" / "x.txt").write_text("hidden")
    (root / "note.exe").write_text("no")
    return root


def test_incremental_index_and_tools(spark, tree, tmp_path):
    indexer = Indexer(spark, str(tree), str(tmp_path / "home"), HashEmbedder())
    engine = Engine(indexer)
    first = indexer.incremental("t1").first()
    assert (first["success"], first["failed"]) == (2, 1)
    again = indexer.incremental("t2").first()
    assert (again["success"], again["failed"]) == (0, 1)  # failures are tried again
    hits = engine.search_documents("yellow Bananas", 5).collect()
    assert "Bananas" in hits[0]["text"]
    assert engine.search_documents("   ").count() == 0
    listed = engine.list_documents(limit=500).collect()
    assert [r["file_name"] for r in listed] == ["one.txt", "two.html"] and listed[0]["doc_author"].startswith("Ann")
    assert engine.list_documents(file_type=".HTML").count() == 1
    page = engine.get_document(str(tree / "one.txt"), 0, 1).first()
    assert page["total_chunks"] == 1 and page["content"].startswith("제목") and not page["has_more"]
    with pytest.raises(PermissionError):
        engine.get_document("/etc/passwd")
    time.sleep(0.01)
    (tree / "sub" / "two.html").write_text("<p>Cherries now</p>")
    os.utime(tree / "sub" / "two.html", (1, 1))
    (tree / "one.txt").unlink()
    indexer.incremental("t3")
    texts = [r["text"] for r in indexer.store.read().collect()]
    assert len(texts) == 1 and "Cherries" in texts[0]
    stats = engine.get_stats().first()
    assert (stats["total"], stats["indexed"], stats["failed"], stats["documents"]) == (2, 1, 1, 1)
    assert "Cherries" in as_json(engine.search_documents("Cherries"))
    assert indexer.full("t4").first()["skipped"] == 1


def test_filters_apply_to_vectors_only_unless_both(spark):
    e = HashEmbedder()
    rows = [(f"c{i}", t, [float(x) for x in e.embed([t])[0]], k, "", "") for i, (t, k) in enumerate([("red apple", "pdf"), ("red pear", "txt"), ("green plum", "txt")])]
    store = spark.createDataFrame(rows, "chunk_id string, text string, embedding array<float>, file_type string, doc_author string, doc_type string")
    index = bm25.build(store)
    loose = Retriever(store, index, e, delta_mode="paper").search("apple", 10, {"file_type": "txt"}).collect()
    strict = Retriever(store, index, e, delta_mode="paper", filter_mode="both").search("apple", 10, {"file_type": "txt"}).collect()
    assert "c0" in {r["chunk_id"] for r in loose} and "c0" not in {r["chunk_id"] for r in strict}


def test_streams(spark, tree, tmp_path):
    from marlstone.streaming import incremental as S

    indexer = Indexer(spark, str(tree), str(tmp_path / "home"), HashEmbedder())
    S.index_stream(indexer, str(tmp_path / "cp"), "*.html").awaitTermination(120)
    assert indexer.store.read().count() == 1
    source = tmp_path / "changes"
    spark.createDataFrame([("a", 1.0, "h1", "t1", True, None, None), ("a", 2.0, "h2", "t2", True, None, None)], TRACKER).write.parquet(str(source))
    target = Snapshot(spark, str(tmp_path / "t"), TRACKER)
    S.upsert_stream(spark.readStream.schema(TRACKER).parquet(str(source)), target, "file_path", ["last_indexed"], str(tmp_path / "cp2")).awaitTermination(120)
    assert [r["content_hash"] for r in target.read().collect()] == ["h2"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("MARLSTONE_ROOT", "/data/x")
    assert config.load()["document_processing"]["doc_root"] == "/data/x"
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
