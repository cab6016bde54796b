import io
import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import __main__ as cli
from marlstone import config, session
from marlstone.api import Engine, contained, is_under
from marlstone.functions import text as X
from marlstone.operators import bm25, fuse, vector
from marlstone.operators.embed import HashEmbedder, ModelEmbedder, by_name
from marlstone.plans.indexing import Indexer
from marlstone.server import TOOLS, Server
from marlstone.sources import extract, scan, writers


def test_batch_top_against_brute_force(spark):
    """Ties, string ids, rows without a vector, more batches than one."""
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03d}", [float(x) for x in rng.integers(-2, 3, 3)] if i % 7 else None) for i in range(300)]
    store = spark.createDataFrame(rows, "vec_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, [1.0, float(i), -1.0]) for i in range(4)] + [(9, None)], "query_id int, embedding array<float>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = vector.batch_top(store, asked, 5, id_col="vec_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["query_id"] for r in got} == {0, 1, 2, 3}

    def distance(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(1 - float(np.dot(a, b)) / size if size else 1.0, 9)

    for i in range(4):
        want = sorted((distance(np.array([1.0, i, -1.0]), np.array(v)), k) for k, v in rows if v is not None)[:5]
        assert [(round(r["distance"], 9), r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want
    assert vector.top(store, [1.0, 0.0, 0.0], 400, id_col="vec_id").count() == sum(v is not None for _, v in rows)


def test_bm25_fills_any_number_of_hits(spark):
    docs = spark.createDataFrame([(i, "apple" if i < 3 else "pear") for i in range(400)], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "apple")], "query_id int, text string")
    found = bm25.search(bm25.build(docs), asked, 300).orderBy("rank").collect()
    assert [r["chunk_id"] for r in found] == list(range(300))
    both = bm25.add(bm25.build(docs.where("chunk_id < 10")), docs.where("chunk_id between 10 and 19"))
    assert bm25.search(both, asked, 50).count() == 20


def test_saved_index_keeps_the_type_of_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "a b"), (10, "b")], "chunk_id long, text string")
    bm25.save(bm25.build(docs), str(tmp_path / "i"), "f")
    loaded = bm25.load(spark, str(tmp_path / "i"), "f")
    grown = bm25.add(loaded, spark.createDataFrame([(9, "a")], "chunk_id long, text string"))
    assert grown.least(3) == [2, 9, 10]
    assert bm25.search(grown, spark.createDataFrame([(1, "a")], "query_id int, text string")).count() == 3


def test_set_hash_ignores_order(spark):
    def of(ids):
        return spark.createDataFrame([(i,) for i in ids], "i string").agg(X.set_hash(F.col("i"))).first()[0]

    assert of(["a", "b", "c"]) == of(["c", "a", "b"]) != of(["a", "b"])
    assert of([]) == "0-0-0"


def test_rerank_is_all_or_nothing(spark):
    hits = spark.createDataFrame([(str(i), "x" * i, i) for i in range(1, 6)], "chunk_id string, text string, rank int").repartition(3)

    def fails_on_long(q, texts):
        if any(len(t) > 4 for t in texts):
            raise ValueError("too long")
        return [len(t) for t in texts]

    rows = fuse.rerank(hits, "q", 5, fails_on_long).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and {r["rerank_error"] for r in rows} == {"ValueError: too long"}

    class Model:
        def predict(self, pairs, batch_size):
            return [len(t) for _, t in pairs]

    rows = fuse.rerank(hits, "q", 2, fuse.CrossEncoder("m", load=lambda name: Model())).collect()
    assert [r["chunk_id"] for r in rows] == ["5", "4"] and rows[0]["rerank_error"] is None
    assert {r["rerank_error"] for r in fuse.rerank(hits, "q", 2, lambda q, t: [1.0]).collect()} == {"1 scores for 5 texts"}


def test_model_embedder():
    class Model:
        calls = []

        def encode(self, texts, batch_size):
            self.calls.append(len(texts))
            if "big" in texts and len(texts) > 1:
                raise RuntimeError("Invalid buffer size: 9 GB")
            if "bad" in texts:
                raise RuntimeError("no such device")
            return [[float(len(t)), 1.0] for t in texts]

    e = ModelEmbedder("m", 3, load=lambda name: Model())
    assert not e.loaded and e.dim == 768
    assert e.embed(["a", "", None, "big", "ccc", "dd"]).tolist() == [[1, 1], [0, 0], [0, 0], [3, 1], [3, 1], [2, 1]]
    assert Model.calls == [3, 1, 1, 1, 1] and e.loaded and e.info()["dimension"] == 2
    with pytest.raises(RuntimeError, match="no such device"):
        e.embed(["bad"])
    with pytest.raises(ValueError):
        e.embed_text("")
    e.unload()
    assert not e.loaded
    assert isinstance(by_name("hash-32"), HashEmbedder) and by_name("BAAI/bge-m3").dim == 1024


def test_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert is_under(str(tmp_path / "in" / "x"), str(tmp_path / "in")) and not is_under(str(tmp_path / "in2"), str(tmp_path / "in"))
    (tmp_path / "in" / "link").symlink_to("/etc")
    assert not is_under(str(tmp_path / "in" / "link" / "passwd"), str(tmp_path / "in"))
    rows = spark.createDataFrame([("/r/a",), ("/r/../etc",), ("/r2/a",), ("/r",), ("//r/./a/../..//r/b",), ("/../../r/x",)], "p string").select(contained(F.col("p"), "/r/").alias("x")).collect()
    assert [r["x"] for r in rows] == [True, False, False, True, True, True]
    split = unicodedata.normalize("NFD", "é한.txt")
    (tmp_path / "in" / "link").unlink()
    (tmp_path / "in" / split).write_text("text")
    (path,) = (r["file_path"] for r in scan.scan(spark, str(tmp_path / "in")).collect())
    assert path.endswith("/é한.txt")


def test_tokenizer_falls_back_to_white_space(spark):
    def split(t):
        if "bad" in t:
            raise ValueError
        return [w for w in t.split("-") if w != "-"] if "-" in t else []

    rows = spark.createDataFrame([("a-b",), ("bad one",), ("x y",), (None,)], "t string").select(X.tokenizer(split)(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in rows] == [["a", "b"], ["bad", "one"], ["x", "y"], None]


def test_images():
    class Engine_:
        name = "eye"

        def pages(self, raw, dpi, most):
            yield from ["one ", "", "two", "three"][:most]

    r = extract.extract_one(b"%PDF", "pdf", extract.readers(Engine_(), most=3))
    assert r["success"] and r["text"] == "one\n--- Page Break ---\ntwo" and r["metadata"]["method"] == "ocr_eye" and r["metadata"]["pages_extracted"] == "2"
    r = extract.extract_one(b"%PDF", "pdf", extract.readers(Engine_(), most=0))
    assert not r["success"] and "eye read no text" in r["error"]


@pytest.mark.parametrize("n", [0, 1, 600, 70_000])
def test_compound_files(n):
    streams = {"FileHeader": b"h" * n, "BodyText/Section0": b"a" * (n + 1), "BodyText/Section1": b"b"}
    cf = extract.CompoundFile(writers.compound(streams))
    assert {k: cf.read(k) for k in cf.entries} == streams


def test_work_folder(spark):
    assert session.work_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_server(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "one.txt").write_text("Yellow bananas. " * 80)
    (root / "two.md").write_text("# Pears\n\nGreen pears grow here.")
    server = Server(Engine(Indexer(spark, str(root), str(tmp_path / "home"), HashEmbedder(), buckets=4)))
    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        *({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": n, "arguments": a}} for i, n, a in [
            (3, "reindex", {}), (4, "search_documents", {"query": "pears", "n_results": 1}), (5, "get_document", {"file_path": str(root / "one.txt"), "chunk_limit": 1}),
            (6, "get_document", {"file_path": "/etc/passwd"}), (7, "list_documents", {"file_type": "md"}), (8, "get_stats", {}), (9, "search_documents", {}), (10, "drop", {}),
            (11, "get_document", {"file_path": str(root / "none.txt")}), (12, "list_documents", {"limit": "many"})]),
        {"jsonrpc": "2.0", "id": 13, "method": "nothing"},
    ]
    out = io.StringIO()
    server.run(io.StringIO("\n".join(map(json.dumps, asked)) + "\n\nnot json\n"), out)
    replies = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, *range(2, 14), None]
    by_id = {r["id"]: r for r in replies}
    assert by_id[1]["result"]["capabilities"] == {"tools": {}}
    assert [t["name"] for t in by_id[2]["result"]["tools"]] == [t["name"] for t in TOOLS]
    told = {i: json.loads(by_id[i]["result"]["content"][0]["text"]) for i in range(3, 13)}
    assert told[3]["detected"] == {"new_files": 2, "changed_files": 0, "deleted_files": 0} and told[3]["results"]["success"] == 2
    assert told[4]["n_results"] == 1 and told[4]["results"][0]["metadata"]["file_name"] == "two.md"
    assert told[5]["has_more"] and told[5]["next_offset"] == 1 and told[5]["returned_chunks"] == 1 and told[5]["file_name"] == "one.txt"
    assert told[7]["total_matched"] == 1 and told[7]["documents"][0]["file_name"] == "two.md"
    assert told[8]["indexing"] == {"total": 2, "indexed": 2, "failed": 0, "pending": 0}
    assert [by_id[i]["result"]["isError"] for i in range(3, 13)] == [False, False, False, True, False, False, True, True, True, True]
    assert "error" in told[12] and "many" not in told[12]["error"]
    assert by_id[13]["error"]["code"] == -32601 and replies[-1]["error"]["code"] == -32700


def test_settings_reach_the_engine(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("MARLSTONE_ROOT", str(tmp_path))
    c = config.merged(config.load(), {"embedding": {"model": "hash-16", "batch_size": 5}, "search": {"vector_top_n": 7, "bm25_top_n": 8, "rrf_k": 9, "rerank_top_n": 3, "filter_mode": "both"}, "reranker": {"enable": True, "model": "m", "batch_size": 4}, "ocr": {"enabled": True, "max_pages_per_pdf": 2}})
    e = cli.engine_of(c, str(tmp_path / "home"), spark)
    assert e.indexer.embedder.dim == 16 and e.indexer.batch_size == 5 and e.filter_mode == "both"
    assert e.options == {"vector_n": 7, "bm25_n": 8, "rrf_k": 9, "rerank_n": 3}
    assert (e.scorer.model, e.scorer.batch_size) == ("m", 4) and e.indexer.readers["pdf"] is not extract.pdf
    assert e.model_info()["dimension"] == 16


def test_store_state_names_the_store_as_it_is(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.txt").write_text("apples")
    indexer = Indexer(spark, str(root), str(tmp_path / "home"), HashEmbedder(), buckets=4)
    empty = indexer.store.state()
    indexer.incremental()
    first = indexer.store.state()
    indexer.incremental()
    assert first not in (empty,) and indexer.store.state() == first
    (root / "a.txt").write_text("pears and plums")
    indexer.incremental()
    assert indexer.store.state() != first


def test_a_document_is_read_under_any_limit(spark, tmp_path):
    """A limit of a terabyte takes no terabyte."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("some words here")
    engine = Engine(Indexer(spark, str(tmp_path / "t"), str(tmp_path / "home"), HashEmbedder(), max_mb=1 << 20), mode="vector_only")
    assert "some words here" in engine.get_document(str(tmp_path / "t" / "a.txt")).first()["content"]
