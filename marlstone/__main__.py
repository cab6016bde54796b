"""Command line: server, full_index, incremental_index, search, list, stats."""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import SparkSession

from marlstone import config
from marlstone.api import Engine, as_json
from marlstone.functions.text import morphemes
from marlstone.operators.embed import by_name
from marlstone.operators.fuse import CrossEncoder
from marlstone.plans.indexing import Indexer
from marlstone.server import Server
from marlstone.session import session
from marlstone.sources import extract


def engine_of(c: dict, home: str, spark: SparkSession) -> Engine:
    """The engine that settings describe."""
    d, e, s, r, o = c["document_processing"], c["embedding"], c["search"], c["reranker"], c["ocr"]
    readers = extract.readers(extract.TesseractOcr("+".join(o["languages"]), o["timeout_per_page"]), None, o["dpi"], o["max_pages_per_pdf"]) if o["enabled"] else None
    indexer = Indexer(spark, d["doc_root"], home, by_name(e["model"], e["batch_size"]), d["chunk_size"], d["chunk_overlap"], c["contextual"]["enable"], d["max_file_size_mb"], tuple(c["excluded_patterns"]), batch_size=e["batch_size"], readers=readers)
    scorer = CrossEncoder(r["model"], r["batch_size"]) if r["enable"] else None
    options = {"vector_n": s["vector_top_n"], "bm25_n": s["bm25_top_n"], "rrf_k": s["rrf_k"], "rerank_n": s["rerank_top_n"]}
    return Engine(indexer, s["mode"], s["filter_mode"], scorer, morphemes(), options)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="marlstone", description=__doc__)
    p.add_argument("mode", nargs="?", default="server", choices=["server", "full_index", "incremental_index", "search", "list", "stats"])
    p.add_argument("--config")
    p.add_argument("--home", default=".marlstone", help="folder of the index")
    p.add_argument("--query", default="")
    p.add_argument("--n-results", type=int, default=10)
    a = p.parse_args(argv)
    c = config.load(a.config)
    engine = engine_of(c, a.home, session())
    now = datetime.datetime.now().isoformat()
    if a.mode == "server":
        Server(engine).run(sys.stdin, sys.stdout)
        return
    if a.mode == "full_index":
        out = engine.indexer.full(now, tuple(c["excluded_patterns"]))
    elif a.mode == "incremental_index":
        out = engine.reindex(now)
    elif a.mode == "search":
        out = engine.search_documents(a.query, a.n_results)
    elif a.mode == "list":
        out = engine.list_documents(limit=a.n_results)
    else:
        out = engine.get_stats()
    print(as_json(out))


if __name__ == "__main__":
    main()
