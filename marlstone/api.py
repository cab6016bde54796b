"""The tools: search_documents, get_document, list_documents, reindex, get_stats. DataFrames, with a JSON view of each."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import nfc, tokens
from marlstone.operators import chunk, tables, vector
from marlstone.operators.ann import VectorIndex
from marlstone.operators.keywords import KeywordIndex
from marlstone.operators.snapshot import Version, fingerprint
from marlstone.plans.indexing import Indexer
from marlstone.plans.retriever import Retriever
from marlstone.sources import extract, scan


@dataclass
class Engine:
    indexer: Indexer
    mode: str = "hybrid"
    filter_mode: str = "vector_only"
    scorer: object = None
    split: Callable = tokens
    options: dict = field(default_factory=dict)  # of Retriever: vector_n, bm25_n, rrf_k, rerank_n, delta_mode
    approximate: bool = False  # search vectors by an index in lists, not by a scan of all

    def __post_init__(self):
        self.keywords = KeywordIndex(self.indexer.spark, f"{self.indexer.home}/keywords", self.split)
        self.vectors = VectorIndex(self.indexer.spark, f"{self.indexer.home}/vectors", keep=tuple(vector.FILTERS.values()))
        if self.mode == "hybrid" or self.approximate:
            self.indexer.on_change = self._follow

    def _follow(self, before: Version, after: Version, added: DataFrame, removed: DataFrame) -> None:
        """The indexes take a run's chunks, if they are of the state that the run began with; one that is not is built anew when it
        is next asked for."""
        if self.mode == "hybrid" and (self.keywords.fingerprint() == fingerprint(before.folders) or not before.folders):
            self.keywords.append(added, removed, fingerprint(after.folders))
        if self.approximate and self.vectors.fingerprint() == fingerprint(before.folders):
            self.vectors.append(added, removed, fingerprint(after.folders))

    def _vectors(self) -> VectorIndex | None:
        """The vector index of the store as it is; built anew, too, once the rows are four times what its lists were fitted for."""
        state = self.indexer.store.latest()
        if not self.approximate or not state.folders:
            return None
        if self.vectors.fingerprint() != fingerprint(state.folders) or self.vectors.n > 4 * self.vectors.manifest()["trained"]:
            self.vectors.build(self.indexer.store.read(at=state), fingerprint(state.folders))
        return self.vectors

    def _index(self) -> KeywordIndex | None:
        """The keyword index of the store as it is, which no scan has to tell: the runs have kept it, or it is built."""
        state = self.indexer.store.latest()
        if not state.folders:
            return None
        if self.keywords.fingerprint() != fingerprint(state.folders):
            self.keywords.build(self.indexer.store.read(at=state).select("chunk_id", "text"), fingerprint(state.folders))
        return self.keywords

    def search_documents(self, query: str, n_results: int = 10, file_type: str | None = None, author: str | None = None, doc_type: str | None = None) -> DataFrame:
        index = self._index() if self.mode == "hybrid" else None
        r = Retriever(self.indexer.store.read(), index, self.indexer.embedder, self.scorer, self.mode, self.filter_mode, vectors=self._vectors(), **self.options)
        return r.search(query, n_results, {"file_type": file_type, "author": author, "doc_type": doc_type})

    def get_document(self, file_path: str, chunk_offset: int = 0, chunk_limit: int = 50) -> DataFrame:
        """A page of a file as it is now on disk; a path outside the root is refused."""
        file_path = os.path.expanduser(file_path)
        if not is_under(file_path, self.indexer.root):
            raise PermissionError(f"{file_path} is not under {self.indexer.root}")
        files = scan.files(self.indexer.spark, file_path, None)
        read = extract.extract_files(files, self.indexer.readers, self.indexer.max_mb).where("extraction.success")
        chunks = chunk.exploded(read, F.lit(file_path), F.col("extraction.text"), self.indexer.chunk_size, self.indexer.overlap)
        return tables.document_page(chunks, file_path, chunk_offset, chunk_limit)

    def list_documents(self, file_type: str | None = None, author: str | None = None, doc_type: str | None = None, limit: int = 20) -> DataFrame:
        where = vector.predicate({"file_type": file_type, "author": author, "doc_type": doc_type}, listing=True)
        columns = ["file_path", "file_name", "file_type", "doc_title", "doc_author", "doc_type", "doc_created", "fs_modified", "total_chunks", "chunk_index"]
        return tables.list_documents(self.indexer.store.read().select(*columns), where, limit)

    def reindex(self, now: str = "") -> DataFrame:
        summary = self.indexer.incremental(now)
        if self.mode == "hybrid":
            self._index()
        return summary

    def get_stats(self) -> DataFrame:
        store = tables.store_stats(self.indexer.store.read())
        return tables.tracker_stats(self.indexer.tracker.read()).withColumns({c: store.select(c).scalar() for c in store.columns})

    def model_info(self) -> dict:
        """The embedder's name, dimension and device."""
        e = self.indexer.embedder
        return e.info() if hasattr(e, "info") else {"model": e.name, "dimension": e.dim, "device": "cpu"}


def is_under(path: str, root: str) -> bool:
    """Whether a path, its links and dots resolved, is the root or below it."""
    root = os.path.realpath(os.path.expanduser(root))
    return os.path.commonpath([root, os.path.realpath(path)]) == root


def contained(path: Column, root: str) -> Column:
    """is_under for a column of absolute paths, by their segments alone: no file system is asked, so links aren't followed."""
    step = lambda at, s: F.when(s.isin("", "."), at).when(s == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s)))
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(nfc(path), "/"), F.array().cast("array<string>"), step), "/"))
    base = os.path.normpath(root)
    return (whole == base) | whole.startswith(base.rstrip("/") + "/")


def as_json(df: DataFrame) -> str:
    """A tool's answer as JSON text; its rows are few."""
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()], ensure_ascii=False)
