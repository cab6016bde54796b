"""Hybrid search: filtered vectors and keywords, fused, hydrated, reranked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import preview
from marlstone.operators import bm25, fuse, vector
from marlstone.operators.ann import VectorIndex
from marlstone.operators.embed import Embedder
from marlstone.operators.keywords import KeywordIndex


@dataclass
class Retriever:
    """store has chunk_id, text, embedding and the filters' columns. Three choices are explicit: mode, scorer, filter_mode.

    filter_mode `vector_only` leaves keyword hits unfiltered, as the tools it stands in for do; `both` filters them too.
    """

    store: DataFrame
    index: bm25.Index | KeywordIndex | None = None
    embedder: Embedder | None = None
    scorer: Callable | None = None
    mode: str = "hybrid"
    filter_mode: str = "vector_only"
    vector_n: int = 50
    bm25_n: int = 50
    rerank_n: int = 20
    rrf_k: int = fuse.RRF_K
    delta_mode: str = "library"
    vectors: VectorIndex | None = None  # instead of a scan of the store: approximate

    def search(self, query: str, n: int = 10, filters: dict[str, str | None] | None = None, query_vector=None, min_score: float = 0.0) -> DataFrame:
        """chunk_id, text, score, rrf_score, rerank_score, rank; at most rerank_n rows in hybrid mode. A blank query finds nothing."""
        n = max(1, min(n, 100))
        spark, where = self.store.sparkSession, vector.predicate(filters)
        if not query.strip():
            return self._shaped(self.store.where(F.lit(False)).select("chunk_id", F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("rrf_score"), F.lit(0).alias("rank")), n, query)
        if query_vector is None:
            if self.embedder is None:
                raise ValueError("either an embedder or a query vector is needed")
            query_vector = self.embedder.embed([query])[0]
        wanted = self.vector_n if self.mode == "hybrid" else n
        near = vector.top(self.store, query_vector, wanted, where) if self.vectors is None else self.vectors.top(query_vector, wanted, where)
        if min_score > 0:
            near = near.where(F.col("score") >= min_score)
        near = ranked(near.select("chunk_id", "score", "distance"), "distance").drop("distance")
        if self.mode == "vector_only" or self.index is None:
            return self._shaped(near.withColumn("rrf_score", F.lit(None).cast("double")), n, query)
        words = self.index.search(spark.createDataFrame([(0, query)], "query_id int, text string"), self.bm25_n, self.delta_mode).select("chunk_id", "score", "rank")
        if self.filter_mode == "both" and filters:
            kept = words.join(self.store.where(where).select("chunk_id"), "chunk_id", "left_semi")
            words = ranked(kept, F.desc("score"))
        hits = fuse.rrf(near, words, self.rerank_n, self.rrf_k, None)
        hits = ranked(hits, F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
        return self._shaped(hits.select("chunk_id", "score", "rrf_score", "rank"), n, query)

    def _shaped(self, hits: DataFrame, n: int, query: str) -> DataFrame:
        full = fuse.hydrate(hits, self.store)
        return fuse.rerank(full, query, n, self.scorer).select("chunk_id", "text", preview(F.col("text")).alias("preview"), "score", "rrf_score", "rerank_score", "rerank_error", "rank")


def ranked(top: DataFrame, *order: Column | str) -> DataFrame:
    """A list of a few hits with its ranks; its size is a limit's, not the data's."""
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order, "chunk_id")))
