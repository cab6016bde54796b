"""Reciprocal rank fusion, hydration of texts, and the rerank step."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RRF_K = 60


def rrf(vector: DataFrame, keyword: DataFrame, n: int = 20, k: int = RRF_K, by: str | None = "query_id") -> DataFrame:
    """Fuses two ranked lists (chunk_id, score, rank; rank from 1) of each query: the n best by the sum of 1/(k + rank).

    The score is the vector side's where there is one. Ties go by vector rank, then keyword rank, as a stable sort of the
    one list after the other would leave them.
    """
    keys = [by, "chunk_id"] if by else ["chunk_id"]
    sides = vector.select(*keys, "score", F.col("rank").alias("v"), F.lit(None).cast("int").alias("b")).unionByName(keyword.select(*keys, "score", F.lit(None).cast("int").alias("v"), F.col("rank").alias("b")))
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.max(c)), F.lit(0.0))
    fused = sides.groupBy(*keys).agg((part("v") + part("b")).alias("rrf_score"), F.max("v").alias("vector_rank"), F.max("b").alias("bm25_rank"), F.coalesce(F.max(F.when(F.col("v").isNotNull(), F.col("score"))), F.max("score")).alias("score"))
    order = [F.desc("rrf_score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id"]
    if by is None:
        return fused.orderBy(*order).limit(n)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def hydrate(hits: DataFrame, store: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """hits with the store's columns; those without a text go."""
    return hits.join(store.select("chunk_id", *columns), "chunk_id").where(F.col("text").isNotNull())


def rerank(hits: DataFrame, query: str, n: int, scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """The n best by scorer(query, texts), or, with none, by the order the hits have.

    The hits are a fused list of a few; they are scored in one call, and if that fails, the whole list keeps its order and
    `rerank_error` says why.
    """
    if scorer is None:
        return hits.withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_error": F.lit(None).cast("string")}).orderBy("rank").limit(n)

    def score(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        values, error = [None] * len(rows), None
        try:
            values = [float(x) for x in scorer(query, list(rows["text"]))]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            warnings.warn(f"hits are not reranked: {error}", stacklevel=1)
        if len(values) != len(rows):
            values, error = [None] * len(rows), f"{len(values)} scores for {len(rows)} texts"
        yield rows.assign(rerank_score=pd.Series(values, dtype="float64"), rerank_error=error)

    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("rerank_error", T.StringType())])
    # an exchange of the few hits: without one, whatever finds them would run in one task, too
    return hits.repartition(1).mapInPandas(score, schema).orderBy(F.desc_nulls_last("rerank_score"), "rank").limit(n)


class CrossEncoder:
    """A scorer that loads its model where it first scores; `load` gives an object with predict(pairs, batch_size=)."""

    def __init__(self, model: str, batch_size: int = 16, load: Callable[[str], object] | None = None):
        self.model, self.batch_size, self.load = model, batch_size, load or _cross_encoder
        self._loaded = None

    def __getstate__(self):
        return self.__dict__ | {"_loaded": None}

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        if self._loaded is None:
            self._loaded = self.load(self.model)
        return [float(x) for x in self._loaded.predict([(query, t) for t in texts], batch_size=self.batch_size)]


def _cross_encoder(name: str):
    from sentence_transformers import CrossEncoder as Model

    return Model(name)
