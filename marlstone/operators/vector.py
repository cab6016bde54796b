"""Exact nearest neighbours by cosine distance.

One query is an expression over the store and a top-n. A set of queries goes out in blocks as matrices; each task keeps,
for each query, the n best of all its rows so far, and the tasks' bests are ranked together: queries x n rows a task are
shuffled. A row without a vector is near nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.vectors import cosine_distance, distance_score

#: Filters of the search tools and the columns they compare.
FILTERS = {"file_type": "file_type", "author": "doc_author", "doc_type": "doc_type"}


def predicate(filters: dict[str, str | None] | None, listing: bool = False) -> Column:
    """Equality on every given filter. In listings a file type counts without its dot and in lower case."""
    given = {k: v for k, v in (filters or {}).items() if v}
    if unknown := given.keys() - FILTERS.keys():
        raise ValueError(f"no such filter: {sorted(unknown)}")
    if listing and "file_type" in given:
        given["file_type"] = given["file_type"].lower().lstrip(".")
    return reduce(lambda a, b: a & b, (F.col(FILTERS[k]) == v for k, v in given.items()), F.lit(True))


def top(store: DataFrame, vector: Sequence[float], n: int = 50, where: Column | None = None, keep: tuple[str, ...] = (), id_col: str = "chunk_id") -> DataFrame:
    """id, distance, score and the kept columns of the n nearest rows of store(embedding); ties follow the id."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    rows = store if where is None else store.where(where)
    found = rows.where("embedding is not null").select(id_col, *keep, F.round(cosine_distance(F.col("embedding"), query), 9).alias("distance"))
    return found.withColumn("score", distance_score(F.col("distance"))).orderBy("distance", id_col).limit(n)


def within(store: DataFrame, vector: Sequence[float], min_score: float, id_col: str = "chunk_id") -> DataFrame:
    """id, distance, score of all rows of store(embedding) that score min_score at least."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    found = store.where("embedding is not null").select(id_col, F.round(cosine_distance(F.col("embedding"), query), 9).alias("distance"))
    return found.withColumn("score", distance_score(F.col("distance"))).where(F.col("score") >= min_score)


def batch_top(store: DataFrame, queries: DataFrame, n: int = 50, where: Column | None = None, id_col: str = "chunk_id", block: int = 1024) -> DataFrame:
    """query_id, id, distance, score, rank of queries (query_id, embedding), `block` of them a pass over the store."""
    rows = (store if where is None else store.where(where)).where("embedding is not null").select(id_col, "embedding")
    queries = queries.where("embedding is not null")
    id_type = rows.schema[id_col].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    n_blocks = -(-queries.count() // block) or 1
    parts = []
    for k in range(n_blocks):
        some = queries.select("query_id", "embedding") if n_blocks == 1 else queries.select("query_id", "embedding").where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == k)
        asked = some.toArrow()
        if not asked.num_rows:
            continue
        names = asked["query_id"].combine_chunks()
        matrix = _unit(_matrix(asked["embedding"].combine_chunks()))

        def run(batches, names=names, matrix=matrix):
            best = _Best(len(names), n)
            for b in batches:
                if b.num_rows:
                    best.take(b.column(0), np.round(1.0 - matrix @ _unit(_matrix(b.column(1))).T, 9))
            if best.ids is not None:
                q, ids, distance = best.rows()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(distance)], names=["query_id", id_col, "distance"])

        parts.append(rows.mapInArrow(run, f"query_id {query_type}, {id_col} {id_type}, distance double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"query_id {query_type}, {id_col} {id_type}, distance double, score double, rank int")
    order = Window.partitionBy("query_id").orderBy("distance", id_col)
    found = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return found.select("query_id", id_col, "distance", distance_score(F.col("distance")).alias("score"), "rank")


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors, all of one length and none null, off the array's flat buffer."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


class _Best:
    """Of each query the n least (distance, id) of what a task has seen: places in `ids`, which holds only those named."""

    def __init__(self, queries: int, n: int):
        self.queries, self.n, self.ids = queries, n, None

    def take(self, ids: pa.Array, distance: np.ndarray) -> None:
        if self.ids is None:
            self.at, self.distance = np.zeros((self.queries, 0), np.int64), np.zeros((self.queries, 0))
            self.ids = ids.slice(0, 0)
        pool = pa.concat_arrays([self.ids, ids])
        at = np.concatenate([self.at, np.broadcast_to(len(self.ids) + np.arange(len(ids)), distance.shape)], axis=1)
        distance = np.concatenate([self.distance, distance], axis=1)
        order = np.empty(len(pool), np.int64)
        order[pc.sort_indices(pool).to_numpy()] = np.arange(len(pool))  # places by id
        if distance.shape[1] > self.n:
            cut = np.partition(distance, self.n - 1, axis=1)[:, self.n - 1 : self.n]
            rows = []
            for d, c, a in zip(distance, cut, at, strict=True):
                near = np.flatnonzero(d <= c)  # ties with the last one, too
                rows.append(near[np.lexsort((order[a[near]], d[near]))[: self.n]])
            kept = np.stack(rows)
            at, distance = np.take_along_axis(at, kept, 1), np.take_along_axis(distance, kept, 1)
        named, place = np.unique(at, return_inverse=True)
        self.ids, self.at, self.distance = pool.take(pa.array(named)), place.reshape(at.shape), distance

    def rows(self):
        q = np.repeat(np.arange(self.queries), self.at.shape[1])
        return q, self.ids.take(pa.array(self.at.ravel())), self.distance.ravel()
