"""BM25+ over postings: term statistics as tables, a query as a join with them.

`library` gives every document the lower bound delta for every known query word, as the widely used implementation does,
so that documents without a match follow in id order; `paper` gives it to matched words alone (Lv & Zhai 2011).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from marlstone.functions.text import tokens
from marlstone.operators.vector import _Best

K1, B, DELTA = 1.5, 0.75, 1.0


@dataclass
class Index:
    """Tables, and statistics that are read off them when first asked for."""

    postings: DataFrame  # term, chunk_id, tf, dl
    terms: DataFrame  # term, df
    docs: DataFrame  # chunk_id, dl
    split: Callable[[Column], Column] = tokens
    stats: dict = field(default_factory=dict)

    @property
    def n(self) -> int:
        if "n" not in self.stats:
            self.stats["n"] = self.docs.count()
        return self.stats["n"]

    @property
    def avgdl(self) -> float:
        if "avgdl" not in self.stats:
            self.stats["n"], words = self.docs.agg(F.count("*"), F.sum("dl")).first()
            self.stats["avgdl"] = (words or 0) / self.n if self.n else 0.0
        return self.stats["avgdl"]

    def least(self, k: int) -> list:
        """The k least ids: those of documents without a match come first."""
        known = self.stats.get("least", [])
        if len(known) < min(k, self.n):
            known = self.stats["least"] = [r[0] for r in self.docs.select("chunk_id").orderBy("chunk_id").limit(k).collect()]
        return known[:k]

    def search(self, queries: DataFrame, n: int = 50, delta_mode: str = "library") -> DataFrame:
        return search(self, queries, n, delta_mode)


def term_counts(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", only: DataFrame | None = None, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """chunk_id, term, tf, dl: one shuffle, on the chunk and its terms; with `only` (term), of these terms alone."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), split(F.col(text_col)).alias("words"))
    # explode_outer: explode's inferred filter would split every text again
    counted = words.select("chunk_id", F.size("words").alias("dl"), F.explode_outer("words").alias("term")).where("term is not null")
    if only is not None:
        counted = counted.join(only, "term", "left_semi")
    return counted.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def document_counts(chunks: DataFrame, text_col: str = "text", only: DataFrame | None = None, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """term, df. A text's words are told apart within its row, so what is shuffled are each task's distinct terms."""
    own = chunks.select(F.explode_outer(F.array_distinct(split(F.col(text_col)))).alias("term")).where("term is not null")
    if only is not None:
        own = own.join(only, "term", "left_semi")
    return own.groupBy("term").agg(F.count("*").alias("df"))


def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", queries: DataFrame | None = None, split: Callable[[Column], Column] = tokens) -> Index:
    """The index of chunks; with `queries` (text), of their terms alone, which is all that they need of it."""
    only = None if queries is None else queries.select(F.explode(split(F.col("text"))).alias("term")).distinct()
    docs = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.size(split(F.col(text_col))), F.lit(0)).alias("dl"))
    return Index(term_counts(chunks, id_col, text_col, only, split), document_counts(chunks, text_col, only, split), docs, split)


def idf(df: Column, n: int) -> Column:
    return F.log((F.lit(float(n)) + 1.0) / df)


def search(index: Index, queries: DataFrame, n: int = 50, delta_mode: str = "library", digits: int = 9) -> DataFrame:
    """query_id, chunk_id, score, rank: of each query (query_id, text) the n best with a positive score.

    Scores are rounded before they are ranked, so that equal documents tie; ties follow the chunk's id. A query of no
    known word finds nothing.
    """
    asked = queries.select("query_id", F.explode_outer(index.split(F.col("text"))).alias("term")).where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    avgdl = index.avgdl
    weighed = asked.join(index.terms, "term").select("query_id", "term", (idf(F.col("df"), index.n) * F.col("times")).alias("weight"))
    tf = F.col("tf").cast("double")
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl)) if avgdl else F.lit(0.0)
    if delta_mode == "paper":
        rows = index.postings.join(weighed, "term").select("query_id", "chunk_id", F.lit(0.0).alias("base"), (F.col("weight") * (gain + DELTA)).alias("gain"))
    else:
        weighed = weighed.withColumn("base", DELTA * F.sum("weight").over(Window.partitionBy("query_id")))
        rows = index.postings.join(weighed, "term").select("query_id", "chunk_id", "base", (F.col("weight") * gain).alias("gain"))
        ids = index.least(2 * n)
        if ids:
            # fewer than n matches leave room; then n of the 2n least ids have no match at least
            bases = weighed.groupBy("query_id").agg(F.max("base").alias("base"))
            listed = F.array(*[F.lit(i) for i in ids]).cast(ArrayType(index.docs.schema["chunk_id"].dataType))
            rows = rows.unionByName(bases.select("query_id", F.explode(listed).alias("chunk_id"), "base", F.lit(0.0).alias("gain")))
    hits = rows.groupBy("query_id", "chunk_id").agg((F.max("base") + F.sum("gain")).alias("score"))
    hits = hits.withColumn("score", F.round("score", digits)).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def batch_top(chunks: DataFrame, queries: DataFrame, n: int = 50, delta_mode: str = "library", digits: int = 9, id_col: str = "chunk_id", text_col: str = "text", split: Callable[[Column], Column] = tokens, hold: int = 1 << 22) -> DataFrame:
    """search(build(chunks), queries, n) for a set of queries whose words a task can hold: texts are scored where they are, and a task
    keeps the n best of each query, so what is shuffled are queries x n rows a task, and no postings. About `hold` numbers are held at a time.
    """
    asked = queries.select("query_id", F.explode_outer(split(F.col("text"))).alias("term")).where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("times")).toArrow()
    id_type, query_type = (f.schema[c].dataType.simpleString() for f, c in ((chunks, id_col), (queries, "query_id")))
    kind = f"query_id {query_type}, chunk_id {id_type}, score double"
    words = pc.unique(asked["term"].combine_chunks())
    index = build(chunks, id_col, text_col, queries, split)
    df = {r["term"]: r["df"] for r in index.terms.collect()}
    words = words.filter(pc.is_in(words, pa.array(list(df), words.type)))
    avgdl, total = index.avgdl, index.n
    names = pc.unique(asked["query_id"].combine_chunks())
    weights: list[list[tuple[int, float]]] = [[] for _ in names]
    place = {w: k for k, w in enumerate(words.to_pylist())}
    for q, term, times in zip(pc.index_in(asked["query_id"], names).to_pylist(), asked["term"].to_pylist(), asked["times"].to_pylist(), strict=True):
        if term in place:
            weights[q].append((place[term], math.log((total + 1.0) / df[term]) * times))
    for own in weights:
        own.sort()
    if not place:
        return chunks.sparkSession.createDataFrame([], kind + ", rank int")
    paper = delta_mode == "paper"
    base = np.array([0.0 if paper else DELTA * sum(w for _, w in own) for own in weights])
    step = max(64, min(4096, hold // (len(words) + 4 * len(names))))

    def run(batches):
        best = _Best(len(names), n)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                found = some.column(2)
                row = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy())
                term = pc.index_in(found.flatten(), words).to_numpy()
                cell, tf = np.unique(term.astype(np.int64) * len(found) + row, return_counts=True)
                dl = some.column(1).to_numpy()[cell % len(found)]
                gain = np.zeros(len(words) * len(found))
                gain[cell] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)) + (DELTA if paper else 0.0)
                gain = gain.reshape(len(words), len(found))
                score = np.zeros((len(names), len(found)))
                for q, own in enumerate(weights):
                    for k, w in own:
                        score[q] += w * gain[k]
                best.take(some.column(0), -np.round(base[:, None] + score, digits))
        if best.ids is not None:
            q, ids, worth = best.rows()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(-worth)], names=["query_id", "chunk_id", "score"])

    cut = chunks.select(F.col(id_col).alias("chunk_id"), split(F.col(text_col)).alias("w"))
    cut = cut.select("chunk_id", F.coalesce(F.size("w"), F.lit(0)).cast("double").alias("dl"), F.coalesce(F.filter("w", lambda w: w.isin(*words.to_pylist())), F.array().cast("array<string>")).alias("w"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return cut.mapInArrow(run, kind).where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def add(index: Index, more: DataFrame, id_col: str = "chunk_id", text_col: str = "text", queries: DataFrame | None = None) -> Index:
    """The index with further chunks: their postings are appended and the statistics follow."""
    new = build(more, id_col, text_col, queries, index.split)
    terms = index.terms.unionByName(new.terms).groupBy("term").agg(F.sum("df").alias("df"))
    return Index(index.postings.unionByName(new.postings), terms, index.docs.unionByName(new.docs), index.split)


def save(index: Index, path: str, fingerprint: str) -> None:
    """Tables under path, and last a manifest with the corpus's fingerprint, without which they do not count."""
    spark = index.postings.sparkSession
    index.postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    n, words = spark.read.parquet(f"{path}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    spark.createDataFrame([(fingerprint, n, words / n if n else 0.0)], "fingerprint string, n long, avgdl double").write.mode("overwrite").parquet(f"{path}/manifest")


def load(spark, path: str, fingerprint: str, split: Callable[[Column], Column] = tokens) -> Index | None:
    """A saved index of just this corpus, or None."""
    try:
        m = spark.read.parquet(f"{path}/manifest").first()
    except AnalysisException:  # nothing there
        return None
    if m is None or m["fingerprint"] != fingerprint:
        return None
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "docs")]
    return Index(*tables, split, {"n": m["n"], "avgdl": m["avgdl"]})
