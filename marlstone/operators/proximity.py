"""A reranker that is learned from the corpus: how near each other a query's words stand in a text, and in what order.

Training asks the keyword index for passages that the corpus itself has, chosen by id hash; the passage's own text is right, the other
hits are wrong, and a logistic model of the differences of their features (Spark ML) learns what tells them apart. The model is a
handful of weights, so it scores wherever the hits are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares are of the query's distinct words; a pair is two of its words that follow each other.
FEATURES = ("matched share", "pairs in order", "pairs within five words", "density of the best window", "words in order, longest run", "log length", "inverse rank")


def words_of(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def features(query: str, texts: list[str | None], ranks: list[int]) -> np.ndarray:
    """A row a text: FEATURES. A query or text without words has zeros but for the rank."""
    asked = words_of(query)
    kinds = set(asked)
    pairs = set(zip(asked, asked[1:], strict=False))
    out = np.zeros((len(texts), len(FEATURES)))
    for row, text, rank in zip(out, texts, ranks, strict=True):
        words = words_of(text)
        row[6] = 1.0 / rank
        if not kinds or not words:
            continue
        row[5] = np.log(len(words))
        at = [(k, w) for k, w in enumerate(words) if w in kinds]
        row[0] = len({w for _, w in at}) / len(kinds)
        if pairs:
            row[1] = len(pairs & set(zip(words, words[1:], strict=False))) / len(pairs)
            close = {(v, w) for n, (k, v) in enumerate(at) for j, w in at[n + 1 : n + 6] if j - k <= 5}
            row[2] = len(pairs & close) / len(pairs)
        row[3] = _density(at, len(kinds))
        row[4] = _longest(asked, words) / len(asked)
    return out


def _density(at: list[tuple[int, str]], kinds: int) -> float:
    """The most that a window of the text holds of the query's distinct words, over its length beyond them: at most 1."""
    best, held, left = 0.0, {}, 0
    for k, w in at:
        held[w] = held.get(w, 0) + 1
        while held[at[left][1]] > 1:
            held[at[left][1]] -= 1
            left += 1
        n, span = sum(c > 0 for c in held.values()), k - at[left][0] + 1
        best = max(best, n / kinds * n / span)
    return best


def _longest(asked: list[str], words: list[str]) -> int:
    """The longest run of words that the query and the text share."""
    places: dict[str, list[int]] = {}
    for k, w in enumerate(asked):
        places.setdefault(w, []).append(k)
    best, before = 0, {}
    for w in words:
        now = {k: before.get(k - 1, 0) + 1 for k in places.get(w, ())}
        if now:
            best = max(best, *now.values())
        before = now
    return best


@dataclass(frozen=True)
class Proximity:
    """A scorer for fuse.rerank: texts come in their fused order."""

    weights: tuple[float, ...]

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        return (features(query, texts, list(range(1, len(texts) + 1))) @ np.array(self.weights)).tolist()


def passages(chunks: DataFrame, most: int = 512, words: int = 6, salt: int = 11) -> DataFrame:
    """query_id, text, chunk_id of at most about `most` passages of `words` words, chosen by id hash, of chunks (chunk_id, text) that are at
    least twice as long; where in its chunk a passage lies follows from the hash, too."""
    split = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))
    n = chunks.count()
    hashed = F.xxhash64("chunk_id", F.lit(salt))
    some = chunks.where(F.pmod(hashed, F.lit(max(1, n // most))) == 0).select("chunk_id", split.alias("w"), hashed.alias("h")).where(F.size("w") >= 2 * words)
    at = (F.pmod(F.col("h"), F.size("w") - words + 1) + 1).cast("int")
    return some.select(F.col("h").alias("query_id"), F.array_join(F.slice("w", at, F.lit(words)), " ").alias("text"), "chunk_id")


def judged(asked: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, query, chunk_id, text, rank, right of hits (query_id, chunk_id, rank) of queries that find their own chunk. Other chunks
    with the whole passage are neither right nor wrong, and are left out."""
    own = asked.select("query_id", F.col("text").alias("query"), F.col("chunk_id").alias("own"))
    # the hits of a set of queries go to the texts, which stay where they are
    rows = chunks.select("chunk_id", "text").join(F.broadcast(hits.join(own, "query_id")), "chunk_id")
    rows = rows.withColumn("right", F.col("chunk_id") == F.col("own"))
    flat = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)), " "), F.lit(" "))
    rows = rows.where(F.col("right") | ~F.contains(flat, F.concat(F.lit(" "), F.col("query"), F.lit(" "))))
    found = rows.where("right").select("query_id")
    return rows.join(found, "query_id", "left_semi").select("query_id", "query", "chunk_id", "text", "rank", "right")


def _featured(rows: DataFrame) -> DataFrame:
    """query_id, right, rank, x of judged rows, computed where they are."""
    kind = rows.schema["query_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = [features(q, [t], [r])[0].tolist() for q, t, r in zip(b["query"], b["text"], b["rank"], strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], "right": b["right"], "rank": b["rank"], "x": x})

    return rows.mapInPandas(run, f"query_id {kind}, right boolean, rank int, x array<double>")


def learn(rows: DataFrame, strength: float = 1e-3) -> Proximity:
    """The weights of a pairwise logistic model: of each query the differences of its right text and every wrong one, both ways."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    made = _featured(rows).persist()
    right, wrong = made.where("right").select("query_id", F.col("x").alias("a")), made.where("not right").select("query_id", F.col("x").alias("b"))
    pairs = right.join(wrong, "query_id").select(F.zip_with("a", "b", lambda a, b: a - b).alias("d"))
    both = pairs.select(F.col("d"), F.lit(1.0).alias("label")).unionByName(pairs.select(F.transform("d", lambda v: -v).alias("d"), F.lit(0.0).alias("label")))
    model = LogisticRegression(fitIntercept=False, regParam=strength, maxIter=50).fit(both.select(array_to_vector("d").alias("features"), "label"))
    made.unpersist()
    return Proximity(tuple(float(v) for v in model.coefficients))


def reranked(rows: DataFrame, scorer: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """rows (query_id, query, chunk_id, text, rank, ...) of many queries with new_rank: a query's few hits are scored together."""
    from pyspark.sql import types as T

    out = T.StructType([*rows.schema.fields, T.StructField("new_rank", T.IntegerType())])

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rank", ignore_index=True)
        order = np.argsort(-np.array(scorer(t["query"].iloc[0], list(t["text"]))), kind="stable")
        place = np.empty(len(t), np.int32)
        place[order] = np.arange(1, len(t) + 1)
        return t.assign(new_rank=place)

    return rows.groupBy("query_id").applyInPandas(one, out)


def gain(rows: DataFrame, rank: str) -> float:
    """Mean nDCG of judged rows by a rank column: with one right text a query, 1 / log2(1 + its place among those judged)."""
    return rows.where("right").agg(F.avg(1.0 / F.log2(1.0 + F.col(rank)))).first()[0] or 0.0
